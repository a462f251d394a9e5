"""Sequences of transforms. The plan stays lazy; only a condition or a snapshot runs a job."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..operators.transforms import apply_transform
from ..sources.history import History
from ..sources.tables import save_copy


def run_batch(df: DataFrame, steps: list[tuple[str, dict]], copy_of: str | None = None) -> dict:
    """Apply transforms in order. A step that reports failure is skipped; one that raises stops the run.
    With `copy_of`, one fixed copy is written if every step succeeded."""
    log, current, stopped = [], df, False
    for kind, config in steps:
        try:
            result = apply_transform(current, kind, config)
        except Exception as e:  # noqa: BLE001 - any failure of a user's step ends the run and is reported
            log.append({"transform_type": kind, "status": "error", "message": str(e)})
            stopped = True
            break
        log.append({"transform_type": kind, "status": "success" if result.success else "failed",
                    "message": "" if result.success else result.message})
        if result.success:
            current = result.df
    ok = not stopped and all(s["status"] == "success" for s in log)
    saved = save_copy(current, copy_of) if ok and copy_of else None
    return {"df": current, "success": ok, "steps": log, "saved_as": saved}


@dataclass
class Step:
    transform_type: str
    config: dict = field(default_factory=dict)
    name: str = ""
    condition: str | None = None
    next_step: str | None = None     # kept, but steps run in order
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    def __post_init__(self) -> None:
        self.name = self.name or f"{self.transform_type}_{self.id[:6]}"


@dataclass
class Sequence:
    id: str
    name: str
    description: str = ""
    steps: list[Step] = field(default_factory=list)
    version: int = 1

    def add(self, transform_type: str, config: dict, **options) -> str:
        self.steps.append(Step(transform_type, config, **options))
        return self.steps[-1].id

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> Sequence:
        known = ("transform_type", "config", "name", "condition", "next_step", "id")
        steps = [Step(**{k: s[k] for k in known if s.get(k) is not None}) for s in data.get("steps", [])]
        return cls(data["id"], data["name"], data.get("description", ""), steps, data.get("version", 1))


def holds(condition: str, before: list[dict]) -> bool:
    """Whether a step may run, judged by the step before it. An unknown condition holds."""
    if not before:
        return condition != "check_passed"
    last = before[-1]
    if condition == "check_passed":
        return last["status"] == "success"
    if condition == "check_failed":
        return last["status"] == "failed"
    if condition.startswith("score > "):
        details = last["result"].details if last.get("result") is not None else {}
        return details.get("score", 0) > float(condition.split(">")[1])
    return True


def run_sequence(df: DataFrame, sequence: Sequence, history: History | None = None) -> dict:
    """Run steps whose condition holds. With a history, each step's input is saved first."""
    current, log = df, []
    for i, step in enumerate(sequence.steps):
        entry = {"step_id": step.id, "step_name": step.name, "result": None}
        if step.condition and not holds(step.condition, log):
            log.append(entry | {"status": "skipped", "reason": f"Condition not met: {step.condition}"})
            continue
        if history is not None:
            entry["snapshot_id"] = history.save_snapshot(
                current, step.transform_type, step.config, {"step_index": i, "step_name": step.name})
        try:
            result = apply_transform(current, step.transform_type, step.config)
        except Exception as e:  # noqa: BLE001 - any failure of a user's step ends the run and is reported
            log.append(entry | {"status": "error", "message": str(e)})
            break
        log.append(entry | {"status": "success" if result.success else "failed", "result": result})
        if result.success:
            current = result.df
    by_status = [s["status"] for s in log]
    return {"df": current, "success": "success" in by_status, "total_steps": len(sequence.steps),
            "completed_steps": by_status.count("success"), "skipped_steps": by_status.count("skipped"),
            "failed_steps": by_status.count("failed") + by_status.count("error"), "steps": log}
