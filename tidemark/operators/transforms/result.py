"""What every transform returns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame


@dataclass
class TransformResult:
    """The transformed (lazy) DataFrame and, on demand, numbers about what changed.

    `measure` runs Spark jobs, so it is called only when `details`, `rows_affected` or `message` is read.
    """

    df: DataFrame
    success: bool = True
    columns_affected: list[str] = field(default_factory=list)
    measure: Callable[[], dict] | None = None
    note: str = ""
    extra_outputs: dict = field(default_factory=dict)

    @cached_property
    def _measured(self) -> dict:
        return self.measure() if self.measure else {}

    @property
    def details(self) -> dict:
        return self._measured.get("details", {})

    @property
    def rows_affected(self) -> int:
        return self._measured.get("rows_affected", 0)

    @property
    def message(self) -> str:
        return self._measured.get("message", self.note)

    def to_dict(self) -> dict:
        return {"success": self.success, "message": self.message, "rows_affected": self.rows_affected,
                "columns_affected": self.columns_affected, "details": self.details,
                "columns": self.df.columns}


def choose_method(config: dict, supported: list[str], default: str) -> str:
    """The configured method; three short names are understood, any other unknown one gives the default."""
    method = config.get("method", default) or default
    if method in supported:
        return method
    short = {"iqr": "iqr_cap", "zscore": "zscore_cap", "onehot": "one_hot"}.get(method, default)
    return short if short in supported else default


def names(value) -> list[str]:
    """A list of column names from a list, a single name or nothing."""
    if not value:
        return []
    return [value] if isinstance(value, str) else list(value)
