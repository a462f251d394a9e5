"""Data contracts: a dict of expectations, checked with one fused aggregation plus one shuffle per key.

Contract: schema {columns: [{name, type}]}, columns {name: {nullable, min, max, allowed_values, pattern}},
rules [{type: row_count | no_duplicates | completeness, ...}], freshness, unique_keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col, is_missing, is_numeric, not_matching, value
from . import values

TYPE_CLASSES = {
    "int": T.IntegralType, "float": (T.FloatType, T.DoubleType), "string": T.StringType,
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType), "bool": T.BooleanType,
    "numeric": T.NumericType,
}
VIOLATION_SCHEMA = "type string, column string, severity string, count bigint, detail string"


def has_type(dtype: T.DataType, expected: str) -> bool:
    """Type class by name; any other name must be part of the Spark type's name."""
    if expected in TYPE_CLASSES:
        return isinstance(dtype, TYPE_CLASSES[expected])
    return expected in dtype.simpleString()


class _Tally:
    def __init__(self) -> None:
        self.total = self.passed = self.failed = 0
        self.violations: list[tuple] = []

    def add(self, ok: bool | None, kind: str = "", column: str = "", severity: str = "",
            count: int | None = None, detail: str = "") -> None:
        """Count a check; None counts it as neither passed nor failed."""
        self.total += 1
        if ok:
            self.passed += 1
        elif ok is False:
            self.failed += 1
            self.violations.append((kind, column, severity, count, detail))


def _plain_text(df: DataFrame, name: str):
    """Text form for comparing with allowed values: 1.0 and 1 stay apart, as they do in the data."""
    return values.plain(df, name).cast("string")


def _allowed(rules: dict) -> list[str]:
    return [("true" if v else "false") if isinstance(v, bool) else str(v) for v in rules["allowed_values"]]


def validate(df: DataFrame, contract: dict) -> dict:
    """Verdict, score (5 points off per failed check), counts and violations.

    A freshness clause is counted as passed without looking at data. A range on a column that is not
    numeric is counted but neither passes nor fails.
    """
    tally = _Tally()
    wanted = contract.get("columns") or {}
    keys = [k if isinstance(k, list) else [k] for k in contract.get("unique_keys") or []]
    exprs = [F.count("*").alias("rows")]
    for i, (c, rules) in enumerate(wanted.items()):
        if c not in df.columns:
            continue
        exprs.append(F.count_if(is_missing(df, c)).alias(f"null{i}"))
        if ("min" in rules or "max" in rules) and is_numeric(df.schema[c].dataType):
            x = value(df, c)
            bad = F.lit(False)
            if rules.get("min") is not None:
                bad = bad | (x < F.lit(rules["min"]))
            if rules.get("max") is not None:
                bad = bad | (x > F.lit(rules["max"]))
            exprs.append(F.count_if(bad).alias(f"range{i}"))
        if "allowed_values" in rules:
            exprs.append(F.count_if(~_plain_text(df, c).isin(_allowed(rules))).alias(f"enum{i}"))
        if "pattern" in rules:
            exprs.append(F.count_if(not_matching(df, c, rules["pattern"])).alias(f"pat{i}"))
    if any(r.get("type") == "completeness" for r in contract.get("rules") or []):
        exprs += [F.count_if(is_missing(df, c)).alias(f"all{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*exprs).first()

    for spec in (contract.get("schema") or {}).get("columns", []):
        c, kind = spec.get("name", ""), spec.get("type", "")
        if c not in df.columns:
            tally.add(False, "missing_column", c, "critical", detail=f"Required column '{c}' not found")
        elif kind and not has_type(df.schema[c].dataType, kind):
            tally.add(False, "type_mismatch", c, "warning",
                      detail=f"expected {kind}, actual {df.schema[c].dataType.simpleString()}")
        else:
            tally.add(True)

    for i, (c, rules) in enumerate(wanted.items()):
        if c not in df.columns:
            continue
        if rules.get("nullable") is False:
            n = row[f"null{i}"]
            tally.add(not n, "not_nullable", c, "error", n)
        if "min" in rules or "max" in rules:
            if is_numeric(df.schema[c].dataType):
                n = row[f"range{i}"]
                tally.add(not n, "range_violation", c, "warning", n,
                          f"min {rules.get('min', '-inf')}, max {rules.get('max', 'inf')}")
            else:
                tally.add(None)
        if "allowed_values" in rules:
            n = row[f"enum{i}"]
            shown = ""
            if n:
                shown = ", ".join(r["value"] for r in invalid_values(df, c, rules["allowed_values"]).collect())
            tally.add(not n, "invalid_values", c, "error", n, shown)
        if "pattern" in rules:
            n = row[f"pat{i}"]
            tally.add(not n, "pattern_violation", c, "warning", n, rules["pattern"])

    for rule in contract.get("rules") or []:
        kind = rule.get("type", "")
        if kind == "row_count":
            low, high = rule.get("min", 0), rule.get("max", float("inf"))
            tally.add(low <= row["rows"] <= high, "row_count", "", "error", row["rows"], f"min {low}, max {high}")
        elif kind == "no_duplicates":
            n = values.duplicate_rows(df, rule.get("columns"))
            tally.add(not n, "duplicates", "", "warning", n)
        elif kind == "completeness":
            gaps = sum(row[f"all{i}"] for i in range(len(df.columns)))
            cells = row["rows"] * len(df.columns)
            actual = (1 - gaps / cells) * 100 if cells else 100.0
            limit = rule.get("threshold", 100)
            tally.add(actual >= limit, "completeness", "", "error", gaps,
                      f"actual {round(actual, 2)}, threshold {limit}")
        else:
            tally.add(None)
    if "freshness" in contract:
        tally.add(True)
    for key in keys:
        n = values.duplicate_rows(df, key)
        tally.add(not n, "unique_key_violation", ",".join(key), "error", n)

    return {"valid": tally.failed == 0, "score": round(max(0.0, 100.0 - 5 * tally.failed), 1),
            "total_checks": tally.total, "passed_checks": tally.passed, "failed_checks": tally.failed,
            "violations": df.sparkSession.createDataFrame(tally.violations, VIOLATION_SCHEMA)}


def invalid_values(df: DataFrame, name: str, allowed: list, limit: int = 10) -> DataFrame:
    """Up to `limit` distinct offending values, smallest first."""
    text = _plain_text(df, name)
    bad = df.select(text.alias("value")).where(
        F.col("value").isNotNull() & ~F.col("value").isin(_allowed({"allowed_values": allowed})))
    return bad.distinct().orderBy("value").limit(limit)


def values_not_in(df: DataFrame, name: str, allowed: DataFrame) -> DataFrame:
    """Distinct values missing from a table of allowed values (first column)."""
    ok = allowed.select(allowed.columns[0]).toDF("__ok").distinct()
    return df.select(col(name).alias(name)).where(col(name).isNotNull()).distinct() \
        .join(ok, col(name) == F.col("__ok"), "left_anti")


def verdict_frame(df: DataFrame, contract: dict) -> DataFrame:
    r = validate(df, contract)
    return df.sparkSession.createDataFrame(
        [(r["valid"], float(r["score"]), r["total_checks"], r["passed_checks"], r["failed_checks"])],
        "valid boolean, score double, total_checks bigint, passed_checks bigint, failed_checks bigint")
