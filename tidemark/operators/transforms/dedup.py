"""Remove duplicate rows. Null keys equal each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ...functions.columns import col
from .. import values
from .result import TransformResult, choose_method, names

METHODS = ["exact", "subset", "keep_first", "keep_last", "keep_none"]
KEEPS = {"keep_first": "first", "keep_last": "last", "keep_none": "none"}


def keep_one(df: DataFrame, subset: list[str] | None = None, keep="first",
             order_by: list[str] | None = None) -> DataFrame:
    """One row per group (`first`, `last`) or only rows without a twin (`none` or False).

    This is an aggregation, not a window: a group is reduced to one candidate per task before the
    shuffle, so a group with a third of all rows costs no more than any other.
    """
    keys = list(subset or df.columns)
    none = keep in ("none", False)
    if not none and set(keys) == set(df.columns):
        return df.dropDuplicates()
    order = list(order_by or [])
    rest = [c for c in df.columns if c not in order and not isinstance(df.schema[c].dataType, T.MapType)]
    rank = F.struct(*[col(c) for c in [*order, *rest]])
    whole = F.struct(*[col(c) for c in df.columns])
    pick = F.max_by if keep == "last" else F.min_by
    grouped = df.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)]) \
        .agg(pick(whole, rank).alias("__row"), F.count("*").alias("__n"))
    if none:
        grouped = grouped.where(F.col("__n") == 1)
    return grouped.select("__row.*")


def deduplicate(df: DataFrame, config: dict) -> TransformResult:
    """Config: method (exact), columns/subset, keep (first), order_by (what first and last mean)."""
    method = choose_method(config, METHODS, "exact")
    subset = names(config.get("columns", config.get("subset")))
    missing = [c for c in subset if c not in df.columns]
    if missing:
        return TransformResult(df, success=False, note=f"Columns not found: {missing}")
    keep = KEEPS.get(method, config.get("keep", "first"))
    out = keep_one(df, subset or None, keep, names(config.get("order_by")))
    return TransformResult(out, measure=lambda: _measure(df, subset, keep, method))


def _measure(df: DataFrame, subset: list[str], keep, method: str) -> dict:
    keys = [values.plain(df, c).alias(f"k{i}") for i, c in enumerate(subset or df.columns)]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    lost = F.when(F.col("n") > 1, F.col("n")).otherwise(0) if keep in ("none", False) else F.col("n") - 1
    row = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                     F.coalesce(F.sum(lost), F.lit(0)).alias("lost")).first()
    what = ", ".join(subset) if subset else "all columns"
    return {"rows_affected": row["lost"],
            "details": {"original_rows": row["rows"], "duplicate_rows": row["lost"],
                        "remaining_rows": row["rows"] - row["lost"], "method": method,
                        "subset_columns": subset or "all columns"},
            "message": f"Removed {row['lost']} duplicate rows ({method} on {what})"}


def column_deduplication(df: DataFrame, config: dict) -> TransformResult:
    """Dedup on a required `subset`, with statistics of those columns before and after."""
    from ..profile import snapshot_stats
    subset = names(config.get("subset", config.get("columns")))
    if not subset or any(c not in df.columns for c in subset):
        return TransformResult(df, success=False, note="subset columns are required and must exist")
    keep = config.get("keep", "first")
    out = keep_one(df, subset, keep, names(config.get("order_by")))

    def measure() -> dict:
        base = _measure(df, subset, keep, "column_deduplication")
        base["details"]["before"] = {r["column"]: r.asDict() for r in snapshot_stats(df, subset).collect()}
        base["details"]["after"] = {r["column"]: r.asDict() for r in snapshot_stats(out, subset).collect()}
        return base

    return TransformResult(out, columns_affected=subset, measure=measure)


def full_row_deduplication(df: DataFrame, config: dict) -> TransformResult:
    """Dedup on all columns; keep first, last or none."""
    keep = config.get("keep", "first")
    out = keep_one(df, None, keep)
    return TransformResult(out, columns_affected=df.columns,
                           measure=lambda: _measure(df, [], keep, "full_row_deduplication"))
