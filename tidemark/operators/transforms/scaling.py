"""Scale numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions.columns import as_double, col, is_numeric, numeric_columns, pick_columns
from .. import quantiles
from .result import TransformResult, choose_method

METHODS = ["minmax", "zscore", "robust", "log", "max_abs"]


def _spread(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    row = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.min(as_double(df, c)).alias(f"min{i}"), F.max(as_double(df, c)).alias(f"max{i}"),
        F.avg(as_double(df, c)).alias(f"mean{i}"), F.stddev_samp(as_double(df, c)).alias(f"std{i}"),
    )]).first()
    return {c: {k: row[f"{k}{i}"] for k in ("min", "max", "mean", "std")} for i, c in enumerate(columns)}


def scale(df: DataFrame, config: dict) -> TransformResult:
    """Config: column/columns (default all numeric), method (minmax), feature_range ([0, 1]).

    Statistics come from one aggregation over all columns and enter the projection as literals. A
    constant column becomes the lower bound (minmax) or 0 (zscore, robust), also where it was null.
    """
    method = choose_method(config, METHODS, "minmax")
    targets = [c for c in pick_columns(df, config, numeric_columns(df)) if is_numeric(df.schema[c].dataType)]
    if not targets:
        return TransformResult(df, success=False, note="No numeric columns found for normalization")
    stats = _spread(df, targets)
    low, high = config.get("feature_range", [0, 1])
    thirds = quantiles.quantiles(df, {c: as_double(df, c) for c in targets}, [0.25, 0.5, 0.75]) \
        if method == "robust" else {}
    scaled = {}
    for c in targets:
        x, s = as_double(df, c), stats[c]
        if s["min"] is None:
            scaled[c] = x
        elif method == "minmax":
            width = s["max"] - s["min"]
            scaled[c] = F.lit(float(low)) if width == 0 else \
                (x - F.lit(s["min"])) / F.lit(width) * F.lit(float(high - low)) + F.lit(float(low))
        elif method == "zscore":
            scaled[c] = F.lit(0.0) if s["std"] == 0 else (x - F.lit(s["mean"])) / F.lit(s["std"])
        elif method == "robust":
            q1, q2, q3 = thirds[c]
            scaled[c] = F.lit(0.0) if q3 == q1 else (x - F.lit(q2)) / F.lit(q3 - q1)
        elif method == "log":
            scaled[c] = F.log1p(x - F.lit(s["min"]) + F.lit(1.0)) if s["min"] <= 0 else F.log1p(x)
        else:
            top = max(abs(s["min"]), abs(s["max"]))
            scaled[c] = x if top == 0 else x / F.lit(top)
    out = df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])

    def measure() -> dict:
        after = _spread(out, targets)
        return {"rows_affected": df.count(),
                "details": {c: {"method": method, "before": stats[c], "after": after[c]} for c in targets},
                "message": f"Normalized {len(targets)} columns using {method}"}

    return TransformResult(out, columns_affected=targets, measure=measure)
