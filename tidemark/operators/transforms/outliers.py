"""Remove or cap outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.columns import as_double, as_number, col, is_numeric, numeric_columns, pick_columns
from .. import quantiles
from .result import TransformResult, choose_method

METHODS = ["iqr_remove", "iqr_cap", "zscore_remove", "zscore_cap", "winsorize", "percentile_clip"]


def bounds(df: DataFrame, columns: list[str], method: str, config: dict) -> dict[str, tuple]:
    """(low, high) per column beyond which a value is an outlier; columns without bounds are left out."""
    numbers = {c: as_double(df, c) for c in columns}
    if method.startswith("zscore"):
        t = config.get("threshold", config.get("z_threshold", 3.0))
        row = df.agg(*[e for i, c in enumerate(columns) for e in (
            F.count(numbers[c]).alias(f"n{i}"), F.avg(numbers[c]).alias(f"m{i}"),
            F.stddev_samp(numbers[c]).alias(f"s{i}"))]).first()
        out = {}
        for i, c in enumerate(columns):
            n, mean, sd = row[f"n{i}"], row[f"m{i}"], row[f"s{i}"]
            if n >= 3 and sd:
                out[c] = (mean - t * sd, mean + t * sd)
        return out
    row = df.agg(*[F.count(numbers[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    counts = {c: row[i] for i, c in enumerate(columns) if row[i] >= 3}
    usable = {c: numbers[c] for c in counts}
    if method == "winsorize":
        low, high = config.get("limits", (0.05, 0.05))
        exact = {c: as_number(df, c) for c in counts}
        wanted = {c: [int(low * n), n - int(high * n) - 1] for c, n in counts.items()}
        stats = quantiles.order_statistics(df, exact, wanted, counts)
        return {c: (stats[c][wanted[c][0]], stats[c][wanted[c][1]]) for c in counts}
    if method == "percentile_clip":
        probs = [config.get("lower_percentile", 1) / 100, config.get("upper_percentile", 99) / 100]
        return {c: (q[0], q[1]) for c, q in quantiles.quantiles(df, usable, probs, counts).items()}
    k = config.get("iqr_multiplier", config.get("multiplier", 1.5))
    return {c: (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0]))
            for c, q in quantiles.quantiles(df, usable, [0.25, 0.75], counts).items()}


def _outside(df: DataFrame, name: str, low, high) -> Column:
    c = as_number(df, name)
    return F.coalesce((c < F.lit(low)) | (c > F.lit(high)), F.lit(False))


def _clipped(df: DataFrame, name: str, low, high, keep_type: bool) -> Column:
    c = as_number(df, name) if keep_type else as_double(df, name)
    return F.when(c < F.lit(low), F.lit(low)).when(c > F.lit(high), F.lit(high)).otherwise(c)


def treat_outliers(df: DataFrame, config: dict) -> TransformResult:
    """Config: column/columns (default all numeric), method (iqr_remove), threshold/z_threshold (3.0),
    iqr_multiplier (1.5), lower_percentile (1), upper_percentile (99), limits (0.05, 0.05).

    Removal works column by column, so later fences see earlier removals. Capping one column does not
    touch another, so all columns share their statistics passes. Nulls are kept.
    """
    method = choose_method(config, METHODS, "iqr_remove")
    targets = [c for c in pick_columns(df, config, numeric_columns(df)) if is_numeric(df.schema[c].dataType)]
    if not targets:
        return TransformResult(df, success=False, note="No numeric columns found for outlier detection")
    steps: list[tuple[DataFrame, str, tuple]] = []
    out = df
    if method.endswith("_remove"):
        for c in targets:
            limits = bounds(out, [c], method, config).get(c)
            if limits:
                steps.append((out, c, limits))
                out = out.where(~_outside(out, c, *limits))
    else:
        limits = bounds(df, targets, method, config)
        steps = [(df, c, limits[c]) for c in targets if c in limits]
        out = df.select(*[_clipped(df, c, *limits[c], method == "winsorize").alias(c) if c in limits
                          else col(c) for c in df.columns])

    def measure() -> dict:
        counted = {c: d.agg(F.count_if(_outside(d, c, *lim))).first()[0] for d, c, lim in steps}
        total = sum(counted.values())
        removing = method.endswith("_remove")
        return {"rows_affected": total if removing else 0,
                "details": {c: {"outliers_found": n, "method": method} for c, n in counted.items()},
                "message": f"Outliers {'removed' if removing else 'capped/clipped'}: {total} outliers "
                           f"across {len(targets)} columns via {method}"}

    return TransformResult(out, columns_affected=targets, measure=measure)
