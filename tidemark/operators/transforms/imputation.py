"""Fill missing values (null or NaN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ...functions.columns import as_double, col, is_missing, is_numeric, pick_columns, value
from .. import ordering, quantiles, values
from ..neighbours import fill_from_neighbours
from .result import TransformResult, choose_method, names

METHODS = ["mean", "median", "mode", "constant", "forward_fill", "backward_fill", "knn", "most_frequent"]


def missing_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    row = df.agg(*[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def _replacement(df: DataFrame, columns: list[str], method: str) -> dict[str, object]:
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    found: dict[str, object] = {}
    if method == "mean" and numeric:
        row = df.agg(*[F.avg(as_double(df, c)).alias(f"a{i}") for i, c in enumerate(numeric)]).first()
        found |= {c: row[i] for i, c in enumerate(numeric)}
    elif method == "median" and numeric:
        halves = quantiles.quantiles(df, {c: as_double(df, c) for c in numeric}, [0.5])
        found |= {c: v[0] for c, v in halves.items()}
    return found | values.modes(df, [c for c in columns if c not in found])


def _filled(df: DataFrame, name: str, replacement) -> Column:
    dtype = df.schema[name].dataType
    whole = isinstance(dtype, T.IntegralType)
    if replacement is None:
        return col(name)
    if whole and isinstance(replacement, float):
        return F.coalesce(col(name).cast("double"), F.lit(replacement))
    return F.coalesce(value(df, name), F.lit(replacement).cast(dtype))


def impute(df: DataFrame, config: dict) -> TransformResult:
    """Config: column/columns (default all), method (mean), fill_value, order_by, partition_by,
    n_neighbors (5).

    Forward and backward fill need `order_by`: Spark rows have no order of their own.
    """
    targets = pick_columns(df, config, df.columns)
    method = choose_method(config, METHODS, "mean")
    if not targets:
        return TransformResult(df, success=False, note="No valid columns specified for imputation")
    before = missing_counts(df, targets)
    if not sum(before.values()):
        return TransformResult(df, columns_affected=targets, note="No missing values found")
    gaps = [c for c in targets if before[c]]

    if method in ("forward_fill", "backward_fill"):
        order_by = names(config.get("order_by"))
        if not order_by:
            raise ValueError(f"{method} needs order_by")
        out = ordering.fill(df, gaps, order_by, names(config.get("partition_by")),
                            forward=method == "forward_fill")
    elif method == "knn":
        out = df
        numeric = [c for c in df.columns if is_numeric(df.schema[c].dataType)]
        for c in gaps:
            if c in numeric and len(numeric) > 1:
                out = fill_from_neighbours(out, c, [n for n in numeric if n != c],
                                           int(config.get("n_neighbors", 5)))
            else:
                out = _project(out, {c: _filled(out, c, _replacement(out, [c], "median").get(c))})
    else:
        if method == "constant":
            given = config.get("fill_value", config.get("constant"))
            chosen = {c: given if given is not None
                      else (0 if is_numeric(df.schema[c].dataType) else "unknown") for c in gaps}
        else:
            chosen = _replacement(df, gaps, "mode" if method == "most_frequent" else method)
        out = _project(df, {c: _filled(df, c, chosen.get(c)) for c in gaps})

    def measure() -> dict:
        after = missing_counts(out, targets)
        filled = sum(before.values()) - sum(after.values())
        return {"rows_affected": filled,
                "details": {c: {"before": before[c], "after": after[c]} for c in targets},
                "message": f"Imputed {filled} missing values across {len(targets)} columns using {method}"}

    return TransformResult(out, columns_affected=targets, measure=measure)


def _project(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else col(c) for c in df.columns])
