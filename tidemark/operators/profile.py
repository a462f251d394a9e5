"""Column types and profiles: one aggregation for moments, one shuffle for distinct values, and the
quantile search. Only one row per column comes to the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import dates
from ..functions.columns import (FALSE_TOKENS, TRUE_TOKENS, as_double, as_number, col,
                                 is_missing, is_numeric, value)
from . import quantiles, values


def detect_types(df: DataFrame) -> dict[str, str]:
    """Meaning of each column from its values: string, boolean, integer, float or datetime."""
    tokens = TRUE_TOKENS + FALSE_TOKENS
    exprs = []
    for i, c in enumerate(df.columns):
        text = F.lower(F.regexp_replace(value(df, c).cast("string"), r"(?U)^\s+|\s+\z", ""))
        number = as_number(df, c)
        exprs += [F.count(value(df, c)).alias(f"n{i}"), F.count_if(text.isin(tokens)).alias(f"b{i}"),
                  F.count(number).alias(f"x{i}"),
                  F.count_if(number == F.floor(number.cast("double"))).alias(f"w{i}"),
                  F.count(dates.as_timestamp(df, c)).alias(f"d{i}")]
    row = df.agg(*exprs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            out[c] = "string"
        elif row[f"b{i}"] == n:
            out[c] = "boolean"
        elif row[f"x{i}"] == n:
            out[c] = "integer" if row[f"w{i}"] == n else "float"
        elif row[f"d{i}"] > 0.8 * n:
            out[c] = "datetime"
        else:
            out[c] = "string"
    return out


def corrected_skew(g1: float | None, n: int) -> float | None:
    """Sample skewness from the population one, as data frames report it; 0 for a constant column."""
    if n < 3:
        return None
    if g1 is None or math.isnan(g1):
        return 0.0
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurtosis(g2: float | None, n: int) -> float | None:
    if n < 4:
        return None
    if g2 is None or math.isnan(g2):
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def moments(df: DataFrame, columns: list[str] | None = None, shape: bool = True) -> tuple[int, dict[str, dict]]:
    """(row count, per column: nulls, n and for numbers min, max, mean, std) in one job; with `shape` also
    skew and kurtosis."""
    columns = df.columns if columns is None else columns
    exprs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        exprs.append(F.count_if(is_missing(df, c)).alias(f"nulls{i}"))
        if is_numeric(df.schema[c].dataType):
            x = as_double(df, c)
            exprs += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"),
                      F.stddev_samp(x).alias(f"std{i}")]
            if shape:
                exprs += [F.skewness(x).alias(f"skew{i}"), F.kurtosis(x).alias(f"kurt{i}")]
    row = df.agg(*exprs).first()
    out = {}
    for i, c in enumerate(columns):
        n = row["rows"] - row[f"nulls{i}"]
        stats = {"nulls": row[f"nulls{i}"], "n": n, "numeric": is_numeric(df.schema[c].dataType)}
        if stats["numeric"]:
            stats |= {k: row[f"{k}{i}"] for k in ("min", "max", "mean", "std")}
            if shape:
                stats["skew"] = corrected_skew(row[f"skew{i}"], n)
                stats["kurtosis"] = corrected_kurtosis(row[f"kurt{i}"], n)
        out[c] = stats
    return row["rows"], out


def measure(df: DataFrame) -> tuple[int, dict[str, dict]]:
    """Counts, moments, distinct values and quartiles of every column."""
    rows, stats = moments(df, shape=False)
    for c, (d, _) in values.distinct_map(df, df.columns).items():
        stats[c]["distinct"] = d
    numeric = {c: as_double(df, c) for c, s in stats.items() if s["numeric"]}
    found = quantiles.quantiles(df, numeric, [0.25, 0.5, 0.75], {c: stats[c]["n"] for c in numeric})
    for c, (q1, q2, q3) in found.items():
        stats[c] |= {"q1": q1, "median": q2, "q3": q3}
    return rows, stats


def percent(part: int, whole: int, digits: int = 2) -> float:
    return round(part / whole * 100, digits) if whole else 0.0


def rounded(x: float | None, digits: int) -> float | None:
    return None if x is None else round(x, digits)


def ingest_profile(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Profile taken at load time, by detected type. `distinct_count` counts values occurring once."""
    types = types or detect_types(df)
    numeric = [c for c in df.columns if types[c] in ("integer", "float")]
    strings = [c for c in df.columns if types[c] == "string"]
    exprs = [F.count("*").alias("rows")]
    exprs += [F.count_if(is_missing(df, c)).alias(f"nulls{i}") for i, c in enumerate(df.columns)]
    for i, c in enumerate(numeric):
        x = as_double(df, c)
        exprs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                  F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}")]
    for i, c in enumerate(strings):
        size = F.length(value(df, c).cast("string"))
        exprs += [F.min(size).alias(f"short{i}"), F.max(size).alias(f"long{i}")]
    row = df.agg(*exprs).first()
    medians = quantiles.quantiles(df, {c: as_double(df, c) for c in numeric}, [0.5],
                                  {c: row[f"n{i}"] for i, c in enumerate(numeric)})
    seen = values.distinct_map(df, df.columns)
    out = []
    for j, c in enumerate(df.columns):
        line = {"column": c, "type": types[c], "null_count": row[f"nulls{j}"],
                "null_percent": percent(row[f"nulls{j}"], row["rows"]),
                "unique_count": seen[c][0], "distinct_count": seen[c][1]}
        if c in numeric and row[f"n{numeric.index(c)}"]:
            i = numeric.index(c)
            line |= {"min": row[f"min{i}"], "max": row[f"max{i}"], "mean": rounded(row[f"mean{i}"], 2),
                     "median": rounded(medians[c][0], 2), "stddev": rounded(row[f"std{i}"], 2) or 0.0}
        if c in strings:
            i = strings.index(c)
            line |= {"min_length": row[f"short{i}"], "max_length": row[f"long{i}"]}
        out.append(line)
    return df.sparkSession.createDataFrame(out, (
        "column string, type string, null_count bigint, null_percent double, unique_count bigint, "
        "distinct_count bigint, min double, max double, mean double, median double, stddev double, "
        "min_length int, max_length int"))


def data_profile(df: DataFrame, k: int = 5) -> DataFrame:
    """dtype, missing share, distinct count, number statistics (4 places) or the k commonest values."""
    rows, stats = measure(df)
    out = [{"column": c, "dtype": df.schema[c].dataType.simpleString(), "null_count": s["nulls"],
            "null_percent": percent(s["nulls"], rows), "unique_count": s["distinct"], "non_null": s["n"],
            "min": s.get("min"), "max": s.get("max"), "mean": rounded(s.get("mean"), 4),
            "median": s.get("median"),
            "std": (rounded(s["std"], 4) or 0.0) if s["numeric"] and s["n"] else None}
           for c, s in stats.items()]
    table = df.sparkSession.createDataFrame(out, (
        "column string, dtype string, null_count bigint, null_percent double, unique_count bigint, "
        "non_null bigint, min double, max double, mean double, median double, std double"))
    others = [c for c, s in stats.items() if not s["numeric"]]
    if not others:
        return table.withColumn("top_values", F.lit(None).cast("array<struct<value:string,n:bigint>>"))
    return table.join(top_lists(df, others, k), "column", "left")


def top_lists(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """At most k values per column, in order."""
    top = values.commonest(df, columns, k)
    listed = top.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("position", "value", "n"))).alias("l"))
    return listed.select("column", F.transform("l", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
                         .alias("top_values"))


def snapshot_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics of columns for a before/after comparison."""
    part = df.select(*[col(c) for c in columns])
    rows, stats = measure(part)
    out = [{"column": c, "total_count": rows, "null_count": s["nulls"], "null_pct": percent(s["nulls"], rows),
            "unique_count": s["distinct"], "min": s.get("min"), "max": s.get("max"), "mean": s.get("mean"),
            "median": s.get("median"), "std": (s["std"] or 0.0) if s["numeric"] and s["n"] else None,
            "q25": s.get("q1"), "q75": s.get("q3")} for c, s in stats.items()]
    table = df.sparkSession.createDataFrame(out, (
        "column string, total_count bigint, null_count bigint, null_pct double, unique_count bigint, "
        "min double, max double, mean double, median double, std double, q25 double, q75 double"))
    others = [c for c, s in stats.items() if not s["numeric"]]
    if not others:
        return table.withColumn("top_values", F.lit(None).cast("array<struct<value:string,n:bigint>>"))
    return table.join(top_lists(part, others, 5), "column", "left")
