"""Exploratory analysis: sections share measurements of the table, each taken once and when first needed."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_double, datetime_columns, numeric_columns, text_columns
from . import profile, quantiles, values


@dataclass
class Exploration:
    """Lazily measured facts about a table; each fact is computed once, by the fewest jobs."""

    df: DataFrame
    name: str = ""

    @cached_property
    def _moments(self) -> tuple[int, dict]:
        return profile.moments(self.df)

    @property
    def rows(self) -> int:
        return self._moments[0]

    @property
    def stats(self) -> dict[str, dict]:
        """Counts and moments per column."""
        return self._moments[1]

    @cached_property
    def distinct(self) -> dict[str, int]:
        return {c: d for c, (d, _) in values.distinct_map(self.df, self.df.columns).items()}

    @cached_property
    def quartiles(self) -> dict[str, tuple]:
        wanted = {c: as_double(self.df, c) for c in self.numeric}
        return quantiles.quantiles(self.df, wanted, [0.25, 0.5, 0.75], {c: self.stats[c]["n"] for c in wanted})

    @cached_property
    def numeric(self) -> list[str]:
        return numeric_columns(self.df)

    @cached_property
    def text(self) -> list[str]:
        return text_columns(self.df)

    @cached_property
    def duplicates(self) -> int:
        return values.duplicate_rows(self.df)

    @cached_property
    def pairs(self) -> dict[tuple[str, str], float | None]:
        return correlations(self.df, self.numeric)

    @cached_property
    def outliers(self) -> dict[str, dict]:
        return count_outliers(self.df, self.stats, self.quartiles)

    @property
    def missing(self) -> int:
        return sum(s["nulls"] for s in self.stats.values())

    def frame(self, rows: list, schema: str) -> DataFrame:
        return self.df.sparkSession.createDataFrame(rows, schema)


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair over rows where both are present; null where one of them does not vary or a
    value is infinite. Every task adds up the sums of all pairs by matrix products, and the sums are merged per pair,
    so the plan does not grow with the pairs. Values are taken from the least of their column, against cancellation."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return {}
    numbers = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    least = numbers.agg(*[F.min(F.when(F.abs(c) < float("inf"), F.col(c))).alias(c) for c in numbers.columns]).first()
    start = np.array([0.0 if v is None or math.isnan(v) else v for v in least])
    first, second = (np.array(side) for side in zip(*combinations(range(len(columns)), 2)))
    names = ["pair", "n", "x", "y", "xx", "yy", "xy", "infinite"]

    def add(batches):
        total = None
        for batch in batches:
            got = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            odd, there = np.isinf(got).astype(float), np.isfinite(got)
            v, m = np.where(there, got - start, 0.0), there.astype(float)
            sums, squares, seen = v.T @ m, (v * v).T @ m, m + odd
            part = np.stack([(m.T @ m)[first, second], sums[first, second], sums[second, first], squares[first, second],
                             squares[second, first], (v.T @ v)[first, second], (odd.T @ seen + seen.T @ odd)[first, second]])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(first))), *map(pa.array, total)], names=names)

    merged = numbers.mapInArrow(add, "pair long, " + ", ".join(f"{n} double" for n in names[1:])) \
        .groupBy("pair").agg(*[F.sum(n).alias(n) for n in names[1:]])
    found: dict[tuple[str, str], float | None] = dict.fromkeys(pairs)
    for r in merged.collect():
        if r["n"] and not r["infinite"]:
            vx, vy = r["xx"] - r["x"] ** 2 / r["n"], r["yy"] - r["y"] ** 2 / r["n"]
            if vx > 1e-12 * r["xx"] and vy > 1e-12 * r["yy"]:
                found[pairs[r["pair"]]] = (r["xy"] - r["x"] * r["y"] / r["n"]) / math.sqrt(vx) / math.sqrt(vy)
    return found


def count_outliers(df: DataFrame, stats: dict[str, dict], quartiles: dict[str, tuple]) -> dict[str, dict]:
    """IQR (1.5) and z-score (3) outliers per numeric column with at least 3 values: one job."""
    usable = {c: s for c, s in stats.items() if s["numeric"] and s["n"] >= 3}
    exprs, fences = [], {}
    for i, (c, s) in enumerate(usable.items()):
        q1, _, q3 = quartiles[c]
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        fences[c] = (low, high)
        x = as_double(df, c)
        far = F.abs(x - F.lit(s["mean"])) / F.lit(s["std"]) > 3 if s["std"] else F.lit(False)
        exprs += [F.count_if((x < F.lit(low)) | (x > F.lit(high))).alias(f"i{i}"), F.count_if(far).alias(f"z{i}")]
    if not exprs:
        return {}
    row = df.agg(*exprs).first()
    return {c: {"n": s["n"], "iqr": row[f"i{i}"], "z": row[f"z{i}"], "low": fences[c][0], "high": fences[c][1]}
            for i, (c, s) in enumerate(usable.items())}


def overview(x: Exploration) -> DataFrame:
    cells = x.rows * len(x.df.columns)
    return x.frame([(x.rows, len(x.df.columns), len(x.numeric), len(x.text), len(datetime_columns(x.df)),
                     x.duplicates, profile.percent(x.duplicates, x.rows), x.missing,
                     profile.percent(x.missing, cells))],
                   "rows bigint, columns bigint, numeric_columns bigint, categorical_columns bigint, "
                   "datetime_columns bigint, duplicate_rows bigint, duplicate_pct double, "
                   "total_missing bigint, total_missing_pct double")


def distribution_hint(skew: float, kurtosis: float) -> str:
    if abs(skew) < 0.5 and abs(kurtosis) < 1:
        return "approximately_normal"
    if skew > 1:
        return "right_skewed"
    if skew < -1:
        return "left_skewed"
    return "moderately_skewed"


def column_profiles(x: Exploration, k: int = 10) -> DataFrame:
    """One row per column; `top_values` for columns that are not numeric."""
    rows = []
    for c, s in x.stats.items():
        distinct = x.distinct[c]
        line = {"column": c, "dtype": x.df.schema[c].dataType.simpleString(), "null_count": s["nulls"],
                "null_pct": profile.percent(s["nulls"], x.rows), "unique_count": distinct,
                "unique_pct": profile.percent(distinct, s["n"])}
        if s["numeric"] and s["n"]:
            skew, kurt = round(s["skew"] or 0.0, 4), round(s["kurtosis"] or 0.0, 4)
            q1, median, q3 = x.quartiles[c]
            line |= {"min": s["min"], "max": s["max"], "mean": round(s["mean"], 4), "median": median,
                     "std": profile.rounded(s["std"], 4) or 0.0, "skewness": skew, "kurtosis": kurt,
                     "q1": q1, "q3": q3, "iqr": q3 - q1,
                     "distribution_hint": distribution_hint(skew, kurt)}
        elif not s["numeric"]:
            line["is_categorical"] = bool(s["n"]) and distinct / s["n"] < 0.05
        rows.append(line)
    table = x.frame(rows, "column string, dtype string, null_count bigint, null_pct double, unique_count bigint, "
                          "unique_pct double, min double, max double, mean double, median double, std double, "
                          "skewness double, kurtosis double, q1 double, q3 double, iqr double, "
                          "distribution_hint string, is_categorical boolean")
    others = [c for c, s in x.stats.items() if not s["numeric"]]
    if not others:
        return table.withColumn("top_values", F.lit(None).cast("array<struct<value:string,n:bigint>>"))
    return table.join(profile.top_lists(x.df, others, k), "column", "left")


def correlation_pairs(x: Exploration) -> DataFrame:
    """Tall matrix: one row per pair of numeric columns."""
    return x.frame([(a, b, profile.rounded(r, 4)) for (a, b), r in x.pairs.items()],
                   "col1 string, col2 string, correlation double")


def correlation_matrix(x: Exploration) -> DataFrame:
    """Wide matrix: a row and a column per numeric column."""
    cols = x.numeric
    def cell(a: str, b: str) -> float | None:
        if a == b:
            return 1.0 if x.stats[a]["std"] else None
        return profile.rounded(x.pairs.get((a, b), x.pairs.get((b, a))), 4)
    schema = "column string, " + ", ".join(f"`{c}` double" for c in cols)
    return x.frame([(a, *[cell(a, b) for b in cols]) for a in cols], schema)


def strong_correlations(x: Exploration, over: float = 0.7) -> DataFrame:
    pairs = correlation_pairs(x).where(F.abs("correlation") > over)
    return pairs.withColumn("strength", F.when(F.col("correlation") > 0, "strong_positive").otherwise("strong_negative"))


def moderate_correlations(x: Exploration, over: float = 0.3) -> DataFrame:
    """Pairs over the bound, strongest first."""
    return correlation_pairs(x).where(F.abs("correlation") > over).orderBy(F.desc(F.abs("correlation")), "col1", "col2")


def missing_analysis(x: Exploration) -> DataFrame:
    return x.frame([(c, s["nulls"], profile.percent(s["nulls"], x.rows)) for c, s in x.stats.items() if s["nulls"]],
                   "column string, count bigint, percent double")


def histogram(x: Exploration) -> DataFrame:
    """Equal-width bins, the last one closed: min(20, n // 5 + 1) per numeric column of at least 3 values.

    All columns are binned in one job; empty bins are kept.
    """
    df, cells, frame = x.df, [], []
    for c, s in x.stats.items():
        if not s["numeric"] or s["n"] < 3:
            continue
        k = min(20, s["n"] // 5 + 1)
        low, high = (s["min"], s["max"]) if s["max"] > s["min"] else (s["min"] - 0.5, s["max"] + 0.5)
        v = as_double(df, c)
        slot = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * k), F.lit(k - 1)).cast("int")
        cells.append(F.when(v.isNotNull(), F.struct(F.lit(c).alias("column"), slot.alias("bin"))))
        step = (high - low) / k
        frame += [(c, b, round(low + b * step, 4), round(high if b == k - 1 else low + (b + 1) * step, 4))
                  for b in range(k)]
    bins = x.frame(frame, "column string, bin int, low double, high double")
    if not cells:
        return bins.withColumn("count", F.lit(0).cast("long"))
    counts = df.select(F.explode(F.array(*cells)).alias("b")).where("b is not null") \
        .groupBy("b.column", "b.bin").agg(F.count("*").alias("count"))
    return bins.join(counts, ["column", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def distributions(x: Exploration) -> DataFrame:
    """Shape of each numeric column of at least 3 values."""
    rows = []
    for c, s in x.stats.items():
        if s["numeric"] and s["n"] >= 3:
            skew, kurt = s["skew"] or 0.0, s["kurtosis"] or 0.0
            rows.append((c, round(skew, 4), round(kurt, 4), abs(skew) < 0.5 and abs(kurt) < 1))
    return x.frame(rows, "column string, skewness double, kurtosis double, is_normal boolean")


def outlier_summary(x: Exploration) -> DataFrame:
    rows = [(c, o["iqr"], profile.percent(o["iqr"], o["n"]), o["z"], profile.percent(o["z"], o["n"]),
             round(o["low"], 4), round(o["high"], 4)) for c, o in x.outliers.items()]
    return x.frame(rows, "column string, iqr_outliers bigint, iqr_pct double, zscore_outliers bigint, "
                         "zscore_pct double, lower_fence double, upper_fence double")


def insights(x: Exploration) -> DataFrame:
    """Findings with their category: missing over 20 %, duplicates over 5 %, text that is nearly all
    distinct, correlations over 0.9, and columns of one value."""
    found = []
    cells = x.rows * len(x.df.columns)
    gap = x.missing / cells * 100 if cells else 0
    if gap > 20:
        found.append(("warning", "data_quality", "", f"High missing data rate: {gap:.1f}% of all values are missing."))
    twin = x.duplicates / x.rows * 100 if x.rows else 0
    if twin > 5:
        found.append(("warning", "dedup", "", f"{twin:.1f}% duplicate rows detected."))
    for c in x.text:
        if x.rows and x.distinct[c] / x.rows * 100 > 90:
            found.append(("info", "cardinality", c, f"Column '{c}' has very high cardinality — likely an ID field."))
    for (a, b), r in x.pairs.items():
        if r is not None and abs(r) > 0.9:
            found.append(("warning", "multicollinearity", f"{a},{b}", f"Very high correlation between '{a}' and '{b}'."))
    for c in x.df.columns:
        if x.distinct[c] <= 1:
            found.append(("warning", "zero_variance", c, f"Column '{c}' has zero variance."))
    return x.frame(found, "type string, category string, column string, message string")


def warnings(x: Exploration) -> DataFrame:
    found = [("critical", "", "Dataset is empty")] if not x.rows else []
    found += [("critical", c, f"Column '{c}' is entirely null") for c, s in x.stats.items() if not s["n"]]
    return x.frame(found, "level string, column string, message string")


def report(df: DataFrame, name: str = "") -> dict[str, DataFrame]:
    """All sections of one table."""
    x = Exploration(df, name)
    return {"overview": overview(x), "column_profiles": column_profiles(x), "correlations": correlation_pairs(x),
            "high_correlations": strong_correlations(x), "missing_analysis": missing_analysis(x),
            "histograms": histogram(x), "distributions": distributions(x), "outlier_summary": outlier_summary(x),
            "insights": insights(x), "warnings": warnings(x)}
