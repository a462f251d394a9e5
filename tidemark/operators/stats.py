"""Statistical tests. Spark reduces the table to a few sums; the p-value is worked out from those.

Every test returns a dict with `success`; a test that cannot run says why in `error`.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import as_double, correlation, numeric_columns, value
from ..functions.distributions import (chi2_upper, f_upper, kolmogorov_upper, normal_two_sided, rank_sum_upper, t_two_sided)
from ..sources.scratch import settle
from . import ordering, quantiles
from .lookup import lookup
from .profile import corrected_kurtosis, corrected_skew


class TestError(ValueError):
    """The table or the configuration does not fit the test."""

    __test__ = False


def _kept(p: float, alpha: float) -> str:
    return f"{'rejected' if p < alpha else 'not rejected'} at {alpha:g}, p = {p:.4f}"


def _first(config: dict) -> str:
    return config.get("column1", config.get("column", ""))


def _need(df: DataFrame, *columns: str, why: str) -> None:
    if not all(columns) or any(c not in df.columns for c in columns):
        raise TestError(why)


def _two_samples(df: DataFrame, config: dict, strict: bool) -> DataFrame:
    """Rows (g, x): the two groups of a column, or two columns one under the other."""
    c1, c2, g = _first(config), config.get("column2", ""), config.get("group_column", "")
    if g and c1:
        _need(df, c1, g, why="column or group_column is not in the table")
        names = [r["g"] for r in df.select(value(df, g).alias("g")).distinct().orderBy("g").limit(3).collect()]
        if strict and len(names) != 2:
            raise TestError("the group column needs two values, no more")
        names = [n for n in names if n is not None]
        if len(names) < 2:
            raise TestError("the group column has fewer than two values")
        one = F.when(value(df, g) == F.lit(names[0]), 1).when(value(df, g) == F.lit(names[1]), 2)
        return df.select(one.alias("g"), as_double(df, c1).alias("x")).where("g is not null and x is not null")
    _need(df, c1, c2, why="name column1 and column2, or column and group_column")
    both = F.explode(F.array(F.struct(F.lit(1).alias("g"), as_double(df, c1).alias("x")),
                             F.struct(F.lit(2).alias("g"), as_double(df, c2).alias("x"))))
    return df.select(both.alias("s")).select("s.*").where("x is not null")


def t_test(df: DataFrame, config: dict) -> dict:
    """Two samples with equal variances."""
    alpha = config.get("alpha", 0.05)
    rows = {r["g"]: r for r in _two_samples(df, config, True).groupBy("g").agg(
        F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v")).collect()}
    if len(rows) < 2 or rows[1]["n"] + rows[2]["n"] < 3:
        raise TestError("one of the samples is empty or too small")
    (n1, m1, v1), (n2, m2, v2) = ((rows[g]["n"], rows[g]["m"], rows[g]["v"] or 0.0) for g in (1, 2))
    dof = n1 + n2 - 2
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
    if pooled == 0:
        raise TestError("neither sample varies")
    t = (m1 - m2) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    p = t_two_sided(t, dof)
    return {"statistic": round(t, 6), "p_value": round(p, 6), "significant": p < alpha, "alpha": alpha,
            "group1_mean": round(m1, 4), "group2_mean": round(m2, 4), "group1_n": n1, "group2_n": n2,
            "conclusion": f"equal means {_kept(p, alpha)}"}


def chi_square(df: DataFrame, config: dict) -> dict:
    """Independence of two columns; Yates' correction for a 2 x 2 table."""
    a, b, alpha = _first(config), config.get("column2", ""), config.get("alpha", 0.05)
    _need(df, a, b, why="name two columns: column1, column2")
    cells = settle(df.select(value(df, a).alias("a"), value(df, b).alias("b")).dropna().groupBy("a", "b")
                   .agg(F.count("*").cast("double").alias("o")))
    by_a = cells.groupBy("a").agg(F.count("*").alias("n"), F.sum("o").alias("ra"))
    by_b = cells.groupBy("b").agg(F.count("*").alias("n"), F.sum("o").alias("cb"))
    sizes = cells.agg(F.count_distinct("a"), F.count_distinct("b"), F.count("*"), F.sum("o")).first()
    rows, columns, filled, total = sizes
    if not total:
        raise TestError("no row has both values")
    dof = (rows - 1) * (columns - 1)
    if dof == 0:
        stat = 0.0
    else:
        e = F.col("ra") * F.col("cb") / F.lit(total)
        joined = lookup(lookup(cells, "a", by_a, ["ra"]), "b", by_b, ["cb"]).withColumn("e", e)
        gap = F.abs(F.col("o") - F.col("e"))
        if dof == 1:
            gap = gap - F.least(F.lit(0.5), gap)
        seen, mass = joined.agg(F.sum(gap * gap / F.col("e")), F.sum("e")).first()
        if filled < rows * columns and dof == 1:
            stat = seen + _empty_yates(joined, total)
        else:
            stat = seen + (total - mass if filled < rows * columns else 0.0)
    p = chi2_upper(stat, dof) if dof else 1.0
    return {"statistic": round(stat, 4), "p_value": round(p, 6), "degrees_of_freedom": dof, "significant": p < alpha,
            "conclusion": f"independence {_kept(p, alpha)}"}


def _empty_yates(joined: DataFrame, total: float) -> float:
    """Share of the empty cells of a 2 x 2 table in the corrected statistic."""
    got = {(r["a"], r["b"]): r for r in joined.collect()}   # at most four cells
    ra = {a: r["ra"] for (a, _), r in got.items()}
    cb = {b: r["cb"] for (_, b), r in got.items()}
    out = 0.0
    for a in ra:
        for b in cb:
            if (a, b) not in got:
                e = ra[a] * cb[b] / total
                out += (e - min(0.5, e)) ** 2 / e
    return out


def anova(df: DataFrame, config: dict) -> dict:
    """One-way analysis of variance."""
    x, g = config.get("value_column", config.get("column", "")), config.get("group_column", "")
    alpha = config.get("alpha", 0.05)
    _need(df, x, g, why="name value_column and group_column")
    groups = df.select(value(df, g).alias("g"), as_double(df, x).alias("x")).dropna().groupBy("g").agg(
        F.count("*").cast("double").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    k, n, total = groups.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("m"))).first()
    if k < 2:
        raise TestError("fewer than two groups")
    grand = total / n
    between, within = groups.agg(F.sum(F.col("n") * (F.col("m") - F.lit(grand)) ** 2),
                                 F.sum(F.col("n") * F.col("v"))).first()
    if not within:
        raise TestError("no group varies")
    f = (between / (k - 1)) / (within / (n - k))
    p = f_upper(f, k - 1, n - k)
    return {"statistic": round(f, 4), "p_value": round(p, 6), "significant": p < alpha, "num_groups": k,
            "conclusion": f"equal group means {_kept(p, alpha)}"}


@F.pandas_udf(T.DoubleType())
def _normal(x: pd.Series) -> pd.Series:
    """The normal distribution function, which Spark has no expression for; asked once for each different value."""
    return x.map(lambda v: math.erfc(-v / math.sqrt(2)) / 2)


# Distribution functions of the standard forms, by name.
CDFS = {
    "norm": _normal,
    "uniform": lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)),
    "expon": lambda x: F.when(x > 0, 1 - F.exp(-x)).otherwise(0.0),
    "logistic": lambda x: 1 / (1 + F.exp(-x)),
    "cauchy": lambda x: F.atan(x) / math.pi + 0.5,
    "laplace": lambda x: F.when(x < 0, F.exp(x) / 2).otherwise(1 - F.exp(-x) / 2),
}


def ks_test(df: DataFrame, config: dict) -> dict:
    """One sample against a named standard distribution (not fitted to the data)."""
    c, name, alpha = _first(config), config.get("distribution", "norm"), config.get("alpha", 0.05)
    c = config.get("column", c)
    _need(df, c, why="name a column of the table")
    data = df.select(as_double(df, c).alias("x")).where("x is not null")
    n = data.count()
    if n < 3:
        raise TestError("fewer than three values")
    if name not in CDFS:
        raise TestError(f"no distribution is called {name!r}")
    counts = data.groupBy("x").agg(F.count("*").alias("n"))
    steps = ordering.running_sum(counts, "n", ["x"], out="upto")
    cdf = CDFS[name](F.col("x"))
    up = F.col("upto") / F.lit(n) - cdf
    down = cdf - (F.col("upto") - F.col("n")) / F.lit(n)
    d = steps.agg(F.max(F.greatest(up, down))).first()[0]
    p = kolmogorov_upper(d, n)
    return {"statistic": round(d, 6), "p_value": round(p, 6), "distribution": name, "significant": p < alpha,
            "conclusion": f"the standard {name} law {_kept(p, alpha)}"}


def mann_whitney(df: DataFrame, config: dict) -> dict:
    """U of the first sample, two-sided. Ranks are given to distinct values, with the middle rank for ties."""
    alpha = config.get("alpha", 0.05)
    counts = _two_samples(df, config, False).groupBy("x").agg(
        F.count_if(F.col("g") == 1).alias("n1"), F.count("*").alias("n"))
    ranked = ordering.running_sum(counts, "n", ["x"], out="upto")
    middle = F.col("upto") - (F.col("n") - 1) / 2
    size = F.col("n").cast("double")
    n1, n, r1, ties = ranked.agg(F.sum("n1"), F.sum("n"), F.sum(F.col("n1") * middle),
                                 F.sum(size * size * size - size)).first()
    if not n or not n1 or n1 == n:
        raise TestError("one of the samples is empty or too small")
    n2 = n - n1
    u1 = r1 - n1 * (n1 + 1) / 2
    u = max(u1, n1 * n2 - u1)
    if ties == 0 and min(n1, n2) <= 8:
        p = min(1.0, 2 * rank_sum_upper(n1, n2, int(u)))
    else:
        spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        p = 1.0 if spread == 0 else min(1.0, normal_two_sided(max(0.0, (u - n1 * n2 / 2 - 0.5) / spread)))
    return {"statistic": round(u1, 4), "p_value": round(p, 6), "significant": p < alpha,
            "conclusion": f"equal ranks {_kept(p, alpha)}"}


def _correlation_result(r: float | None, n: int) -> dict:
    if r is None or math.isnan(r) or n < 3:
        raise TestError("no correlation: too few rows or a constant column")
    r = max(-1.0, min(1.0, r))
    t = math.inf if abs(r) == 1 else r * math.sqrt((n - 2) / (1 - r * r))
    p = t_two_sided(t, n - 2)
    return {"correlation": round(r, 6), "p_value": round(p, 6), "significant": p < 0.05, "n": n}


def pearson(df: DataFrame, config: dict) -> dict:
    a, b = _first(config), config.get("column2", "")
    _need(df, a, b, why="name two columns: column1, column2")
    x, y = as_double(df, a), as_double(df, b)
    r, n = df.agg(correlation(x, y), F.count_if(x.isNotNull() & y.isNotNull())).first()
    out = _correlation_result(r, n)
    size = abs(out["correlation"])
    labels = [("very_strong", 0.9), ("strong", 0.7), ("moderate", 0.5), ("weak", 0.3)]
    out["strength"] = next((name for name, bound in labels if size > bound), "very_weak")
    out["direction"] = "positive" if out["correlation"] > 0 else "negative"
    return out


def spearman(df: DataFrame, config: dict) -> dict:
    """Rank correlation. Ranks belong to distinct values; pairs are counted before they are looked up."""
    a, b = _first(config), config.get("column2", "")
    _need(df, a, b, why="name two columns: column1, column2")
    pairs = settle(df.select(as_double(df, a).alias("a"), as_double(df, b).alias("b")).dropna()
                   .groupBy("a", "b").agg(F.count("*").alias("w")))
    ranked = pairs
    for c in ("a", "b"):
        sizes = pairs.groupBy(c).agg(F.sum("w").alias("size"), F.count("*").alias("n"))
        steps = ordering.running_sum(sizes, "size", [c], out="upto")
        ranks = steps.select(c, "n", (F.col("upto") - (F.col("size") - 1) / 2).alias(f"rank_{c}"))
        ranked = lookup(ranked, c, ranks, [f"rank_{c}"])
    n = pairs.agg(F.sum("w")).first()[0] or 0
    da, db = F.col("rank_a") - F.lit((n + 1) / 2), F.col("rank_b") - F.lit((n + 1) / 2)
    ab, aa, bb = ranked.agg(*[F.sum(F.col("w") * e) for e in (da * db, da * da, db * db)]).first()
    return _correlation_result(ab / math.sqrt(aa * bb) if aa and bb else None, n)


def normality(df: DataFrame, config: dict) -> dict:
    """Jarque-Bera over all rows, with skewness and excess kurtosis."""
    c, alpha = config.get("column", _first(config)), config.get("alpha", 0.05)
    _need(df, c, why="name a column of the table")
    x = as_double(df, c)
    n, g1, g2 = df.agg(F.count(x), F.skewness(x), F.kurtosis(x)).first()
    if n < 3:
        raise TestError("fewer than three values")
    g1, g2 = (0.0 if v is None or math.isnan(v) else v for v in (g1, g2))
    jb = n / 6 * (g1 * g1 + g2 * g2 / 4)
    p = math.exp(-jb / 2)
    return {"statistic": round(jb, 6), "p_value": round(p, 6), "is_normal": p > alpha, "alpha": alpha,
            "skewness": round(corrected_skew(g1, n), 4), "kurtosis": round(corrected_kurtosis(g2, n) or 0.0, 4),
            "conclusion": f"normality {_kept(p, alpha)}"}


TESTS = {
    "t_test": (t_test, "Independent Samples T-Test", "Compare means of two groups"),
    "chi_square": (chi_square, "Chi-Square Test", "Test independence of categorical variables"),
    "anova": (anova, "One-Way ANOVA", "Compare means across multiple groups"),
    "ks_test": (ks_test, "Kolmogorov-Smirnov Test", "Test if data follows a distribution"),
    "mann_whitney": (mann_whitney, "Mann-Whitney U Test", "Non-parametric comparison of two groups"),
    "pearson": (pearson, "Pearson Correlation", "Linear correlation between two numeric variables"),
    "spearman": (spearman, "Spearman Correlation", "Rank correlation between two variables"),
    "normality": (normality, "Normality Test", "Test if data is normally distributed"),
}


def list_tests() -> list[dict]:
    return [{"type": t, "name": n, "description": d} for t, (_, n, d) in TESTS.items()]


def run_test(test_type: str, df: DataFrame, config: dict) -> dict:
    if test_type not in TESTS:
        return {"success": False, "error": f"Unknown test: {test_type}. Available: {list(TESTS)}"}
    try:
        return {"success": True, "test_type": test_type, **TESTS[test_type][0](df, config)}
    except TestError as e:
        return {"success": False, "test_type": test_type, "error": str(e)}


def test_frame(test_type: str, df: DataFrame, config: dict) -> DataFrame:
    """The result as one row; its columns are the numbers and labels of the test."""
    r = run_test(test_type, df, config)
    names = {float: "double", int: "bigint", bool: "boolean", str: "string"}
    schema = ", ".join(f"{k} {names[type(v)]}" for k, v in r.items())
    return df.sparkSession.createDataFrame([tuple(r.values())], schema)


test_frame.__test__ = False


def describe(df: DataFrame, limit: int | None = None) -> DataFrame:
    """mean, std, min, max and median of the numeric columns, of the first `limit` where that is given."""
    columns = numeric_columns(df)[:limit]
    row = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.count(as_double(df, c)).alias(f"n{i}"), F.avg(as_double(df, c)).alias(f"m{i}"),
        F.stddev_samp(as_double(df, c)).alias(f"s{i}"), F.min(as_double(df, c)).alias(f"lo{i}"),
        F.max(as_double(df, c)).alias(f"hi{i}"))]).first() if columns else None
    halves = quantiles.quantiles(df, {c: as_double(df, c) for c in columns}, [0.5],
                                 {c: row[f"n{i}"] for i, c in enumerate(columns)})
    rows = [(c, row[f"m{i}"], row[f"s{i}"], row[f"lo{i}"], row[f"hi{i}"], halves[c][0]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(
        rows, "column string, mean double, std double, min double, max double, median double")


def anomaly_tests(results: DataFrame, limit: int = 100) -> DataFrame:
    """Stored test results whose type mentions anomaly, newest first."""
    return results.where(F.lower(F.col("test_type")).contains("anomaly")) \
        .orderBy(F.desc("created_at"), "id").limit(limit)
