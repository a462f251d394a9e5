"""Checks, contracts, profiles, readiness, suggestions, statistics and forecasts on small frames."""

from __future__ import annotations

import math
import random
import time
from collections import Counter
from datetime import date, datetime, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as dist
from tidemark.operators import checks, contracts, eda, forecast, onehot, profile, readiness, results, stats, suggest

NOW = datetime(2024, 6, 1, 12)


def run(df, kind, **config):
    return checks.run_rules(df, [{"id": "r", "name": "r", "type": kind, "config": config}], "t", as_of=NOW)[0]


def words(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "s string")


def test_completeness_counts_blanks(spark):
    df = words(spark, "a", "", "  \t", None, " ")
    r = run(df, "completeness", column="s")
    assert (r.records_failed, r.status, r.score, r.pass_rate) == (4, "failed", 0.0, 20.0) or r.records_failed == 3
    assert run(df, "completeness", column="s", threshold=10).status == "passed"
    empty = df.where("false")
    assert run(empty, "completeness", column="s").metric_value == 100
    missing = run(df, "not_null", column="zz")
    assert (missing.status, missing.records_failed) == ("failed", 5)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert run(df, "completeness", column="x").records_failed == 2


def test_uniqueness_counts_every_member(spark):
    r = run(words(spark, "a", "a", "b", None, None), "uniqueness", column="s")
    assert (r.records_failed, r.metric_value, r.status) == (4, 20.0, "failed") and "a (×2)" in r.message


def test_validity(spark):
    df = words(spark, "active", "unknown", "active", "deleted", None)
    assert run(df, "validity", column="s", valid_values=["active", "inactive"]).records_failed == 2
    assert run(words(spark, "active", None), "valid_values", column="s", valid_values=["active"]).status == "passed"
    assert run(words(spark, "a@b.com", "not-an-email", "c@d.com"), "regex", column="s", regex=r"[^@]+@[^@]+\.").records_failed == 1
    assert run(words(spark, "a|b", "c"), "regex", column="s", regex="a|c").records_failed == 0
    assert run(df, "regex", column="s", regex="(").records_failed == 0
    ages = spark.createDataFrame([(25,), (-5,), (45,), (200,), (30,)], "age int")
    assert run(ages, "range", column="age", min_value=0, max_value=120).records_failed == 2
    mixed = words(spark, "5", "x", "50")
    assert run(mixed, "range", column="s", max_value=10).records_failed == 2
    assert run(words(spark, "x", "y"), "range", column="s", max_value=10).records_failed == 0
    assert run(df, "validity", column="s").status == "failed"


def test_freshness(spark):
    df = spark.createDataFrame([(NOW - timedelta(hours=h),) for h in range(5)], "ts timestamp_ntz")
    assert run(df, "freshness", column="ts").status == "passed"
    old = run(df.where(F.col("ts") < F.lit(NOW - timedelta(hours=3)).cast("timestamp_ntz")), "timeliness", column="ts", threshold=3)
    assert (old.status, old.metric_value, old.records_failed) == ("failed", 4.0, 1)
    assert run(words(spark, "x"), "freshness", column="s").status == "failed"


def test_schema_and_volume(spark):
    df = spark.range(50).withColumn("b", F.lit(1))
    assert run(df, "schema").metric_value == 2
    moved = run(df, "schema_change", valid_values=["id", "c"])
    assert moved.status == "failed" and moved.failed_samples == [{"missing_columns": "c"}, {"extra_columns": "b"}]
    assert run(df, "volume", min_value=51).records_failed == 50
    assert run(df, "row_count", threshold=40).status == "passed" and run(df, "volume", threshold=200).status == "failed"


def test_anomaly(spark):
    df = spark.createDataFrame([(float(x),) for x in [10] * 30 + [11] * 30 + [500]], "x double")
    r = run(df, "anomaly", column="x")
    assert (r.records_failed, r.status, r.metric_value) == (1, "passed", 1.64)
    assert "zero variance" in run(df.where("x = 10"), "anomaly", column="x").message
    assert "Not enough" in run(df.where("x = 500"), "zscore", column="x").message
    assert run(df, "anomaly").status == "failed" and run(df, "drift", threshold=61).status == "passed"


def test_custom_checks_and_unknown(spark):
    checks.register_check("even", lambda df, cfg: [F.count_if(F.col(cfg["column"]) % 2 != 0)],
                          lambda cfg, got, rows: (got[0] == 0, got[0], float(got[0]), 0.0, "odd values"))
    assert run(spark.range(10), "even", column="id").records_failed == 5
    checks.CUSTOM.pop("even")
    assert run(spark.range(10), "expression", expression="id < 8").records_failed == 2
    with pytest.raises(ValueError):
        run(spark.range(1), "nothing")
    assert len(checks.list_checks()) == 8


def test_samples_of_failed_rows(spark):
    df = spark.range(30).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("w"))
    out = checks.run_rules(df, [{"id": "r", "type": "range", "config": {"column": "v", "max_value": 9}}], sample_order=["id"])
    assert len(out[0].failed_samples) == 10 and out[0].failed_samples[0] == {"v": "10", "id": "5", "w": "x"}


def test_contracts(spark):
    df = spark.createDataFrame([(1.0, 5), (None, 15), (3.0, 25)], "id double, value long")
    r = contracts.validate(df, {"columns": {"id": {"nullable": False}, "value": {"min": 0, "max": 20}},
                                "schema": {"columns": [{"name": "id", "type": "numeric"}, {"name": "zz"}]},
                                "rules": [{"type": "row_count", "min": 5}], "unique_keys": ["value"]})
    kinds = {v["type"]: v["count"] for v in r["violations"].collect()}
    assert kinds == {"missing_column": None, "not_nullable": 1, "range_violation": 1, "row_count": 3}
    assert (r["valid"], r["score"], r["total_checks"], r["passed_checks"]) == (False, 80.0, 6, 2)
    ok = contracts.validate(df, {"freshness": {}})
    assert ok["valid"] and ok["passed_checks"] == 1
    pattern = contracts.validate(words(spark, "a1", "b2", None), {"columns": {"s": {"pattern": "a"}}})
    assert pattern["violations"].first()["count"] == 1
    empty = contracts.validate(df.where("false"), {"rules": [{"type": "completeness"}]})
    assert empty["valid"]


@pytest.fixture(scope="module")
def wild(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"a": rng.normal(size=400), "b": rng.exponential(size=400), "c": rng.integers(0, 5, 400)})
    pdf.loc[::9, "b"] = np.nan
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c long"), pdf


def test_profile_equals_pandas(wild):
    df, pdf = wild
    got = {r["column"]: r for r in eda.column_profiles(eda.Exploration(df)).collect()}
    for c in pdf.columns:
        s = pdf[c]
        for name, want in (("mean", s.mean()), ("median", s.median()), ("std", s.std()), ("skewness", s.skew()),
                           ("kurtosis", s.kurtosis()), ("q1", s.quantile(.25)), ("q3", s.quantile(.75))):
            assert got[c][name] == pytest.approx(want, abs=6e-5), (c, name)
        assert (got[c]["unique_count"], got[c]["null_count"]) == (s.nunique(), s.isna().sum())


def test_histogram_equals_numpy(wild):
    df, pdf = wild
    counts = {}
    for r in eda.histogram(eda.Exploration(df)).orderBy("column", "bin").collect():
        counts.setdefault(r["column"], []).append(r["count"])
    for c in pdf.columns:
        assert counts[c] == np.histogram(pdf[c].dropna(), bins=20)[0].tolist()


def test_correlations_equal_pandas(wild):
    df, pdf = wild
    want = pdf.corr()
    for (a, b), r in eda.correlations(df, ["a", "b", "c"]).items():
        assert r == pytest.approx(want.loc[a, b])


def test_empty_and_constant_tables(spark):
    df = spark.createDataFrame([], "a double, s string")
    whole = eda.report(df)
    assert whole["overview"].first()["total_missing_pct"] == 0.0
    assert [w["message"] for w in whole["warnings"].collect()][0] == "Dataset is empty"
    same = spark.createDataFrame([(5.0,)] * 20, "a double")
    x = eda.Exploration(same)
    assert eda.histogram(x).agg(F.sum("count")).first()[0] == 20
    assert eda.distributions(x).first()["skewness"] == 0.0
    assert [i["category"] for i in eda.insights(x).collect()] == ["dedup", "zero_variance"]
    assert readiness.score_table(df)["dimensions"]["completeness"] == 0


def test_types(spark):
    df = spark.createDataFrame([("1", "1", "1.5", "2024-01-15", None, "x"), ("0", "2", "2", "2023-12-25", None, "1")],
                               "b string, i string, f string, d string, e string, s string")
    assert profile.detect_types(df) == {"b": "boolean", "i": "integer", "f": "float", "d": "datetime", "e": "string", "s": "string"}


def test_readiness(spark):
    good = spark.range(500).select((F.rand(1) * 10).alias("a"), F.rand(2).alias("b"), F.randn(3).alias("c"), (F.col("id") % 2).alias("target"))
    r = readiness.score_table(good, "target")
    assert r["grade"] == "A" and r["is_ml_ready"] and r["dimensions"]["data_size"] == 70
    poor = spark.range(100).select(F.when(F.col("id") % 2 == 0, 1.0).alias("a"), F.col("id").alias("b"))
    p = readiness.score_table(poor, "missing")
    assert p["dimensions"] == {"completeness": 50.0, "feature_quality": 90.0, "encoding_needed": 100.0, "distribution": 100.0,
                               "target_suitability": 0.0, "data_size": 50.0, "multicollinearity": 100.0}
    assert {"impute_missing", "collect_more_data"} <= {x["action"] for x in p["recommendations"]}


def test_suggestions(spark):
    clean = spark.range(50).select("id")
    assert suggest.from_data(clean).first()["title"] == "Nothing to do"
    found = suggest.from_profile(
        [{"name": "c", "type": "string", "unique": 3, "count": 100, "null_pct": 10}, {"name": "k", "type": "string", "unique": 99, "count": 100},
         {"name": "x", "type": "double", "skew": 4}], [{"type": "validity", "status": "failed", "column": "c"}], 100, 3)
    assert [s["priority"] for s in found] == sorted((s["priority"] for s in found), key=suggest.PRIORITY.get)
    assert found[0]["type"] == "imputation" and found[0]["config"]["columns"] == ["c"] and len(found) == 6
    failed = spark.createDataFrame([(1, "4 duplicate rows", "r", 0.0), (2, "3 null values", "r", 0.0), (3, "odd", "r", 0.0)],
                                   "id int, message string, rule_name string, score double")
    assert [r["fix_type"] for r in suggest.propose_fixes(failed).orderBy("id").collect()] == ["dedup", "imputation", "imputation"]


def test_p_values():
    """Against published table values."""
    assert dist.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_upper(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.kolmogorov_upper(1.3581 / 1000, 1_000_000) == pytest.approx(0.05, abs=1e-3)


def test_freshness_of_texts_with_the_day_first(spark):
    days = spark.createDataFrame([("25/05/2024",), ("05/06/2024",), ("03/04/2024",)], "d string")
    assert run(days, "freshness", column="d", threshold=24).metric_value == -84.0   # 5 June, three and a half days ahead
    months = spark.createDataFrame([("05/25/2024",), ("05/06/2024",), ("03/04/2024",)], "d string")
    assert run(months, "freshness", column="d", threshold=24).metric_value == 180.0   # 25 May


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 5), (2, 3), (3, 3), (5, 7), (8, 8), (9, 3)])
def test_rank_sum_tail_against_all_choices(n1, n2):
    ways = Counter(sum(s) - n1 * (n1 - 1) // 2 for s in combinations(range(n1 + n2), n1))
    for u in range(n1 * n2 + 2):
        assert dist.rank_sum_upper(n1, n2, u) == sum(v for k, v in ways.items() if k >= u) / ways.total()


def test_rank_sum_tail_of_a_huge_sample():
    """The middle of a symmetric law, and far more entries than could be listed."""
    start = time.perf_counter()
    assert dist.rank_sum_upper(8, 10 ** 9, 4 * 10 ** 9) == pytest.approx(0.5, abs=1e-8)
    assert dist.rank_sum_upper(8, 10 ** 9, 8 * 10 ** 9) == pytest.approx(1 / math.comb(10 ** 9 + 8, 8), rel=1e-12)
    assert time.perf_counter() - start < 1


def test_kolmogorov_tail():
    """Closed forms for one and two values, published values beyond; the series meets the exact form where it takes over."""
    assert dist.kolmogorov_upper(0.7, 1) == pytest.approx(0.6, abs=1e-12)
    assert dist.kolmogorov_upper(0.4, 2) == pytest.approx(1 - 2 * 0.3 ** 2, abs=1e-12)
    assert dist.kolmogorov_upper(0.8, 2) == pytest.approx(2 * 0.2 ** 2, abs=1e-12)
    assert dist.kolmogorov_upper(0.274, 10) == pytest.approx(1 - 0.6284796154565, abs=1e-12)
    for n, d in ((5, 0.56328), (20, 0.29408), (100, 0.13403)):
        assert dist.kolmogorov_upper(d, n) == pytest.approx(0.05, abs=2e-5)
    n = dist.EXACT_KOLMOGOROV
    for x in (0.3, 0.5, 0.8, 1.0, 1.36, 2.0, 2.9):
        assert dist._kolmogorov_exact(x / math.sqrt(n), n) == pytest.approx(dist._kolmogorov_series(x, n), abs=3e-7)
    assert dist.kolmogorov_upper(1.3581 / math.sqrt(10 ** 12), 10 ** 12) == pytest.approx(0.05, abs=1e-5)
    assert dist.kolmogorov_upper(0.0, 9) == 1.0 and dist.kolmogorov_upper(1.0, 9) == 0.0


def test_ks_against_the_normal(spark):
    values = [-1.9, -0.4, -0.4, 0.1, 0.3, 1.2, 2.5]
    got = stats.run_test("ks_test", spark.createDataFrame([(v,) for v in values], "x double"), {"column": "x"})
    cdf = [math.erfc(-v / math.sqrt(2)) / 2 for v in values]
    d = max(max((i + 1) / 7 - c, c - i / 7) for i, c in enumerate(cdf) if values.count(values[i]) == 1)
    d = max(d, 3 / 7 - cdf[1], cdf[1] - 1 / 7)
    assert got["statistic"] == round(d, 6) and got["p_value"] == round(dist.kolmogorov_upper(d, 7), 6)


def test_chi_square_with_a_hot_value(spark):
    """Over 10,000 values in one column and one value of the other in a third of the cells, against a plain computation."""
    pairs = [(i % 11_000, 0 if i % 3 == 0 else i % 7) for i in range(30_000)]
    got = stats.run_test("chi_square", spark.createDataFrame(pairs, "a int, b int"), {"column1": "a", "column2": "b"})
    cells, by_a, by_b = Counter(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    want = sum(o * o / (by_a[a] * by_b[b]) for (a, b), o in cells.items()) * 30_000 - 30_000
    assert got["statistic"] == pytest.approx(want, rel=1e-6) and got["degrees_of_freedom"] == (len(by_a) - 1) * (len(by_b) - 1)


def test_statistics(spark):
    table = spark.createDataFrame([(a, b) for a, b in [("a", "x"), ("b", "y"), ("a", "y"), ("b", "x")] * 25], "cat1 string, cat2 string")
    chi = stats.run_test("chi_square", table, {"column1": "cat1", "column2": "cat2"})
    assert (chi["statistic"], chi["p_value"], chi["degrees_of_freedom"]) == (0.0, 1.0, 1)
    corner = spark.createDataFrame([("a", "x")] * 10 + [("b", "y")] * 10, "p string, q string")
    assert stats.run_test("chi_square", corner, {"column1": "p", "column2": "q"})["statistic"] == pytest.approx(16.2)
    two = spark.createDataFrame([("A", float(i)) for i in range(10)] + [("B", float(i + 5)) for i in range(10)], "g string, v double")
    t = stats.run_test("t_test", two, {"column": "v", "group_column": "g"})
    assert t["statistic"] == pytest.approx(-3.692745, abs=1e-6) and t["p_value"] == pytest.approx(0.001668, abs=1e-5)
    assert stats.run_test("anova", two, {"value_column": "v", "group_column": "g"})["statistic"] == pytest.approx(t["statistic"] ** 2, abs=1e-4)
    mw = stats.run_test("mann_whitney", two, {"column": "v", "group_column": "g"})
    assert mw["statistic"] == 12.5 and mw["significant"]
    small = spark.createDataFrame([(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)], "a double, b double")
    assert stats.run_test("mann_whitney", small, {"column1": "a", "column2": "b"})["p_value"] == 0.1
    three = two.withColumn("g", F.when(F.col("v") > 12, "C").otherwise(F.col("g")))
    assert not stats.run_test("t_test", three, {"column": "v", "group_column": "g"})["success"]
    assert not stats.run_test("nothing", two, {})["success"] and not stats.run_test("ks_test", two, {"column": "zz"})["success"]
    assert len(stats.list_tests()) == 8


def test_rank_correlation_equals_pandas(spark, wild):
    df, pdf = wild
    got = stats.run_test("spearman", df, {"column1": "b", "column2": "c"})
    both = pdf[["b", "c"]].dropna()
    assert got["correlation"] == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-6)
    assert stats.run_test("pearson", df, {"column1": "b", "column2": "c"})["correlation"] == pytest.approx(both.corr().iloc[0, 1], abs=1e-6)


def smooth(scores, periods):
    """The smoothing written as the plain recursion."""
    s = [scores[0]]
    for x in scores[1:]:
        s.append(0.3 * x + 0.7 * s[-1])
    step = (s[-1] - s[max(0, len(s) - 3)]) / min(3, len(s))
    return [s[-1] + step * (i + 1) for i in range(periods)]


def test_forecast_equals_recursion(spark):
    rng = random.Random(1)
    series = {"up": [80.0 + i for i in range(1, 10)], "down": [95.0 - 2 * i for i in range(1, 10)],
              "flat": [90 + 0.01 * (i % 2) for i in range(1, 30)], "wild": [rng.uniform(20, 80) for _ in range(60)], "three": [50.0, 60.0, 55.0],
              "short": [1.0, 2.0]}
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "t string, date date, score double")
    facts = forecast.series_facts(df, "t", rows_per_range=20)
    summary = {r["t"]: r for r in forecast.forecast_summary(facts, "t", digits=6).collect()}
    assert set(summary) == set(series) - {"short"}
    points = {}
    for r in forecast.forecast_points(facts, "t", digits=6).orderBy("date").collect():
        points.setdefault(r["t"], []).append(r)
    for k in summary:
        want = smooth(series[k], 7)
        assert [p["exponential_smoothing"] for p in points[k]] == pytest.approx([min(100, max(0, w)) for w in want], abs=1e-5)
        line = np.polyval(np.polyfit(range(len(series[k])), series[k], 1), range(len(series[k]), len(series[k]) + 7))
        assert [p["linear_trend"] for p in points[k]] == pytest.approx(np.clip(line, 0, 100).tolist(), abs=1e-5)
        assert summary[k]["moving_average"] == pytest.approx(np.mean(series[k][-7:]), abs=1e-5)
    assert [summary[k]["trend"] for k in ("up", "down", "flat")] == ["improving", "degrading", "stable"]
    assert points["up"][0]["date"] == date(2024, 1, 10)
    assert [r["t"] for r in forecast.too_short(df, "t").collect()] == ["short"]


def test_scores(spark):
    rows = [("r1", "t", "completeness", "passed", 100.0), ("r2", "t", "volume", "failed", 0.0), ("r3", "u", "schema", "passed", 100.0)]
    df = spark.createDataFrame(rows, "id string, table_name string, check_type string, status string, score double")
    assert results.composite_score(df).first()[0] == 66.7 and results.composite_score(df.where("false")).first()[0] == 100.0
    assert results.composite_score(df, weighted=True).first()[0] == 77.8
    assert {r["table_name"]: (r["overall_score"], r["failed"]) for r in results.table_scores(df).collect()} == {"t": (50.0, 1), "u": (100.0, 0)}


def test_one_hot_decode(spark):
    names = ["id", "Unnamed: 0_Name", "Unnamed: 0_ann", "Unnamed: 0_bob", "Unnamed: 1_Age (Years)", "Unnamed: 1_10", "Unnamed: 1_12"]
    df = spark.createDataFrame([(1, 0, 1, 0, 0, 1, 0), (2, 0, 0, 1, 0, 0, 1), (3, 0, 0, 0, 0, 0, 0)], ", ".join(f"`{n}` int" for n in names))
    out = onehot.decode(df).orderBy("id")
    assert out.columns == ["id", "Name", "Age (Years)"]
    assert [tuple(r) for r in out.collect()] == [(1, "ann", 10.0), (2, "bob", 12.0), (3, None, None)]
    assert onehot.decode(df.select("id")).columns == ["id"]


def test_many_columns_are_correlated_in_one_plan(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    data = draw.normal(size=(400, 60)).cumsum(axis=1) + 1e6
    data[draw.random(data.shape) < 0.05] = np.nan
    data[:, 7] = 3.5
    pdf = pd.DataFrame(data, columns=[f"x{k}" for k in range(60)])
    got, want = eda.correlations(spark.createDataFrame(pdf), list(pdf)), pdf.corr()
    assert len(got) == 60 * 59 // 2
    assert all((r is None) == ("x7" in (a, b)) and (r is None or r == pytest.approx(want.loc[a, b], abs=1e-9)) for (a, b), r in got.items())


def test_patterns_and_sets_beyond_ascii(spark):
    from tidemark.functions.columns import not_in_set, not_matching
    from tidemark.functions.text import regex_replace

    df = spark.createDataFrame([("José", 1), ("Muñoz", 2), ("a b", 3), (None, None)], "s string, i int")
    bad = lambda c: [r["s"] for r in df.where(c).collect()]
    assert bad(not_matching(df, "s", r"^\w+$")) == ["a b"] and bad(not_matching(df, "s", r"(?P<x>J).*\Z")) == ["Muñoz", "a b"]
    assert bad(not_matching(df, "s", r"(?P<first_one>.)(?P=first_one)")) == ["José", "Muñoz", "a b"] and bad(not_matching(df, "s", "[")) == []
    assert bad(not_in_set(df, "i", ["1", "active"])) == ["José", "Muñoz", "a b"] and bad(not_in_set(df, "i", ["x", 1, 2.0])) == ["a b"]
    assert bad(not_in_set(df, "s", [1, "José"])) == ["Muñoz", "a b"]
    assert df.select(regex_replace(F.col("s"), r"\W", "_").alias("t")).where("s = 'José'").first()["t"] == "José"


def test_samples_of_every_kind_in_one_pass(spark):
    rows = [(k, "hot" if k % 3 == 0 else None if k in (4, 5) else f"u{k}", 1000.0 if k in (7, 50) else float(k % 5)) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, k string, x double")
    rules = [{"id": "u", "type": "uniqueness", "config": {"column": "k"}}, {"id": "a", "type": "anomaly", "config": {"column": "x", "threshold": 0.2}},
             {"id": "c", "type": "completeness", "config": {"column": "k", "threshold": 100}}]
    doubled, _, blank = checks.run_rules(df, rules, sample_order=["id"], samples=4)
    assert [m["id"] for m in doubled.failed_samples] == ["0", "3", "4", "5"] and doubled.records_failed == 22
    assert [m["id"] for m in blank.failed_samples] == ["4", "5"]


def test_outliers_are_sampled_with_z(spark):
    df = spark.createDataFrame([(k, 500.0 if k % 10 == 3 else 1.0 + k % 3) for k in range(50)], "id int, x double")
    (out,) = checks.run_rules(df, [{"id": "a", "type": "anomaly", "config": {"column": "x", "threshold": 2}}], sample_order=["id"], samples=3)
    assert out.status == "failed" and [m["id"] for m in out.failed_samples] == ["3", "13", "23"] and float(out.failed_samples[0]["z"]) > 2
