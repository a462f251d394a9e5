"""Exact quantiles, ordered ranges, lookups and neighbours against pandas, with hot keys and nulls."""

from __future__ import annotations

import random
from decimal import Decimal

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import as_number
from tidemark.operators import ordering, quantiles, values
from tidemark.operators.lookup import category_table, lookup
from tidemark.operators.neighbours import fill_from_neighbours


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, one order value and one number."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.35
        rows.append((i, "hot" if hot else rng.choice(["a", "b", None]), 5 if hot else rng.choice([1, 2, 3, 8, 9, None]),
                     1.5 if hot else (None if rng.random() < 0.3 else round(rng.gauss(0, 100), 3)), 2**60 + rng.randrange(50)))
    df = spark.createDataFrame(rows, "id long, k string, o int, v double, big long")
    return df, pd.DataFrame(rows, columns=["id", "k", "o", "v", "big"])


@pytest.mark.parametrize("limit", [20_000, 300, 5])
def test_quantiles_equal_pandas(skewed, limit):
    df, pdf = skewed
    probs = [0, 0.05, 0.25, 0.5, 0.75, 0.99, 1]
    got = quantiles.quantiles(df, {"v": as_number(df, "v"), "id": as_number(df, "id")}, probs, sort_limit=limit)
    for c in ("v", "id"):
        np.testing.assert_allclose(got[c], pdf[c].quantile(probs).to_numpy(), rtol=1e-12)


def test_order_statistics_of_large_longs_are_exact(skewed):
    df, pdf = skewed
    want = np.sort(pdf["big"].to_numpy())
    got = quantiles.order_statistics(df, {"big": F.col("big")}, {"big": [0, 7, 1500, 2999]}, {"big": 3000}, sort_limit=10)
    assert got["big"] == {r: int(want[r]) for r in (0, 7, 1500, 2999)}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [None]}


@pytest.mark.parametrize("per_range", [100_000, 100])
def test_row_numbers(skewed, per_range):
    df, pdf = skewed
    pdf = pdf.assign(key=pdf.k.fillna("NULL"), at=pdf.o.fillna(-1)).sort_values(["at", "id"])
    got = ordering.row_numbers(df, ["o", "id"], ["k"], rows_per_range=per_range).toPandas().set_index("id").row_number
    want = (pdf.groupby("key").cumcount() + 1).set_axis(pdf.id)
    assert got.sort_index().tolist() == want.sort_index().tolist()


@pytest.mark.parametrize("per_range", [100_000, 100])
@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("keys", [None, ["k"]])
def test_fill(skewed, per_range, forward, keys):
    df, pdf = skewed
    pdf = pdf.assign(key=pdf.k.fillna("NULL"), at=pdf.o.fillna(-1)).sort_values(["at", "id"])
    got = ordering.fill(df, ["v"], ["o", "id"], keys, forward, per_range).toPandas().set_index("id").v.sort_index()
    column = pdf.groupby("key").v if keys else pdf.v
    want = (column.ffill() if forward else column.bfill()).set_axis(pdf.id).sort_index()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_ranges_split_ties_and_nulls(skewed):
    df, _ = skewed
    sizes = [r["count"] for r in ordering.with_ranges(df, ["o", "id"], 100).groupBy("__r").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 300


def test_fill_takes_nan_for_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "id int, v double")
    assert [r.v for r in ordering.fill(df, ["v"], ["id"]).orderBy("id").collect()] == [1.0, 1.0, 1.0]


@pytest.mark.parametrize("small", [10_000, 1])
def test_lookup_small_and_large(skewed, small):
    df, pdf = skewed
    table = category_table(df, "k", F.max("id").alias("top"), small=small)
    got = lookup(df, "k", table, ["top"], small=small).toPandas().sort_values("id")
    want = pdf.k.map(pdf.groupby("k").id.max())
    assert len(got) == 3000
    assert got.top.fillna(-1).tolist() == want.fillna(-1).tolist()


def test_lookup_many_cold_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 2000, -1).otherwise(F.col("id")).alias("k"), "id")
    table = category_table(df, "k", F.count("*").alias("c"), small=10)
    got = lookup(df, "k", table, ["c"], small=10)
    assert got.count() == 5000
    assert got.where("k = -1 and c = 2000").count() == 2000 and got.where("k > -1 and c = 1").count() == 3000


def test_lookup_of_wide_keys(spark):
    """Three keys of 3,000 bytes are few, but neither collected nor broadcast; the hot one is spread over salts."""
    key = F.when(F.col("id") % 3 == 0, F.repeat(F.lit("h"), 3000)).when(F.col("id") == 1, F.repeat(F.lit("o"), 3000)).when(F.col("id") > 2, F.lit("s"))
    df = spark.range(3000).select(key.alias("k"), "id")
    table = category_table(df, "k", F.max("id").alias("top"))
    assert "LocalTableScan" not in table._jdf.queryExecution().toString() and "ExistingRDD" not in table._jdf.queryExecution().toString()
    got = lookup(df, "k", table, ["n", "top"])
    assert got.columns == ["k", "id", "n", "top"]
    counts = {(None if r.k is None else r.k[0], r.n, r.top): r["count"] for r in got.groupBy("k", "n", "top").count().collect()}
    assert counts == {("h", 1000, 2997): 1000, ("o", 1, 1): 1, ("s", 1998, 2999): 1998, (None, None, None): 1}


def test_value_counts(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (1, -0.0, None), (None, float("nan"), "x"), (2, 2.5, "y")],
                               "a int, b double, c string")
    got = {(r["column"], r["value"]): r["n"] for r in values.value_counts(df, ["a", "b", "c"], keep_null=True).collect()}
    assert got == {("a", "1"): 2, ("a", "2"): 1, ("a", None): 1, ("b", "0.0"): 2, ("b", "2.5"): 1, ("b", None): 1,
                   ("c", "x"): 2, ("c", "y"): 1, ("c", None): 1}


def test_top_values_and_modes_break_ties_by_value(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "b"), (9, "a"), (3, "c")], "a int, c string")
    assert values.modes(df, ["a", "c"]) == {"a": 9, "c": "a"}
    top = values.top_values(values.value_counts(df, ["a"]), 2).orderBy("position").collect()
    assert [(r["value"], r["n"]) for r in top] == [("9", 2), ("10", 2)]


def test_duplicate_rows_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, None), (1, 2)], "a int, b int")
    assert values.duplicate_rows(df) == 1 and values.duplicate_rows(df, ["a"]) == 2


def test_few_values_leaves_wide_columns_out(spark):
    df = spark.range(1000).select("id", (F.col("id") % 15).alias("fits"), (F.col("id") % 16).alias("over"))
    assert [r["column"] for r in values.few_values(df).collect()] == ["fits"]


def test_quantiles_of_many_columns_use_bounded_buffers(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "COLUMNS", 7)
    monkeypatch.setattr(quantiles, "BUFFERED", 900)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({f"c{i}": np.round(rng.normal(i, 5, 700), 1) for i in range(20)})
    df = spark.createDataFrame(pdf)
    got = quantiles.quantiles(df, {c: F.col(c) for c in pdf}, [.1, .5, .99], sort_limit=300)
    for c in pdf:
        np.testing.assert_allclose(got[c], pdf[c].quantile([.1, .5, .99]).to_numpy(), rtol=1e-12)


def gappy_points(n: int, seed: int = 5):
    """Three features, a fifth of the values of two of them missing, a hot point, one infinite value."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 10, (n, 3))
    x[:, 1][rng.random(n) < .2] = np.nan
    x[:, 2][rng.random(n) < .2] = np.nan
    x[rng.random(n) < .1] = [1.0, 2.0, 3.0]
    x[7, 0] = np.inf
    return np.round(x, 1), np.where(rng.random(n) < .3, np.nan, np.round(rng.random(n) * 100, 2))


@pytest.mark.parametrize("cell_rows, indexes", [(20, 64), (20, 2), (150, 64), (10**9, 64)])
def test_neighbours_with_gaps_by_indexes_equal_brute_force(spark, monkeypatch, cell_rows, indexes):
    from tidemark.operators import neighbours

    monkeypatch.setattr(neighbours, "MAX_INDEXES", indexes)
    x, y = gappy_points(2500)
    x[11] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    got = fill_from_neighbours(df, "y", ["a", "b", "c"], 4, 90, 70, cell_rows).toPandas().set_index("id").y
    dx, dy = x[~np.isnan(y)], y[~np.isnan(y)]
    for i in np.flatnonzero(np.isnan(y)):
        with np.errstate(all="ignore"):
            gaps = (dx - x[i]) ** 2
            known = ~np.isnan(gaps)
            d = np.sqrt(np.where(known, gaps, 0).sum(1) / known.sum(1))
        near = [v for away, v in sorted(zip(np.where(np.isnan(d), np.inf, d), dy)) if np.isfinite(away)][:4]
        assert got[i] == pytest.approx(np.mean(near) if near else dy.mean())
    assert (got.sort_index()[~np.isnan(y)] == dy).all()


def test_receivers_with_gaps_visit_few_donors(spark):
    from tidemark.operators import neighbours

    x, y = gappy_points(20_000)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).select(F.array("a", "b", "c").alias("__vec"), F.col("y").alias("__y"))
    donors = rows.where("not isnan(__y)").groupBy("__vec", "__y").agg(F.count("*").alias("n"))
    receivers = rows.where("isnan(__y)").groupBy("__vec").agg(F.count("*").alias("n"))
    placed, calls = neighbours._visits(donors, receivers, 5, 100)
    compared = placed.groupBy("cell").count().join(calls.groupBy("cell").agg(F.count("*").alias("calls")), "cell") \
        .agg(F.sum(F.col("count") * F.col("calls"))).first()[0]
    assert compared < 0.2 * donors.count() * receivers.count()


@pytest.mark.parametrize("blocks", [(20_000, 20_000), (40, 33)])
def test_neighbours_equal_brute_force(spark, blocks):
    rng = random.Random(3)
    rows = [(i, float(rng.choice([1, 2, 3, 50, 51])) if rng.random() > .1 else None,
             round(rng.random() * 3, 1) if rng.random() > .1 else None,
             None if rng.random() < .3 else round(rng.random() * 10, 2)) for i in range(600)]
    pdf = pd.DataFrame(rows, columns=["id", "a", "b", "y"])
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    got = fill_from_neighbours(df, "y", ["a", "b"], 5, *blocks).toPandas().set_index("id").y
    donors = pdf[pdf.y.notna()]
    for _, r in pdf.iterrows():
        if not np.isnan(r.y):
            assert got[r.id] == r.y
            continue
        gaps = np.stack([(donors.a - r.a) ** 2, (donors.b - r.b) ** 2])
        shared = (~np.isnan(gaps)).sum(0)
        with np.errstate(all="ignore"):
            d = np.where(shared == 0, np.inf, np.sqrt(np.nansum(gaps, 0) / shared))
        near = [y for away, y in sorted(zip(d, donors.y)) if np.isfinite(away)][:5]
        assert got[r.id] == pytest.approx(np.mean(near) if near else donors.y.mean())


ORDER_KEYS = {
    "text with a shared prefix": ("string", lambda k: f"https://example.org/a/long/common/prefix/{k:05d}"),
    "long past 2^53": ("long", lambda k: 2**60 + k), "decimal": ("decimal(30,10)", lambda k: Decimal(k) / 7 + Decimal(10) ** 18),
    "NaN and infinities": ("double", lambda k: float("nan") if k > 280 else float("-inf") if k < 5 else k / 3),
}


@pytest.mark.parametrize("kind", ORDER_KEYS)
@pytest.mark.parametrize("per_range", [1000, 40, 7])
def test_order_is_the_same_at_any_range_size(spark, kind, per_range):
    dtype, make = ORDER_KEYS[kind]
    draw = random.Random(8)
    rows = [(k, None if k < 9 else make(k // 2), None if draw.random() < 0.4 or k < 20 else float(draw.randrange(9))) for k in range(300)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, f"id int, o {dtype}, v double")
    rows.sort(key=lambda r: r[0])
    order = ["o", "id"]
    assert [r["row_number"] for r in ordering.row_numbers(df, order, rows_per_range=per_range).orderBy("id").collect()] == list(range(1, 301))
    sums, last, total = [], [], None
    for _, _, v in rows:
        total = total if v is None else (total or 0.0) + v
        last.append(v if v is not None else last[-1] if last else None)
        sums.append(total)
    assert [r["running"] for r in ordering.running_sum(df, "v", order, rows_per_range=per_range).orderBy("id").collect()] == sums
    assert [r["v"] for r in ordering.fill(df, ["v"], order, rows_per_range=per_range).orderBy("id").collect()] == last
    if per_range == 7:
        assert ordering.with_ranges(df, order, per_range).select("__r").distinct().count() > 20


@pytest.mark.parametrize("begin", ["", "same beginning " * 10])
def test_ranges_of_long_texts_are_cut_by_bytes(spark, monkeypatch, begin):
    monkeypatch.setattr(ordering, "BYTES_PER_RANGE", 20_000, raising=False)
    texts = [f"{begin}{random.Random(k).random()}" + "é" * 500 for k in range(300)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bytes_of = F.sum(F.coalesce(F.octet_length("t"), F.lit(0)))
    sizes = [r[0] for r in ordering.with_ranges(df, ["t"]).groupBy("__r").agg(bytes_of).collect()]
    assert len(sizes) > 10 and max(sizes) < 80_000
    numbered = ordering.row_numbers(df, ["t"], out="n")
    want = [(None, 1), *((t, k) for k, t in enumerate(sorted(t for t in texts if t is not None), 2))]
    assert [(r["t"], r["n"]) for r in numbered.orderBy("n").collect()] == want
    assert numbered.schema["n"].dataType.simpleString() == "bigint"
