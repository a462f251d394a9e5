"""Transforms on the small frames of FIXTURES.md and on edge cases."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.transforms import ALIASES, apply_transform, find_transform, list_transforms, register_transform
from tidemark.operators.transforms.date_parse import detect_date_columns
from tidemark.operators.transforms.result import TransformResult, choose_method


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def column(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


def test_registry():
    assert len(list_transforms()) == 9 and sum(map(len, ALIASES.values())) == 29
    assert find_transform("winsorize") is find_transform("outlier")
    with pytest.raises(ValueError):
        find_transform("nothing")
    register_transform("same", lambda df, cfg: TransformResult(df))
    assert find_transform("same")
    from tidemark.operators.transforms import TRANSFORMS
    TRANSFORMS.pop("same")


@pytest.mark.parametrize("given, want", [("iqr", "iqr_cap"), ("zscore", "zscore_cap"), ("other", "iqr_remove"), (None, "iqr_remove")])
def test_method_names(given, want):
    supported = ["iqr_remove", "iqr_cap", "zscore_remove", "zscore_cap"]
    assert choose_method({"method": given} if given else {}, supported, "iqr_remove") == want


@pytest.mark.parametrize("method, want", [("mean", 26.75), ("median", 3.0), ("mode", 1.0), ("constant", 0.0)])
def test_impute_numbers(spark, method, want):
    df = frame(spark, "a double", (1.0,), (2.0,), (None,), (4.0,), (100.0,))
    r = apply_transform(df, "imputation", {"method": method})
    assert sorted(column(r.df, "a")) == sorted([1.0, 2.0, want, 4.0, 100.0])
    assert r.rows_affected == 1 and r.details["a"] == {"before": 1, "after": 0}


def test_impute_whole_numbers_by_mean_become_double(spark):
    df = frame(spark, "id int, a int", (1, 1), (2, 2), (3, None))
    assert column(apply_transform(df, "impute", {"method": "mean", "column": "a"}).df, "a", "id") == [1.0, 2.0, 1.5]


def test_impute_text_and_nan_and_all_null(spark):
    df = frame(spark, "s string, x double, gone double", ("x", 1.0, None), ("x", float("nan"), None), (None, 3.0, None), ("y", None, None))
    r = apply_transform(df, "imputation", {"method": "mean"})
    assert sorted(column(r.df, "s")) == ["x", "x", "x", "y"]
    assert sorted(column(r.df, "x")) == [1.0, 2.0, 2.0, 3.0]
    assert column(r.df, "gone") == [None] * 4


@pytest.mark.parametrize("method, want", [("forward_fill", [1, 1, 3, 3, 5]), ("backward_fill", [1, 3, 3, 5, 5])])
def test_impute_in_order(spark, method, want):
    df = frame(spark, "o int, a double", (1, 1.0), (2, None), (3, 3.0), (4, None), (5, 5.0))
    assert column(apply_transform(df, "imputation", {"method": method, "column": "a", "order_by": "o"}).df, "a", "o") == want
    with pytest.raises(ValueError):
        apply_transform(df, "imputation", {"method": method})


def test_impute_nothing_to_do(spark):
    df = frame(spark, "a int", (1,))
    r = apply_transform(df, "imputation", {})
    assert r.success and r.rows_affected == 0 and r.message == "No missing values found"
    assert not apply_transform(spark.createDataFrame([()], "struct<>"), "imputation", {}).success


def test_outliers(spark):
    df = frame(spark, "a long", *[(x,) for x in (1, 2, 3, 4, 5, 100)])
    assert sorted(column(apply_transform(df, "outlier", {"method": "iqr_remove"}).df, "a")) == [1, 2, 3, 4, 5]
    capped = apply_transform(df, "outlier", {"method": "iqr"})
    assert max(column(capped.df, "a")) == 8.5 and capped.rows_affected == 0 and capped.details["a"]["outliers_found"] == 1
    z = frame(spark, "a long", *[(x,) for x in (10, 11, 10, 12, 11, 500)])
    assert 500 not in column(apply_transform(z, "outlier", {"method": "zscore_remove", "z_threshold": 2.0}).df, "a")
    same = frame(spark, "a long", (5,), (5,), (5,))
    assert column(apply_transform(same, "outlier", {"method": "zscore_remove"}).df, "a") == [5, 5, 5]
    few = frame(spark, "a long", (1,), (1000,))
    assert apply_transform(few, "outlier", {}).df.count() == 2
    assert not apply_transform(frame(spark, "s string", ("x",)), "outlier", {}).success


def test_percentile_clip_and_winsorize(spark):
    df = spark.range(1, 101).select(F.col("id").alias("a"))
    clipped = column(apply_transform(df, "outlier", {"method": "percentile_clip", "lower_percentile": 5, "upper_percentile": 95}).df, "a")
    assert (min(clipped), max(clipped)) == (pytest.approx(5.95), pytest.approx(95.05))
    wins = column(apply_transform(df, "outlier", {"method": "winsorize", "limits": (0.1, 0.2)}).df, "a")
    assert (min(wins), max(wins), len(wins)) == (11, 80, 100)


def test_dedup(spark):
    df = frame(spark, "a long", (1,), (1,), (2,), (3,), (3,))
    assert sorted(column(apply_transform(df, "dedup", {}).df, "a")) == [1, 2, 3]
    assert column(apply_transform(df, "dedup", {"method": "keep_none"}).df, "a") == [2]
    pairs = frame(spark, "o int, a long, b string", (1, 1, "first"), (2, 1, "second"), (3, 2, "third"))
    for method, want in (("keep_first", ["first", "third"]), ("keep_last", ["second", "third"])):
        r = apply_transform(pairs, "dedup", {"method": method, "columns": ["a"], "order_by": "o"})
        assert sorted(column(r.df, "b")) == want and r.rows_affected == 1
    assert not apply_transform(df, "dedup", {"columns": ["zz"]}).success


def test_dedup_null_groups(spark):
    df = frame(spark, "k string, o int", (None, 1), (None, 2), ("x", 3))
    assert sorted(column(apply_transform(df, "dedup", {"columns": ["k"], "order_by": "o"}).df, "o")) == [1, 3]


def test_encoding(spark):
    df = frame(spark, "o int, cat string", (1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, None))
    hot = apply_transform(df, "encoding", {"method": "onehot", "column": "cat"}).df
    assert hot.columns == ["o", "cat_a", "cat_b", "cat_c"]
    assert [tuple(r)[1:] for r in hot.orderBy("o").collect()] == [(1, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]
    assert column(apply_transform(df, "encoding", {"column": "cat"}).df, "cat_encoded", "o") == [0, 1, 0, 2, 0]
    assert column(apply_transform(df, "encoding", {"column": "cat", "method": "binary"}).df, "cat_binary", "o") == [0, 1, 0, 2, -1]
    assert column(apply_transform(df, "encoding", {"column": "cat", "method": "frequency"}).df, "cat_freq", "o") == [.5, .25, .5, .25, 0]
    kept = apply_transform(df, "encoding", {"column": "cat", "method": "ordinal", "order": ["c", "b"], "drop_original": False}).df
    assert column(kept, "cat_ordinal", "o") == [0, 1, 0, 0, 0] and "cat" in kept.columns
    none = frame(spark, "cat string", (None,))
    assert column(apply_transform(none, "encoding", {"method": "binary", "column": "cat"}).df, "cat_binary") == [-1]
    assert apply_transform(frame(spark, "x int", (1,)), "encoding", {}).message == "No categorical columns found to encode"


def test_one_hot_has_no_cap_but_takes_a_limit(spark):
    from tidemark.operators.transforms.encoding import one_hot

    df = spark.range(1100).select(F.col("id").cast("string").alias("c"))
    assert len(one_hot(df, "c").columns) == 1101
    with pytest.raises(ValueError):
        one_hot(df, "c", limit=1000)


def test_one_hot_of_many_values_is_a_sparse_column(spark):
    from tidemark.operators.transforms.encoding import one_hot_index, one_hot_sparse

    df = frame(spark, "o int, cat string", (1, "b"), (2, None), (3, "a"), (4, "b"))
    got = [(r["indices"], r["values"], r["size"]) for r in column(apply_transform(df, "encoding", {"column": "cat", "method": "one_hot_sparse"}).df, "cat_one_hot", "o")]
    assert got == [([1], [1.0], 2), ([], [], 2), ([0], [1.0], 2), ([1], [1.0], 2)]
    assert [tuple(r) for r in one_hot_index(df, "cat").orderBy("position").collect()] == [(0, "a", 1), (1, "b", 2)]
    wide = apply_transform(df, "encoding", {"column": "cat", "method": "one_hot", "max_columns": 1}).df
    assert wide.columns == ["o", "cat_one_hot"]
    assert apply_transform(df, "encoding", {"column": "cat", "method": "one_hot", "max_columns": 2}).df.columns == ["o", "cat_a", "cat_b"]
    none = one_hot_sparse(frame(spark, "cat string", (None,)), "cat").first()["cat_one_hot"]
    assert (none["size"], none["indices"]) == (0, [])
    many = spark.range(1_000_000).select(F.format_string("key-%07d", (F.col("id") * 7919) % 1_000_000).alias("c"))
    encoded = one_hot_sparse(many, "c").select("c", F.get("c_one_hot.indices", F.lit(0)).alias("at"), "c_one_hot.size")
    assert encoded.where("size <> 1000000 or at is null or at <> cast(substring(c, 5) as bigint)").count() == 0 and encoded.count() == 1_000_000


def test_target_encoding(spark):
    df = frame(spark, "o int, cat string, target long", (1, "a", 1), (2, "a", 1), (3, "b", 0), (4, "b", 0), (5, None, 1))
    assert column(apply_transform(df, "encoding", {"method": "target", "column": "cat", "target_column": "target"}).df,
                  "cat_target_enc", "o") == [1, 1, 0, 0, 0.6]
    assert "cat_freq" in apply_transform(df, "encoding", {"method": "target", "column": "cat"}).df.columns


@pytest.mark.parametrize("method, want", [("minmax", 0.0), ("zscore", 0.0), ("robust", 0.0), ("max_abs", 1.0)])
def test_scaling_a_constant(spark, method, want):
    df = frame(spark, "a long", (5,), (5,), (5,), (5,))
    assert column(apply_transform(df, "normalization", {"method": method}).df, "a") == [want] * 4


def test_scaling_ranges(spark):
    df = frame(spark, "a long", *[(x,) for x in (-5, 10, -15, 20, -25)])
    scaled = sorted(column(apply_transform(df, "minmax", {}).df, "a"))
    assert scaled[0] == 0 and scaled[-1] == 1
    assert min(column(apply_transform(df, "normalization", {"method": "max_abs"}).df, "a")) == -1
    assert min(column(apply_transform(df, "normalization", {"method": "log"}).df, "a")) == pytest.approx(0.6931, abs=1e-4)


TEXTS = ["  Hello  ", "WORLD", "foo bar", "hello   world", "it's a-b_c", " nbsp ", "", "a1b2", "--", "Été déjà-vu", "x\ty\nz"]


def test_text_equals_python(spark):
    import re
    def snake(s):
        return re.sub(r"\s+", "_", re.sub(r"[^a-zA-Z0-9]", " ", s).strip()).lower()
    def camel(s):
        words = re.sub(r"[^a-zA-Z0-9]", " ", s).split()
        return words[0].lower() + "".join(w.capitalize() for w in words[1:]) if words else s
    expected = {
        "trim": str.strip, "lowercase": str.lower, "uppercase": str.upper, "title_case": str.title, "snake_case": snake,
        "camel_case": camel, "remove_special": lambda s: re.sub(r"[^a-zA-Z0-9\s]", "", s),
        "standardize_whitespace": lambda s: re.sub(r"\s+", " ", s).strip()}
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "i int, s string")
    for method, fn in expected.items():
        got = column(apply_transform(df, "string_clean", {"method": method}).df, "s", "i")
        assert got == [fn(s) for s in TEXTS] + [None], method


def test_regex_replace_and_counts(spark):
    df = frame(spark, "s string", ("a1b22",), ("$x",), (None,))
    r = apply_transform(df, "string_clean", {"method": "regex_replace", "pattern": r"(\d+)", "replacement": r"<\1$>"})
    assert set(column(r.df, "s")) == {"a<1$>b<22$>", "$x", None} and r.rows_affected == 1


def test_dates(spark):
    df = frame(spark, "d string", ("2024-01-15",), ("2024-06-30",), ("2023-12-25",), ("nope",), (None,))
    out = apply_transform(df, "date_parse", {"column": "d", "method": "extract_features",
                                             "features": ["dayofweek", "weekofyear", "is_month_end", "is_weekend"]}).df
    rows = {r["d"]: tuple(r)[1:] for r in out.collect()}
    assert rows["2024-06-30"] == (6, 26, 1, 1) and rows["2023-12-25"] == (0, 52, 0, 0) and rows[None] == (None, None, 0, 0)
    parsed = apply_transform(frame(spark, "d string", ("15/01/2024",), ("bad",)), "parse_date", {"column": "d", "format": "%d/%m/%Y"})
    assert [str(v) for v in column(parsed.df, "d")] == ["2024-01-15 00:00:00", "None"] and parsed.details["d"]["parsed_count"] == 1
    shown = apply_transform(df, "date_parse", {"column": "d", "method": "to_format", "output_format": "%B %d, year %Y"})
    assert column(shown.df, "d")[0] == "January 15, year 2024"
    assert detect_date_columns(df.where("d <> 'nope'")) == ["d"] and detect_date_columns(df.where("d = 'nope'")) == []
    assert not apply_transform(frame(spark, "s string", ("word",)), "date_parse", {}).success


def test_splits(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 50, "A").otherwise("B").alias("cat"))
    r = apply_transform(df, "data_split", {"method": "stratified", "stratify_column": "cat", "key": "id"})
    counts = {(x["cat"], x["split"]): x["count"] for x in r.extra_outputs["labelled"].groupBy("cat", "split").count().collect()}
    assert counts == {("A", "train"): 40, ("A", "test"): 10, ("B", "train"): 40, ("B", "test"): 10}
    again = apply_transform(df, "data_split", {"key": "id", "val_size": 0.1})
    sizes = again.details
    assert (sizes["train_rows"], sizes["test_rows"], sizes["val_rows"]) == (70, 20, 10)
    assert sorted(column(again.df, "id")) == sorted(column(apply_transform(df.repartition(7), "data_split", {"key": "id", "val_size": 0.1}).df, "id"))
    late = apply_transform(df, "data_split", {"method": "time_based", "time_column": "id", "test_size": 0.25})
    assert min(column(late.extra_outputs["test"], "id")) == 75 and late.df.count() == 75


def test_time_split_cuts_through_ties(spark):
    df = spark.range(90).select("id", F.when(F.col("id") < 60, F.lit(1)).otherwise(F.lit(2)).alias("t"))
    r = apply_transform(df, "data_split", {"method": "time_based", "time_column": "t", "test_size": 0.5, "key": "id"})
    assert r.details["train_rows"] == 45 and column(r.df.agg(F.max("t").alias("m")), "m") == [1]


def test_types(spark):
    df = frame(spark, "n string, b string, d string, c string, u string", ("1", "yes", "2024-01-15", "x", "p"),
               ("2.5", "no", "2024-06-30", "x", "q"), ("3", "yes", None, "x", "r"))
    r = apply_transform(df, "type_conversion", {})
    kinds = {f.name: f.dataType.simpleString() for f in r.df.schema.fields}
    assert kinds == {"n": "double", "b": "boolean", "d": "timestamp_ntz", "c": "string", "u": "string"}
    assert r.df.schema["c"].metadata == {"category": True} and r.details["u"]["converted"] is False
    numeric = apply_transform(frame(spark, "a string", ("1",), ("1d",), ("x",), (" 2 ",)), "convert_type", {"method": "to_numeric", "column": "a"})
    assert column(numeric.df, "a") == [1.0, None, None, 2.0]
    assert not apply_transform(df, "type_conversion", {"method": "to_numeric"}).success


def test_day_order_of_dates_with_a_time_or_a_short_year(spark):
    df = frame(spark, "d string, m string, y string, c string, h string",
               ("15/06/2024 10:00:00", "06/15/2024 10:00:00", "15/06/24", "20240115", "25-12-2024"),
               ("05/06/2024 10:00:00", "05/06/2024 10:00:00", "05/06/69", "20241301", "05-06-2024"),
               ("31/02/2024 10:00:00", None, "31/04/24", "2024011", "5-6-2024"))
    names = ["d", "m", "y", "c", "h"]
    got = [[None if v is None else str(v) for v in r] for r in apply_transform(df, "date_parse", {"columns": names}).df.collect()]
    assert got == [["2024-06-15 10:00:00", "2024-06-15 10:00:00", "2024-06-15 00:00:00", "2024-01-15 00:00:00", "2024-12-25 00:00:00"],
                   ["2024-06-05 10:00:00", "2024-05-06 10:00:00", "1969-06-05 00:00:00", None, "2024-06-05 00:00:00"],
                   [None] * 5]
    whole = df.where("d not like '31%'").select("d")
    assert apply_transform(whole, "type_conversion", {"column": "d", "method": "to_datetime"}).df.collect()[1][0] == datetime.datetime(2024, 6, 5, 10)
    assert detect_date_columns(whole) == ["d"]


def test_one_date_layout_per_column(spark):
    df = spark.createDataFrame([("05/06/2024", "05/06/2024"), ("15/06/2024", "05/16/2024"), (None, "")], "d string, m string")
    got = apply_transform(df, "date_parse", {"columns": ["d", "m"]}).df.collect()
    assert [str(r["d"])[:10] for r in got] == ["2024-06-05", "2024-06-15", "None"]
    assert [str(r["m"])[:10] for r in got] == ["2024-05-06", "2024-05-16", "None"]


def test_stratified_split_of_many_classes_with_a_hot_one(spark):
    df = spark.range(36_000).select("id", F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 3 == 1, F.col("id") % 12_001).alias("c"))
    out = apply_transform(df, "data_split", {"method": "stratified", "stratify_column": "c", "key": "id", "test_size": 0.2}).extra_outputs["labelled"]
    got = out.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
    assert out.count() == 36_000 and got.count() > 10_000
    assert got.where(F.col("t") != F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))).count() == 0
