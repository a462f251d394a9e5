"""Snapshots name parts: unchanged rows are stored once, whatever their order, and come back as they were."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources.history import History


def size(root) -> int:
    return sum(p.stat().st_size for p in Path(root).rglob("*.parquet") if "/data/" in str(p))


def test_ten_snapshots_take_the_room_of_one(spark, tmp_path):
    df = spark.range(5000).select("id", F.concat(F.lit("text "), F.col("id") % 17).alias("t"))
    past = History(spark, str(tmp_path), "t", rows_per_part=500)
    first = past.save_snapshot(df, "dedup")
    once = size(tmp_path)
    for k in range(9):
        past.save_snapshot(df.orderBy(F.xxhash64(F.col("id") + k)), "dedup")
    assert size(tmp_path) == once and past.history().count() == 10
    assert tuple(past.usage().first()) == (10, 50_000, 5000)
    assert past.rollback(first).exceptAll(df).count() == 0 and past.rollback(first).count() == 5000


def test_a_changed_row_writes_its_parts_only(spark, tmp_path):
    df = spark.range(8000).select("id", F.lit(1.5).alias("x"))
    past = History(spark, str(tmp_path), "t", rows_per_part=500)
    first = past.save_snapshot(df, "outlier")
    once = size(tmp_path)
    changed = df.withColumn("x", F.when(F.col("id") == 77, 9.0).otherwise(F.col("x")))
    second = past.save_snapshot(changed, "outlier")
    assert size(tmp_path) < 1.3 * once
    assert past.rollback(second).where("x = 9").count() == 1 and past.rollback(first).where("x = 9").count() == 0
    past.rollback_last()
    assert 1 <= past.sweep() <= 2 and past.sweep() == 0   # the part the row left, and the one it went to
    assert past.rollback(first).exceptAll(df).count() == 0 and past.rollback(first).count() == 8000
    past.clear()
    assert size(tmp_path) == 0 and past.rollback(first) is None


def test_values_come_back_as_they_were(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    schema = "a double, b string, c array<string>, d map<string,int>, `e.f` timestamp, g binary, h struct<x: int, y: string>"
    rows = [(float("nan"), "", ["", None], {"k": None}, at, b"\x00", (None, "z")), (-0.0, None, [None, ""], None, None, None, None),
            (0.0, None, [], {}, at.replace(microsecond=678902), b"", (1, None)), (None, "x" * 100_000, None, {"a": 1}, at, None, (None, None))]
    df = spark.createDataFrame(rows + rows[:2], schema)
    past = History(spark, str(tmp_path), "odd")
    one = past.save_snapshot(df, "x")
    assert sorted(map(repr, past.rollback(one).collect())) == sorted(map(repr, df.collect()))
    for other in (df.where("isnan(a) or a is null"), df.select(*[F.col("a") + 0.0 if c == "a" else F.col(f"`{c}`") for c in df.columns]).toDF(*df.columns)):
        two = past.save_snapshot(other, "x")
        assert sorted(map(repr, past.rollback(two).collect())) == sorted(map(repr, other.collect()))
    none = past.save_snapshot(df.limit(0), "x")
    assert past.rollback(none).count() == 0 and past.rollback(none).schema == df.schema


def test_names_and_types_part_tables_with_equal_values(spark, tmp_path):
    past = History(spark, str(tmp_path), "t")
    a = past.save_snapshot(spark.range(3).select(F.col("id").alias("a")), "x")
    b = past.save_snapshot(spark.range(3).select(F.col("id").alias("b")), "x")
    c = past.save_snapshot(spark.range(3).select(F.col("id").cast("int").alias("b")), "x")
    assert [past.rollback(s).dtypes for s in (a, b, c)] == [[("a", "bigint")], [("b", "bigint")], [("b", "int")]]


def test_equal_rows_are_written_by_several_tasks(spark, tmp_path):
    df = spark.range(0, 4000, 1, 4).select(F.lit("same").alias("t"))
    past = History(spark, str(tmp_path), "t", rows_per_part=500)
    one = past.save_snapshot(df, "x")
    files = [p for p in tmp_path.rglob("*.parquet") if "/data/" in str(p)]
    assert len(files) > 1 and past.rollback(one).count() == 4000


def test_a_table_that_changes_between_reads_is_refused(spark, tmp_path):
    past = History(spark, str(tmp_path), "t")
    with pytest.raises(ValueError):
        past.save_snapshot(spark.range(50).select(F.expr("uuid()").alias("u")).where("u is not null").transform(_reread), "x")
    assert past.history().count() == 0 and size(tmp_path) == 0


def _reread(df):
    """The rows, different at every run: a Python value drawn inside the tasks."""
    @F.udf("string")
    def draw(u):
        import os
        return os.urandom(8).hex()

    return df.select(draw.asNondeterministic()("u").alias("u"))
