"""Skew-safe lookup of a per-value statistic, the join behind the category encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, value
from ..sources.scratch import settle

SMALL = 10_000   # statistic rows that may be collected or broadcast
SMALL_BYTES = 16 << 20   # and their bytes: no row of a small table has more than its share of these
HOT_SHARE = 1_000  # a key is hot when it holds more than 1/HOT_SHARE of the rows


def _wide(df: DataFrame, names: list[str], small: int) -> Column:
    """Whether a row's texts, lists and structs have more than a small table's bytes for each row."""
    size = F.lit(0)
    for c in names:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(col(c)), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            size = size + F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0))
    return size > F.lit(SMALL_BYTES // max(small, 1))


def _is_small(df: DataFrame, names: list[str], small: int) -> bool:
    flags = df.select(_wide(df, names, small).alias("wide")).limit(small + 1).collect()
    return len(flags) <= small and not any(f["wide"] for f in flags)


def category_table(df: DataFrame, key: str, *aggregates: Column, small: int = SMALL) -> DataFrame:
    """One row per non-null value of `key` with its row count `n` and the given aggregates.

    At most `small` rows, none of them wide, are pulled in and kept as a local table, so later steps do not scan again. Of a wide
    row only that it is wide reaches the driver.
    """
    counts = df.where(value(df, key).isNotNull()).groupBy(col(key).alias(key)) \
        .agg(F.count("*").alias("n"), *aggregates)
    wide = _wide(counts, counts.columns, small)
    seen = counts.select(wide.alias("wide"), F.when(~wide, F.struct(*[col(c) for c in counts.columns])).alias("row")).limit(small + 1).collect()
    if len(seen) > small or any(s["wide"] for s in seen):
        return counts
    return df.sparkSession.createDataFrame([s["row"] for s in seen], counts.schema)


def lookup(df: DataFrame, key: str, stats: DataFrame, names: list[str], small: int = SMALL, settled: bool = False) -> DataFrame:
    """Left join `stats` (columns: key, n, names...) on `key`.

    A statistic of at most `small` rows, none of them wide (both looked up first), is broadcast and the data is not shuffled.
    Beyond that, keys with over a thousandth of the rows, of which there are fewer than a thousand, are broadcast, and only rows
    with other keys are shuffled, so no task gets one huge key. Hot keys that are too wide to be broadcast are shuffled under as
    many salts as they have thousandths; their hashes tell which rows those are. A statistic that is `settled` is not stored again.
    """
    wanted = stats.select(col(key).alias("__key"), *names)
    on = col(key) == F.col("__key")
    if _is_small(wanted, wanted.columns, small):
        return df.join(F.broadcast(wanted), on, "left").drop("__key")
    stats = stats if settled else settle(stats)
    total = stats.agg(F.sum("n")).first()[0]
    is_hot, wide = F.col("n") * HOT_SHARE > total, _wide(stats, [key, *names], SMALL)
    hot = stats.where(is_hot & ~wide).select(col(key).alias("__key"), *names)
    cold = stats.where(~is_hot | wide).select(col(key).alias("__key"), *names)
    by_hot = df.join(F.broadcast(hot), on, "inner").drop("__key")
    blank = df.where(col(key).isNull())
    for name in names:
        blank = blank.withColumn(name, F.lit(None).cast(stats.schema[name].dataType))
    rest = df.where(col(key).isNotNull()).join(F.broadcast(hot.select("__key")), on, "left_anti")
    pieces = F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total or 0, 1))).cast("int")
    heavy = stats.where(is_hot & wide).groupBy(F.xxhash64(col(key)).alias("__hash")).agg(F.max(pieces).alias("__pieces")).collect()
    if heavy:
        salts = F.broadcast(df.sparkSession.createDataFrame(heavy, "__hash long, __pieces int"))
        parts = F.coalesce(F.col("__pieces"), F.lit(1))
        rest = rest.withColumn("__hash", F.xxhash64(col(key))).join(salts, "__hash", "left") \
            .withColumn("__salt", F.pmod(F.xxhash64(*[col(c) for c in df.columns]), parts).cast("int")).drop("__hash", "__pieces")
        cold = cold.withColumn("__hash", F.xxhash64("__key")).join(salts, "__hash", "left") \
            .withColumn("__at", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__hash", "__pieces")
        by_cold = rest.join(cold, on & (F.col("__salt") == F.col("__at")), "left").drop("__key", "__salt", "__at")
    else:
        by_cold = rest.join(cold, on, "left").drop("__key")
    return by_hot.unionByName(by_cold).unionByName(blank)
