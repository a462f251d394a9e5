"""Ordered operators over whole tables: row numbers, running sums, forward and backward fill.

A window without keys, or with a key that holds a third of the rows, sorts all of that in one task.
Here the rows are first range-partitioned by the order keys themselves (and by what orders their ties), as many
ranges as the rows and their bytes need; the range of each row is settled, so that every later job sees the same. The window
runs per (keys, range), and what a range needs from the ranges before it comes from one small row per
(keys, range). Nulls come first and NaN last, with one range as with many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import col
from ..sources.scratch import settle

ROWS_PER_RANGE = 2_000_000
#: Rows of long texts reach this before they are that many.
BYTES_PER_RANGE = 64 << 20
#: Characters of a text that part ranges, unless too many rows have them in common.
KEY_CHARS = 64


def with_ranges(df: DataFrame, order_by: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add `__r`: range numbers that rise with `order_by`. Rows that tie in all order keys are parted by the other
    columns, so only equal rows have to stay together. Ranges hold about so many rows, or BYTES_PER_RANGE if those are fewer."""
    n, longest = _range_count(df, rows_per_range)
    if n <= 1:
        return df.withColumn("__r", F.lit(0))
    return settle(_parted(df, order_by, n, longest, rows_per_range).withColumn("__r", F.spark_partition_id()))


def _width(df: DataFrame) -> Column:
    """About the bytes of a row."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for c in df.columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(col(c)), F.lit(0))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = size + 8 * F.greatest(F.coalesce(F.size(col(c)), F.lit(0)), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            size = size + F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0))
    return size


def _range_count(df: DataFrame, rows_per_range: int) -> tuple[int, dict[str, int]]:
    """Ranges that the rows and their bytes need, and the length of the longest value of each text column."""
    texts = [c for c in df.columns if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))]
    rows, size, *longest = df.agg(F.count("*"), F.sum(_width(df)), *[F.max(F.length(col(c))) for c in texts]).first()
    return max(-(-rows // rows_per_range), -(-(size or 0) // BYTES_PER_RANGE)), {c: m or 0 for c, m in zip(texts, longest)}


def _range_keys(df: DataFrame, order_by: list[str], longest: dict[str, int], cut: int) -> tuple[list[Column], bool]:
    """The order up to the first text that may be longer than `cut`, of which only so much is taken, and whether there is one:
    a sample of the keys goes to the driver for the bounds of the ranges. Beginnings rise as their texts do."""
    keys: list[Column] = []
    for c in _tie_names(df, order_by):
        if longest.get(c, 0) > cut:
            return [*keys, F.substring(col(c), 1, cut)], True
        keys.append(col(c))
    return keys, False


def _parted(df: DataFrame, order_by: list[str], n: int, longest: dict[str, int], rows_per_range: int) -> DataFrame:
    """In `n` range partitions. Longer beginnings of texts are taken while too many rows for a range begin alike."""
    cut = KEY_CHARS
    keys, is_cut = _range_keys(df, order_by, longest, cut)
    while is_cut:
        alike = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], _width(df).alias("size")) \
            .groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
        rows, size = alike.agg(F.max("rows"), F.max("size")).first()
        if rows <= 2 * rows_per_range and size <= 2 * BYTES_PER_RANGE:
            break
        cut *= 16
        keys, is_cut = _range_keys(df, order_by, longest, cut)
    return df.repartitionByRange(n, *[k.asc_nulls_first() for k in keys])


def _keys(df: DataFrame, partition_by: list[str]) -> tuple[DataFrame, list[str]]:
    """Key copies that may be joined on: null keys compare as equal through a null mark."""
    names = []
    for i, k in enumerate(partition_by):
        df = df.withColumn(f"__k{i}", F.coalesce(col(k).cast("string"), F.lit(""))) \
               .withColumn(f"__n{i}", col(k).isNull())
        names += [f"__k{i}", f"__n{i}"]
    return df, names


def _tie_order(df: DataFrame, order_by: list[str]) -> list[Column]:
    return [col(c).asc_nulls_first() for c in _tie_names(df, order_by)]


def _tie_names(df: DataFrame, order_by: list[str]) -> list[str]:
    """Order keys, then every other orderable column, so that the order is total up to equal rows."""
    rest = [c for c in df.columns if c not in order_by and not c.startswith("__")
            and not isinstance(df.schema[c].dataType, (T.MapType,))]
    return [*order_by, *rest]


def running_sum(df: DataFrame, amount: str, order_by: list[str], partition_by: list[str] | None = None,
                out: str = "running", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Sum of `amount` over the row and all rows before it in the order."""
    ranged, keys = _keys(with_ranges(df, order_by, rows_per_range), partition_by or [])
    where = [*keys, "__r"]
    totals = ranged.groupBy(*where).agg(F.sum(amount).alias("__t"))
    before = W.partitionBy(*keys).orderBy("__r").rowsBetween(W.unboundedPreceding, -1) if keys \
        else W.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.sum("__t").over(before)).drop("__t")
    inside = W.partitionBy(*where).orderBy(*_tie_order(df, order_by)) \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.withColumn("__run", F.sum(amount).over(inside))
    joined = local.join(offsets, where, "left")
    # null only while no value was seen, in this range or an earlier one
    both = F.coalesce(F.col("__run") + F.col("__off"), F.col("__run"), F.col("__off"))
    return joined.withColumn(out, both).select(*[col(c) for c in df.columns], out)


def row_numbers(df: DataFrame, order_by: list[str], partition_by: list[str] | None = None,
                out: str = "row_number", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """1-based position of each row in the order, per key. Without a key, rows are numbered in their range partitions as they lie,
    and are not shuffled again."""
    if not partition_by:
        n, longest = _range_count(df, rows_per_range)
        if n > 1:
            return _numbered(df, order_by, out, n, longest, rows_per_range)
        whole = W.partitionBy(F.lit(0)).orderBy(*_tie_order(df, order_by))
        return df.withColumn(out, F.row_number().over(whole).cast("long"))
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return running_sum(one, "__one", order_by, partition_by, out, rows_per_range).drop("__one")


def _numbered(df: DataFrame, order_by: list[str], out: str, n: int, longest: dict[str, int], rows_per_range: int) -> DataFrame:
    parted = _parted(df, order_by, n, longest, rows_per_range).sortWithinPartitions(*_tie_order(df, order_by))
    # An id is the partition's number, then 33 bits of the row's place in it.
    ranged = settle(parted.withColumn("__id", F.monotonically_increasing_id())) \
        .withColumn("__r", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy("__r").agg(F.count("*").alias("__n"))
    before = W.partitionBy(F.lit(0)).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return ranged.join(F.broadcast(offsets), "__r").select(*[col(c) for c in df.columns], (F.col("__off") + F.col("__at") + 1).alias(out))


def fill(df: DataFrame, columns: list[str], order_by: list[str], partition_by: list[str] | None = None,
         forward: bool = True, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Replace missing values by the last one before (or the next one after) in the order, per key."""
    ranged, keys = _keys(with_ranges(df, order_by, rows_per_range), partition_by or [])
    where = [*keys, "__r"]
    # Positions order every row alike in the aggregate and in the window.
    order = _tie_order(df, order_by)
    inside = W.partitionBy(*where).orderBy(*order)
    rank = F.struct(*[col(c) for c in order_by],
                    *[col(c) for c in df.columns if c not in order_by
                      and not isinstance(df.schema[c].dataType, T.MapType)])
    pick = F.max_by if forward else F.min_by
    edges = ranged.groupBy(*where).agg(*[
        pick(col(c), F.when(_present(df, c), rank)).alias(f"__e{i}") for i, c in enumerate(columns)])
    over_ranges = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("__r")
    if forward:
        span, frame = over_ranges.rowsBetween(W.unboundedPreceding, -1), \
            inside.rowsBetween(W.unboundedPreceding, W.currentRow)
        nearest = F.last
    else:
        span, frame = over_ranges.rowsBetween(1, W.unboundedFollowing), \
            inside.rowsBetween(W.currentRow, W.unboundedFollowing)
        nearest = F.first
    carried = edges.select(*where, *[nearest(f"__e{i}", ignorenulls=True).over(span).alias(f"__c{i}")
                                     for i in range(len(columns))])
    local = ranged.select("*", *[nearest(F.when(_present(df, c), col(c)), ignorenulls=True).over(frame)
                                 .alias(f"__f{i}") for i, c in enumerate(columns)])
    joined = local.join(carried, where, "left")
    filled = {c: F.coalesce(F.col(f"__f{i}"), F.col(f"__c{i}")) for i, c in enumerate(columns)}
    return joined.select(*[filled[c].alias(c) if c in filled else col(c) for c in df.columns])


def _present(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()
