"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by a hash of their text, so equal texts lie together. A sample in which a record counts as often
as its size warrants gives the keys at even quantiles; those splitters cut the order into ranges. The size of every
range is then counted exactly, and a range that is overfull is subdivided: by a second hash of the text, or, where
one text (a large group of copies) fills it, in bytes or in rows, by the document's id. Exact prefix sums over the ranges give each record
its place in bytes, and the place gives the shard, so sizes are near equal whatever the sample was.

Copies of a text stay in one shard while they are at most a hundredth of a shard together; larger groups are cut where
a shard is full.

Defined cases: a null text has no bytes (size 1) and counts as equal to the empty text; repeated rows each get a place;
ties of text are ordered by doc_id, nulls first; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle, text_of

#: Records that a range should have, and how many ranges there may be.
ROWS_PER_RANGE, MIN_RANGES, MAX_RANGES = 250_000, 256, 16_384
#: Sampled keys for each range; the sample that reaches the driver has about this many keys times the ranges.
SAMPLES_PER_RANGE = 16
#: The share of a shard that copies of one text may have and still be kept together.
WHOLE_GROUP = 0.01


def sampled_splitters(records: DataFrame, ranges: int, total: int, n: int) -> tuple[list[int], list[int]]:
    """Keys at even quantiles of the sizes, and the keys that alone fill a range in bytes or in rows, from a sample.

    A record is drawn with a chance in proportion to its size, or with that of a row where it is more; one larger than the
    sampling step is always drawn. What is drawn counts with its size, and as a row, over its chance. The draw is a hash of
    the record, so a task that runs again draws the same."""
    step, row_step = (max(1.0, x / (ranges * SAMPLES_PER_RANGE)) for x in (total, n))
    share = F.least(F.lit(1.0), F.greatest(F.col("size") / step, F.lit(1 / row_step)))
    chance = F.pmod(F.xxhash64("key", "doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    drawn = (records.where(chance < share).groupBy("key").agg(F.sum(F.col("size") / share).alias("w"), F.sum(1 / share).alias("c"))
             .orderBy("key").collect())
    weight = sum(r["w"] for r in drawn)
    cuts, hot, run = [], [], 0.0
    for r in drawn:
        if r["w"] * ranges >= weight or r["c"] * ranges >= n:
            hot.append(r["key"])
        before, run = run, run + r["w"]
        if int(before * ranges / weight) != int(run * ranges / weight) and r["w"] * ranges < weight:
            cuts.append(r["key"])
    # a hot key is a range by itself: cut before it and after it
    cuts = sorted({*cuts, *hot, *(k + 1 for k in hot if k < (1 << 63) - 1)})
    return cuts, hot


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the key: a search over blocks of cuts, then within one block."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[k:k + width] for k in range(0, len(cuts), width)]
    literal = lambda xs: F.expr("array(" + ",".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in xs) + ")")
    block = F.size(F.filter(literal([b[0] for b in blocks]), lambda c: c <= key))
    nested = F.array(*[literal(b) for b in blocks])
    within = F.size(F.filter(F.element_at(nested, F.greatest(block, F.lit(1))), lambda c: c <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + within)


def shard(documents: DataFrame, shards: int = 8, law: str = "bytes") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: adding a shard moves bounds)."""
    if law != "bytes":
        raise ValueError("sampled splitters balance bytes")
    text = text_of()
    records = settle(documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                                      F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key")))
    n, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MAX_RANGES, max(MIN_RANGES, -(-n // ROWS_PER_RANGE)))
    cuts, hot = sampled_splitters(records, ranges, total, n)
    ranged = records.withColumn("range", range_of(F.col("key"), cuts))

    # exact sizes of ranges; those with over twice their share are subdivided
    counted = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    hot_ranges = {bisect.bisect_right(cuts, k) for k in hot}
    parts = {r["range"]: max(-(-r["bytes"] * ranges // max(total, 1)), -(-r["rows"] * ranges // max(n, 1)), 1) for r in counted}
    split = {k: p for k, p in parts.items() if p > 2}
    # a hot text is a range by itself; one of few bytes stays whole, wherever its parts are sorted
    centres, before = {}, 0
    for k, size in sorted((r["range"], r["bytes"]) for r in counted):
        if k in split and k in hot_ranges and size <= WHOLE_GROUP * total / shards:
            centres[k] = before + size / 2
        before += size
    by = lambda chosen: F.create_map(*[F.lit(x) for k, p in chosen.items() for x in (k, p)]) if chosen else None
    text_parts = by({k: p for k, p in split.items() if k not in hot_ranges})
    copy_parts = by({k: p for k, p in split.items() if k in hot_ranges})
    sub = F.lit(0).cast("long")
    if text_parts is not None:
        sub = F.coalesce(F.pmod(F.xxhash64("key", F.lit(5)), F.try_element_at(text_parts, "range")), sub)
    if copy_parts is not None:
        sub = F.coalesce(F.pmod(F.xxhash64("doc_id", "key"), F.try_element_at(copy_parts, "range")), sub)
    celled = ranged.withColumn("sub", sub)

    # prefix sums: over the cells, of which there are a bounded number, and within each
    cells = celled.groupBy("range", "sub").agg(F.sum("size").alias("cell_bytes"), F.count("*").alias("cell_rows"))
    in_order = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(cells.select("range", "sub", F.coalesce(F.sum("cell_bytes").over(in_order), F.lit(0)).alias("bytes_before"),
                                 F.coalesce(F.sum("cell_rows").over(in_order), F.lit(0)).alias("rows_before")))
    cell = Window.partitionBy("range", "sub").orderBy("key", "doc_id", "size", "text_crc32")
    group = Window.partitionBy("range", "sub", "key")
    up_to = cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (celled.withColumn("end", F.sum("size").over(up_to)).withColumn("place", F.row_number().over(cell) - 1)
              .withColumn("group_end", F.max("end").over(group)).withColumn("group_bytes", F.sum("size").over(group))
              .join(F.broadcast(starts), ["range", "sub"]))
    whole = F.col("group_bytes") <= WHOLE_GROUP * total / shards
    inside = F.col("bytes_before") + F.when(whole, F.col("group_end") - F.col("group_bytes") / 2).otherwise(F.col("end") - F.col("size") / 2)
    middle = F.coalesce(F.try_element_at(by(centres), "range"), inside) if centres else inside
    sharded = settle(placed.select("doc_id", "size", "text_crc32",
                                   F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"),
                                   (F.col("rows_before") + F.col("place")).alias("rank")))
    first = sharded.groupBy("shard").agg(F.min("rank").alias("first"))
    return sharded.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
