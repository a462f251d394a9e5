"""Joins with a fact per key that hold under hot keys, and task counts by counted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key of a join is cut into pieces of at most about one part in so many of all rows.
HOT_SHARE = 1_000
#: Rows for which a task of its own is worth while.
ROWS_PER_TASK = 20_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """In as many tasks as so many rows need, at most: small tables stay in few files, however many partitions a shuffle has."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, size: str = "n") -> DataFrame:
    """Inner join of rows to facts, of which there is at most one for each key; `size` of a fact says how many of the
    `total` rows have its key. A key with over a thousandth of the rows is salted: its rows are spread over as many salts as
    it has thousandths, and its fact goes to each. Such keys, of which there are fewer than a thousand, are broadcast. Columns:
    those of rows, then those of facts."""
    named = [c for c in facts.columns if c not in keys]
    pieces = F.greatest(F.ceil(F.col(size) * HOT_SHARE / F.lit(max(total, 1))), F.lit(1)).cast("int")
    cut = facts.withColumn("_pieces", pieces)
    hot = F.broadcast(cut.where("_pieces > 1").select(*keys, "_pieces"))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_pieces")), F.lit(0)).cast("int")
    salted = rows.join(hot, keys, "left").select(*rows.columns, salt.alias("_salt"))
    spread = cut.select(*keys, *named, F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_salt"))
    return sized(salted.join(spread, [*keys, "_salt"]).select(*rows.columns, *named), total)
