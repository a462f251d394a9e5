"""Split rows into train, test and validation parts.

A part is marked in a `split` column; which part a row is in follows from a hash of its key, so a
retried task or a second run gives the same parts. Sizes are exact when `key` identifies rows; rows
with equal keys stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.columns import col
from ...functions.dates import as_timestamp, day_first, micros
from ...functions.columns import is_datetime, as_number
from .. import ordering, quantiles
from ..lookup import lookup
from .result import TransformResult, choose_method, names

METHODS = ["random", "stratified", "time_based"]
LAST = 2 ** 62


def row_hash(df: DataFrame, key: list[str], seed: int) -> Column:
    """A 64-bit hash of the key columns; null and a missing neighbour hash differently."""
    parts = [x for c in (key or df.columns) for x in (col(c), col(c).isNull())]
    return F.xxhash64(F.lit(int(seed)), *parts)


def _lowest(df: DataFrame, hashed: Column, take: int, total: int) -> Column:
    """True for the `take` rows with the smallest hashes: a threshold, not a sort."""
    if take <= 0:
        return F.lit(False)
    if take >= total:
        return F.lit(True)
    edge = quantiles.order_statistics(df, {"h": hashed}, {"h": [take - 1]}, {"h": total})["h"][take - 1]
    return hashed <= F.lit(edge)


def _random(df: DataFrame, key: list[str], test_size: float, seed: int) -> DataFrame:
    total = df.count()
    train = _lowest(df, row_hash(df, key, seed), round((1 - test_size) * total), total)
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def _stratified(df: DataFrame, column: str, key: list[str], test_size: float, seed: int) -> DataFrame:
    """Per class max(1, int(n * test_size)) test rows. A large class is numbered in hash ranges."""
    hashed = df.withColumn("__h", row_hash(df, key, seed))
    numbered = ordering.row_numbers(hashed, ["__h"], [column], out="__rn").drop("__h")
    sizes = df.groupBy(col(column)).agg(F.count("*").alias("n")).withColumn("__n", F.col("n"))
    blank = df.agg(F.count_if(col(column).isNull())).first()[0]
    joined = lookup(numbered, column, sizes.where(col(column).isNotNull()), ["__n"]).withColumn("__n", F.coalesce("__n", F.lit(blank)))
    test = F.col("__rn") <= F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(test_size)))
    return joined.withColumn("split", F.when(test, "test").otherwise("train")).select(*[col(c) for c in df.columns], "split")


def _time(df: DataFrame, column: str, key: list[str], test_size: float, seed: int) -> DataFrame:
    """Earliest int(n * (1 - test_size)) rows train. Rows at the cut time are told apart by hash."""
    total = df.count()
    take = int(total * (1 - test_size))
    if take <= 0 or take >= total:
        return df.withColumn("split", F.lit("test" if take <= 0 else "train"))
    days = day_first(df, [column]).get(column, False)
    when = micros(as_timestamp(df, column, day_first=days)) if not as_is_number(df, column) else as_number(df, column)
    moment = F.coalesce(when, F.lit(LAST))
    edge = quantiles.order_statistics(df, {"t": moment}, {"t": [take - 1]}, {"t": total})["t"][take - 1]
    before, tied = df.agg(F.count_if(moment < F.lit(edge)), F.count_if(moment == F.lit(edge))).first()
    among = F.when(moment == F.lit(edge), row_hash(df, key, seed))
    train = (moment < F.lit(edge)) | ((moment == F.lit(edge)) & _lowest(df, among, take - before, tied))
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def as_is_number(df: DataFrame, column: str) -> bool:
    dtype = df.schema[column].dataType
    return not is_datetime(dtype) and dtype.typeName() not in ("string",)


def split_rows(df: DataFrame, config: dict) -> TransformResult:
    """Config: method (random), test_size (0.2), val_size (0), random_state (42), stratify_column,
    time_column, key. `df` of the result is the train part; `extra_outputs` holds train, test, val and
    the labelled table. A method without its column falls back to random."""
    method = choose_method(config, METHODS, "random")
    test_size, val_size = float(config.get("test_size", 0.2)), float(config.get("val_size", 0.0))
    seed, key = config.get("random_state", 42), names(config.get("key"))
    by, when = config.get("stratify_column", config.get("column", "")), config.get("time_column", "")
    if method == "stratified" and by in df.columns:
        marked = _stratified(df, by, key, test_size, seed)
    elif method == "time_based" and when in df.columns:
        marked = _time(df, when, key, test_size, seed)
    else:
        method, marked = "random", _random(df, key, test_size, seed)
    if val_size > 0:
        train = marked.where("split = 'train'")
        n = train.count()
        hashed = row_hash(df, key, int(seed) + 1)
        chosen = _lowest(train, hashed, round(val_size / (1 - test_size) * n), n)
        marked = marked.withColumn(
            "split", F.when((F.col("split") == "train") & chosen, "val").otherwise(F.col("split")))
    parts = {p: marked.where(F.col("split") == p).drop("split") for p in ("train", "test", "val")}

    def measure() -> dict:
        sizes = {r["split"]: r["count"] for r in marked.groupBy("split").count().collect()}
        total = sum(sizes.values())
        details = {"method": method, "total_rows": total}
        for p in ("train", "test", "val"):
            n = sizes.get(p, 0)
            details[f"{p}_rows"] = n
            if p != "val" or n:
                details[f"{p}_pct"] = round(n / total * 100, 1) if total else 0
        return {"rows_affected": total, "details": details,
                "message": f"Split data: {sizes.get('train', 0)} train / {sizes.get('test', 0)} test ({method})"}

    return TransformResult(parts["train"], measure=measure, extra_outputs={**parts, "labelled": marked})
