"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.joins import attach, sized
from ..sources.scratch import discard, keep, settle

__all__ = ["Memo", "attach", "connected", "fold", "grouped", "load", "map_rows", "settle", "sized", "text_of"]

#: Entries of a per-task word memo before it starts anew, so that memory stays bounded.
MEMO_ENTRIES = 400_000
#: Bytes of input that become Python objects at once.
SLICE_BYTES = 2_000_000


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the value written as text, modulo `parts`; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


class Memo(dict):
    """A dict that computes missing values; `trim` between texts keeps it bounded."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.clear()


def arrow_schema(spark_schema: str | StructType) -> pa.Schema:
    kind = _parse_datatype_string(spark_schema) if isinstance(spark_schema, str) else spark_schema
    return to_arrow_schema(kind)


def map_rows(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """`make()` runs once per task and returns a function from columns (as lists) to rows of the schema. It gets
    the rows of a batch in slices of about SLICE_BYTES, each of which becomes one batch of output."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
            for start in range(0, batch.num_rows, step):
                rows = list(rows_of(*[c.to_pylist() for c in batch.slice(start, step).columns]))
                columns = zip(*rows) if rows else [[] for _ in target]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows that agree in the first `keys` columns."""
    for batch in batches:
        at, values = 0, zip(*[batch.column(k).to_pylist() for k in range(keys)])
        for key, same in itertools.groupby(values):
            n = sum(1 for _ in same)
            yield key, batch.slice(at, n)
            at += n


def grouped(df: DataFrame, keys: list[str], order: list[str], make: Callable, schema: str, sort: bool = True) -> DataFrame:
    """Rows of a key as a stream of slices, so that no group has to fit in memory.

    `make()` runs once per task and returns a function (key, iterator of record batches) -> rows. The first
    columns of `df` must be the keys. Without `sort`, the rows must already lie together."""
    target = arrow_schema(schema)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of, out = make(), []
        for key, parts in itertools.groupby(slices(batches, n), key=lambda x: x[0]):
            for row in rows_of(key, (part for _, part in parts)):
                out.append(row)
                if len(out) >= 1000:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    def pack(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)

    if sort:
        df = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return df.mapInArrow(run, schema)


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), by alternating large and small stars: rows (node, root), where
    root is the least node of the component. Nodes are of any ordered type. It ends when every component is a star around
    its least node. Only two counts reach the driver, once a round; a round has as many tasks as its edges need."""
    spark = edges.sparkSession
    now, path = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n_edges, open_nodes = _shape(now)
    while open_nodes:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sized(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), 2 * n_edges).select("a", F.least("a", "m").alias("m"), "n")
        large, between = keep(attach(both, least, ["a"], 2 * n_edges).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        root = sized(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), n_edges)
        small = (attach(large, root, ["a"], n_edges).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(root.select("a", F.col("m").alias("b"))).distinct())
        before = path
        now, path = keep(sized(small, n_edges))
        discard(spark, before)
        discard(spark, between)
        n_edges, open_nodes = _shape(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(sized(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct(), n_edges))


def _shape(edges: DataFrame) -> tuple[int, int]:
    """The number of distinct edges (a, b), b < a, and of nodes that have several lower neighbours, or lower and higher ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("lower")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("lower")))
    nodes = ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.count("*").alias("n"))
    return tuple(nodes.agg(F.coalesce(F.sum("lower"), F.lit(0)), F.count_if(F.expr("lower > 1 or (lower = 1 and n > 1)"))).first())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton's method; a column of ones must be part of x where wanted."""
    weight = np.ones(len(y)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
