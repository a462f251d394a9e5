"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def exact_rounding(sql: str) -> str:
    """Write pround(x, n) as rounding of the exact binary value, which is how Python rounds."""
    while "pround(" in sql:
        start = sql.rindex("pround(")
        depth, at = 1, start + len("pround(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        body, digits = sql[start + len("pround("):at - 1].rsplit(",", 1)
        sql = f"{sql[:start]}(format('{{:.{int(digits)}f}}', ({body})::DOUBLE)::DOUBLE + 0.0){sql[at:]}"
    return sql


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = exact_rounding(sql)
        return fn
    return keep


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*[(F.round(f"`{f.name}`", digits) + F.lit(0.0)).alias(f.name)
                       if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema.fields])


# Orders with gaps: part-finished orders have no price yet, and "not specified" is no priority.
GAPPY = """g AS (SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate,
    NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders)"""


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"))
