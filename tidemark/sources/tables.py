"""Stored tables: write, register, preview, list, version and append."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import col
from ..operators import profile
from .readers import read_path

#: Default of the widest table that `ingest` takes; a parameter there.
MAX_COLUMNS = 1_000


def load(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """A stored table, or with `root` the first of name.parquet, name.csv, name.json found there."""
    if root is None:
        return spark.table(name)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for ending in ("parquet", "csv", "json"):
        path = f"{root.rstrip('/')}/{name}.{ending}"
        p = fs_path(path)
        if p.getFileSystem(conf).exists(p):
            return read_path(spark, path)
    raise FileNotFoundError(f"no table {name!r} under {root}")


def save(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write the whole table. The path must not be one the DataFrame reads from."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.format(fmt).save(path)
    return path


def safe_name(name: str, prefix: str) -> str:
    out = "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in name)
    return prefix + out if not out or out[0].isdigit() else out


def register(df: DataFrame, name: str, table: bool = False) -> str:
    """Make a table queryable under a clean name, with clean column names and booleans as 0/1."""
    clean = df.toDF(*[safe_name(c, "col_") for c in df.columns])
    flags = {f.name for f in clean.schema.fields if isinstance(f.dataType, T.BooleanType)}
    clean = clean.select(*[col(c).cast("int").alias(c) if c in flags else col(c) for c in clean.columns])
    target = safe_name(name, "t_")
    if table:
        clean.write.mode("overwrite").saveAsTable(target)
    else:
        clean.createOrReplaceTempView(target)
    return target


def preview(df: DataFrame, n: int = 50) -> tuple[DataFrame, int, bool]:
    """(first n rows, row count, whether rows are left out); n is kept within 1 and 10,000."""
    n = max(1, min(n, 10_000))
    total = df.count()
    return df.limit(n), total, total > n


def preview_all(spark: SparkSession, names: list[str] | None = None, n: int = 20) -> dict[str, DataFrame]:
    """The first n rows of every table; n is kept within 1 and 100."""
    n = max(1, min(n, 100))
    return {t: spark.table(t).limit(n) for t in (names or table_names(spark))}


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def list_tables(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Name, column names and row count per table; all counts in one job."""
    names = names or table_names(spark)
    parts = [spark.table(t).agg(F.count("*").alias("row_count")).select(
        F.lit(t).alias("name"), F.array(*[F.lit(c) for c in spark.table(t).columns]).alias("columns"),
        F.lit(len(spark.table(t).columns)).alias("column_count"), "row_count") for t in names]
    if not parts:
        return spark.createDataFrame([], "name string, columns array<string>, column_count int, row_count bigint")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def next_copy_name(spark: SparkSession, name: str) -> str:
    """`base_fixed`, else the next free `base_fixed_v2`, `_v3`, ...; an earlier suffix is dropped first."""
    base = re.sub(r"_fixed(_v\d+)?$", "", name)
    if not spark.catalog.tableExists(f"{base}_fixed"):
        return f"{base}_fixed"
    v = 2
    while spark.catalog.tableExists(f"{base}_fixed_v{v}"):
        v += 1
    return f"{base}_fixed_v{v}"


def save_copy(df: DataFrame, name: str) -> str:
    """Write a fixed copy next to the original."""
    target = next_copy_name(df.sparkSession, name)
    df.write.saveAsTable(target)
    return target


def append(rows: DataFrame, target: str) -> None:
    """Add result rows (checks, profiles, tests, contracts, reports) to a stored table, or to a Parquet
    folder when the target is a path."""
    writer = rows.write.mode("append")
    if "/" in target:
        writer.parquet(target)
    else:
        writer.saveAsTable(target)


def ingest(spark: SparkSession, path: str, name: str, table: bool = False, max_columns: int = MAX_COLUMNS, **options) -> dict:
    """Read a file, detect types, profile every column and register it. Over `max_columns` columns is an error; options
    are those of `read_csv`."""
    df = read_path(spark, path, **options)
    if len(df.columns) > max_columns:
        raise ValueError(f"Too many columns: {len(df.columns)}")
    types = profile.detect_types(df)
    stats = profile.ingest_profile(df, types)
    return {"table": register(df, name, table), "types": types, "profile": stats, "data": df}
