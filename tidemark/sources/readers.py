"""Scans: CSV, JSON, Parquet, stored tables, JDBC queries and object stores."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import NUMBER_TEXT, col
from .split_csv import read_split

# Text read as missing in CSV files.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc", "jsonl": "json", "ndjson": "json"}


def _largest(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file, from the listing alone."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def _split_bytes(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, infer: bool = True, split: bool | None = None,
             **options) -> DataFrame:
    """CSV with a header. Missing-value tokens become null before types are chosen.

    Quoted values may hold line breaks. Files larger than one read partition are then split by `split_csv`, which gives the same
    rows; smaller ones are one task in any case. `split` decides instead. `multiLine=False` is for files of which it is known
    that no value has a line break.

    With a schema there is one scan. Otherwise types come from one extra aggregation over the text:
    long, double, boolean, else string; dates stay text, as a CSV has no type for them.
    """
    breaks = options.pop("multiLine", True)
    reader = spark.read.options(**{"header": True, "multiLine": breaks, "escape": '"'} | options)
    raw = (reader.schema(schema) if schema is not None else reader).csv(path)
    if breaks and (_largest(spark, path) > _split_bytes(spark) if split is None else split):
        parts = read_split(spark, path, raw.schema, options)
        raw = raw if parts is None else parts
    if schema is not None:
        return raw
    clean = raw.select(*[F.when(~col(c).isin(NA_TOKENS), col(c)).alias(c) for c in raw.columns])
    if not infer:
        return clean
    exprs = []
    for i, c in enumerate(clean.columns):
        whole = col(c).rlike(r"^\s*[+-]?\d{1,18}\s*$")
        exprs += [F.count(col(c)).alias(f"n{i}"), F.count_if(whole).alias(f"w{i}"),
                  F.count_if(col(c).rlike(NUMBER_TEXT)).alias(f"x{i}"),
                  F.count_if(F.lower(col(c)).isin("true", "false")).alias(f"b{i}")]
    row = clean.agg(*exprs).first()

    def typed(i: int, c: str):
        n = row[f"n{i}"]
        if n and row[f"w{i}"] == n:
            return F.trim(col(c)).cast("long").alias(c)
        if n and row[f"x{i}"] == n:
            return F.trim(col(c)).cast("double").alias(c)
        if n and row[f"b{i}"] == n:
            return F.lower(col(c)).cast("boolean").alias(c)
        return col(c)

    return clean.select(*[typed(i, c) for i, c in enumerate(clean.columns)])


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """A JSON array of records, or one record per line. Arrays are read whole by one task per file; keep
    large data as lines."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_path(spark: SparkSession, path: str, default: str = "csv", **options) -> DataFrame:
    """Any supported file or folder, by the ending of its name; options are those of `read_csv`."""
    ending = posixpath.basename(path.rstrip("/")).rsplit(".", 1)[-1].lower() if "." in path else ""
    fmt = FORMATS.get(ending, default)
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt == "json":
        return read_json(spark, path, lines=ending in ("jsonl", "ndjson"))
    return spark.read.format(fmt).load(path)


def read_object(spark: SparkSession, bucket: str, key: str, scheme: str = "s3a") -> DataFrame:
    """An object-store key; the format follows its ending, CSV when there is none."""
    return read_path(spark, f"{scheme}://{bucket}/{key.lstrip('/')}")


# JDBC URL layouts and default ports.
JDBC = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306, "com.mysql.cj.jdbc.Driver"),
    "sqlite": ("jdbc:sqlite:{path}", None, "org.sqlite.JDBC"),
}


def jdbc_options(kind: str, config: dict) -> dict[str, str]:
    """Reader options for a query. With `partition_column`, bounds and `partitions`, the scan is parallel;
    Spark needs the query as a table expression for that."""
    if kind not in JDBC:
        raise ValueError(f"Unknown database kind: {kind}")
    layout, port, driver = JDBC[kind]
    url = layout.format(host=config.get("host", "localhost"), port=config.get("port", port),
                        database=config.get("database", ""), path=config.get("path", ""))
    out = {"url": url, "driver": driver, "fetchsize": str(config.get("fetchsize", 10_000))}
    for theirs, ours in (("user", "user"), ("password", "password")):
        if config.get(ours):
            out[theirs] = str(config[ours])
    query = config["query"].strip().rstrip(";")
    if config.get("partition_column"):
        out |= {"dbtable": f"({query}) AS q", "partitionColumn": config["partition_column"],
                "lowerBound": str(config["lower_bound"]), "upperBound": str(config["upper_bound"]),
                "numPartitions": str(config.get("partitions", 32))}
    else:
        out["query"] = query
    return out


def read_jdbc(spark: SparkSession, kind: str, config: dict) -> DataFrame:
    """A query on PostgreSQL, MySQL or SQLite; the driver jar must be on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(kind, config)).load()
