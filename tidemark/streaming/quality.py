"""Completeness, validity and volume per time window. The same function serves a stream and a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

UNITS = {"m": "minutes", "h": "hours", "d": "days"}


def interval(text: str) -> str:
    """`5m`, `1h`, `1d` as a Spark duration; a Spark duration stays as it is."""
    short = re.fullmatch(r"(\d+)([mhd])", text.strip())
    return f"{short[1]} {UNITS[short[2]]}" if short else text


def window_metrics(rows: DataFrame, time: str, every: str, present: dict[str, Column] | None = None,
                   valid: dict[str, Column] | None = None, keys: list[str] | None = None,
                   lateness: str | None = None) -> DataFrame:
    """Row count per window, share of rows for which each `present` condition holds, and share of valid
    rows among those that can be judged (condition not null), in percent."""
    if lateness:
        rows = rows.withWatermark(time, interval(lateness))
    aggs = [F.count("*").alias("volume")]
    for name, condition in (present or {}).items():
        aggs.append((F.count_if(condition) / F.count("*") * 100).alias(f"{name}_completeness"))
    for name, condition in (valid or {}).items():
        judged = F.count(condition)
        aggs.append(F.when(judged > 0, F.count_if(condition) / judged * 100).otherwise(100.0).alias(f"{name}_validity"))
    grouped = rows.groupBy(F.window(time, interval(every)).alias("w"), *(keys or [])).agg(*aggs)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          *[c for c in grouped.columns if c != "w"])


def run_available(metrics: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process what is there now and append finished windows to a Parquet folder, once each. The checkpoint is kept (by
    default in a folder beside `path`), so the next run goes on where this one ended; windows that are still open then are
    written by the run whose rows close them."""
    query = metrics.writeStream.format("parquet").outputMode("append").trigger(availableNow=True) \
        .option("path", path).option("checkpointLocation", checkpoint or f"{path.rstrip('/')}_state").start()
    query.awaitTermination()
    return query


def with_open_windows(metrics: DataFrame, path: str, keys: list[str] | None = None) -> DataFrame:
    """The final flush: the windows that `run_available` wrote to `path`, and those of `metrics`, the same metrics over the table, that no
    later row has closed. The folder stays as it is, so a later run may still write them with their last rows."""
    written = metrics.sparkSession.read.schema(metrics.schema).parquet(path)
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("window_start", "window_end", *(keys or []))]
    return written.unionByName(metrics.alias("m").join(written.alias("w"), same, "left_anti"))


def stream_table(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern) \
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
