"""A training corpus from raw documents: reject poor ones, keep one of each group of near copies, drop those that hold benchmark
items, mask personal data, pack what is left into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the shared folder and reads it
again for the next. All stages but the last return the columns of documents, whatever columns there are besides. Null texts
count as empty, and a text without words is rejected; repeated rows are near copies of each other; no documents give no
sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_copies, packing, personal, quality, tiling
from tidemark.llm.common import load
from tidemark.sources.scratch import fresh_path

#: No SQL: training, MinHash banding, tiling and packing can't be said in it. Tested against brute force instead.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    return docs.where(quality.scorer(docs, load(spark, sf_dir, "labels")) >= 0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is found in."""
    return tiling.split(docs, load(spark, sf_dir, "benchmark")).where("not contaminated").select(*[f"`{c}`" for c in docs.columns])


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return personal.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality", good), ("near_copies", distinct), ("decontamination", clean), ("personal_data", masked), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
