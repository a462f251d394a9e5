"""Joins and listings over catalog tables. Join sides are left to the optimizer, which broadcasts only
what its size statistics allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def rule_tables(rules: DataFrame, datasets: DataFrame, tables: DataFrame) -> DataFrame:
    """(rule_id, table_id): a rule names its table by dataset id, table id or table name.

    Tables and datasets meet by name. All three ways are one key list, so rules are joined once.
    """
    t = tables.select(F.col("id").cast("string").alias("table_id"), F.col("name").alias("table_name"))
    d = datasets.select(F.col("id").cast("string").alias("dataset_id"), F.col("name").alias("table_name"))
    keys = t.join(d, "table_name").select("table_id", F.col("dataset_id").alias("key")) \
        .unionByName(t.select("table_id", F.col("table_id").alias("key"))) \
        .unionByName(t.select("table_id", F.col("table_name").alias("key"))).distinct()
    r = rules.select(F.col("id").alias("rule_id"), F.col("dataset_id").cast("string").alias("key"))
    return r.join(keys, "key").select("rule_id", "table_id").distinct()


def failed_checks(checks: DataFrame, rules: DataFrame, datasets: DataFrame, tables: DataFrame,
                  newest: int = 10) -> DataFrame:
    """The newest failed checks of every table."""
    hits = checks.where("status = 'failed'").join(rule_tables(rules, datasets, tables), "rule_id")
    order = W.partitionBy("table_id").orderBy(F.desc("created_at"), F.desc("id"))
    return hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= newest)


def score_history(checks: DataFrame, rules: DataFrame, datasets: DataFrame, tables: DataFrame,
                  oldest: int | None = None) -> DataFrame:
    """Scores of every table, oldest first, by the join over dataset ids."""
    d = datasets.select(F.col("id").alias("dataset_key"), F.col("name").alias("table_name"))
    t = tables.select(F.col("id").alias("table_id"), F.col("name").alias("table_name"))
    r = rules.select(F.col("id").alias("rule_id"), F.col("dataset_id").alias("dataset_key"))
    hits = checks.select("id", "rule_id", "score", "created_at").join(r, "rule_id").join(d, "dataset_key").join(t, "table_name")
    order = W.partitionBy("table_id").orderBy("created_at", "id")
    placed = hits.withColumn("position", F.row_number().over(order))
    return (placed if oldest is None else placed.where(F.col("position") <= oldest)) \
        .select("table_id", "position", "created_at", "score")


def test_history(results: DataFrame, tests: DataFrame) -> DataFrame:
    """Test results with the table of their test."""
    t = tests.select(F.col("id").alias("test_id"), "table_id")
    return results.join(t, "test_id").select("table_id", "test_id", "timestamp", "score")


test_history.__test__ = False


def with_names(rows: DataFrame, key: str, *sources: DataFrame, out: str = "name", fallback: Column | None = None) -> DataFrame:
    """Add a name looked up by id, from the first source that knows the id, else the fallback.

    Each source has `id` and `name`.
    """
    found = []
    for i, source in enumerate(sources):
        side = source.select(F.col("id").alias(f"__id{i}"), F.col("name").alias(f"__name{i}"))
        rows = rows.join(side, F.col(key).cast("string") == F.col(f"__id{i}").cast("string"), "left").drop(f"__id{i}")
        found.append(F.col(f"__name{i}"))
    last = fallback if fallback is not None else F.lit("Unknown")
    return rows.withColumn(out, F.coalesce(*found, last)).drop(*[f"__name{i}" for i in range(len(sources))])


def lineage(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges with the names of both ends; unknown ends stay null."""
    a = tables.select(F.col("id").alias("from_table_id"), F.col("name").alias("from_name"),
                      F.col("fully_qualified_name").alias("from_qualified"))
    b = tables.select(F.col("id").alias("to_table_id"), F.col("name").alias("to_name"),
                      F.col("fully_qualified_name").alias("to_qualified"))
    return edges.join(a, "from_table_id", "left").join(b, "to_table_id", "left")


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, out: str = "children") -> DataFrame:
    """Parents with the number of their children. Children are counted before they are joined."""
    counts = children.groupBy(F.col(child_key).alias("__fk")).agg(F.count("*").alias(out))
    return parents.join(counts, F.col(parent_key) == F.col("__fk"), "left").drop("__fk") \
        .withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def dataset_listing(tables: DataFrame, datasets: DataFrame, rules: DataFrame, stored: DataFrame) -> DataFrame:
    """Every dataset once, by name: tables with their dataset (or defaults), datasets without a table, and
    stored tables nobody has catalogued (columns name, row_count, column_count)."""
    counts = rules.groupBy(F.col("dataset_id").cast("string").alias("id")).agg(F.count("*").alias("rules"))
    t = tables.select("name", F.col("id").cast("string").alias("table_id"), F.col("row_count").alias("t_rows"),
                      F.col("column_count").alias("t_columns"), F.col("quality_score").alias("t_score"))
    d = datasets.select("name", F.col("id").cast("string").alias("dataset_id"), F.col("row_count").alias("d_rows"),
                        F.col("column_count").alias("d_columns"), F.col("quality_score").alias("d_score"), "status")
    known = t.join(d, "name", "full_outer").select(
        F.coalesce("dataset_id", "table_id").alias("id"), "name", "table_id",
        F.coalesce("status", F.lit("active")).alias("status"),
        F.coalesce("d_rows", "t_rows", F.lit(0)).cast("long").alias("row_count"),
        F.coalesce("d_columns", "t_columns", F.lit(0)).cast("long").alias("column_count"),
        F.coalesce("d_score", F.when(F.col("t_score") != 0, F.col("t_score")), F.lit(100.0)).alias("quality_score"))
    extra = stored.join(known.select("name"), "name", "left_anti").select(
        F.col("name").alias("id"), "name", F.lit(None).cast("string").alias("table_id"), F.lit("active").alias("status"),
        F.col("row_count").cast("long"), F.col("column_count").cast("long"), F.lit(100.0).alias("quality_score"))
    listed = known.unionByName(extra).join(counts, "id", "left")
    return listed.withColumn("rules", F.coalesce("rules", F.lit(0).cast("long"))).orderBy("name")


def search(q: str, limit: int = 10, **sources: tuple[DataFrame, list[str]]) -> DataFrame:
    """Case-insensitive substring search: up to `limit` hits per source, as (source, id, name).

    Each source is a DataFrame with id and name, and the columns to look in. A blank query finds nothing.
    """
    parts = []
    for source, (df, columns) in sources.items():
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(q))), F.lit(False))
        if not q.strip():
            hit = F.lit(False)
        parts.append(df.where(hit).orderBy("name", "id").limit(limit)
                     .select(F.lit(source).alias("source"), F.col("id").cast("string").alias("id"), "name"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def list_tables(tables: DataFrame, service_id=None, search_text: str = "", sort: str = "name", limit: int = 100) -> DataFrame:
    """Tables of a service by part of their name; sorted by name, quality_score or row_count."""
    out = tables
    if service_id is not None:
        out = out.where(F.col("service_id") == F.lit(service_id))
    if search_text:
        needle = F.lower(F.lit(search_text))
        out = out.where(F.contains(F.lower("name"), needle) | F.contains(F.lower("fully_qualified_name"), needle))
    order = [F.desc(sort), F.asc("name")] if sort in ("quality_score", "row_count") else [F.asc("name")]
    return out.orderBy(*order).limit(limit)


def fixed_copies(tables: DataFrame) -> DataFrame:
    """Copies written by fixes, newest first."""
    return tables.where(F.contains(F.lower("name"), F.lit("_fixed"))).orderBy(F.desc("created_at"), "name")


def newest(rows: DataFrame, limit: int, order: str = "created_at", **equal) -> DataFrame:
    """Rows with the given column values, newest first."""
    for name, wanted in equal.items():
        if wanted is not None:
            rows = rows.where(F.col(name) == F.lit(wanted))
    return rows.orderBy(F.desc(order), F.desc("id")).limit(limit)
