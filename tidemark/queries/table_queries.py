"""Sources, sinks, history, transform sequences, SQL, ordered operators and streams."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from ..functions.columns import as_number
from ..operators import ordering
from ..operators.transforms import apply_transform, list_transforms
from ..operators.values import duplicate_rows
from ..plans import steps
from ..plans import sql as guarded
from ..sources import readers, tables
from ..sources.history import History
from ..sources.scratch import fresh_path
from ..streaming import quality
from .registry import GAPPY, gappy, load, query, rounded

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def register_all(spark, sf, names=tuple(TABLES)):
    for name in names:
        load(spark, sf, name).createOrReplaceTempView(name)


# ---- scans and sinks ------------------------------------------------------------------------------------

@query("csv_round_trip", f"WITH {GAPPY} SELECT o_orderkey, o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM g")
def csv_round_trip(spark, sf):
    df = gappy(spark, sf).select("o_orderkey", "o_totalprice", F.coalesce("o_orderpriority", F.lit("N/A")).alias("o_orderpriority"),
                                 F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return readers.read_csv(spark, tables.save(df, fresh_path(spark, "csv"), "csv"))


@query("csv_quoted_text", "SELECT doc_id, lang, text FROM documents")
def csv_quoted_text(spark, sf):
    path = fresh_path(spark, "csv")
    df = load(spark, sf, "documents").select("doc_id", "lang", "text")
    df.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_csv(spark, path, schema=df.schema)


@query("csv_split_text", "SELECT doc_id, source, text FROM documents")
def csv_split_text(spark, sf):
    """Texts with line breaks and quotes, each file read by as many tasks as it has ranges."""
    path = fresh_path(spark, "csv")
    df = load(spark, sf, "documents").select("doc_id", "source", "text")
    df.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_csv(spark, path, schema=df.schema, split=True)


@query("object_by_key", "SELECT e_key, ts, event_type FROM (SELECT event_id AS e_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM events)")
def object_by_key(spark, sf):
    """A bucket and key of the store that holds the scratch folder; types are found in the text."""
    df = load(spark, sf, "events").select(F.col("event_id").alias("e_key"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type")
    place = urlsplit(tables.save(df, f"{fresh_path(spark, 'bucket')}/events.csv", "csv"))
    return readers.read_object(spark, place.netloc, place.path, place.scheme or "file")


@query("json_round_trip", f"WITH {GAPPY} SELECT o_orderkey, o_totalprice, o_orderpriority FROM g")
def json_round_trip(spark, sf):
    path = tables.save(gappy(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority"), fresh_path(spark, "json"), "json")
    return readers.read_json(spark, path, lines=True).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("load_by_name", "SELECT * FROM supplier")
def load_by_name(spark, sf):
    return tables.load(spark, "supplier", sf)


@query("parquet_round_trip", "SELECT * FROM events")
def parquet_round_trip(spark, sf):
    return spark.read.parquet(tables.save(load(spark, sf, "events"), fresh_path(spark, "table")))


@query("register_clean_names", """SELECT p_partkey AS col_1st_key, p_name AS p_name_, (p_size > 25)::INT AS is_big FROM part""")
def register_clean_names(spark, sf):
    df = load(spark, sf, "part").select(F.col("p_partkey").alias("1st key"), F.col("p_name").alias("p name!"), (F.col("p_size") > 25).alias("is big"))
    name = tables.register(df.toDF("1st key", "p_name?", "is-big"), "2 parts")
    return spark.table(name)


@query("table_preview", "SELECT count(*) AS total, least(count(*), 50) AS shown, count(*) > 50 AS truncated FROM supplier")
def table_preview(spark, sf):
    head, total, truncated = tables.preview(load(spark, sf, "supplier"))
    return head.agg(F.lit(total).cast("long").alias("total"), F.count("*").alias("shown"), F.lit(truncated).alias("truncated"))


@query("preview_every_table", " UNION ALL ".join(f"SELECT '{t}' AS name, least(count(*), 20) AS rows FROM {t}" for t in TABLES))
def preview_every_table(spark, sf):
    register_all(spark, sf)
    whole = None
    for name, head in tables.preview_all(spark, TABLES).items():
        part = head.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query("table_inventory", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS row_count, (SELECT count(*)::INT FROM (DESCRIBE {t})) AS column_count FROM {t}" for t in TABLES))
def table_inventory(spark, sf):
    register_all(spark, sf)
    return tables.list_tables(spark, TABLES).drop("columns")


@query("ingest_file", f"""WITH {GAPPY} SELECT 'o_orderkey' AS "column", 'integer' AS type, (SELECT count(*) - count(o_orderkey) FROM g) AS null_count""" +
       " UNION ALL SELECT 'o_totalprice', 'float', (SELECT count(*) - count(o_totalprice) FROM g) UNION ALL SELECT 'day', 'datetime', 0 "
       "UNION ALL SELECT 'o_orderpriority', 'string', (SELECT count(*) - count(o_orderpriority) FROM g)")
def ingest_file(spark, sf):
    df = gappy(spark, sf).select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    path = tables.save(df, fresh_path(spark, "upload"), "csv")
    return tables.ingest(spark, path, "uploaded orders")["profile"].select("column", "type", "null_count")


@query("snapshot_rollback", "SELECT * FROM customer")
def snapshot_rollback(spark, sf):
    past = History(spark, fresh_path(spark, "history"), "customer")
    df = load(spark, sf, "customer")
    first = past.save_snapshot(df, "outlier", {"method": "iqr_remove"})
    past.save_snapshot(df.where("c_acctbal > 0"), "dedup")
    return past.rollback(first)


@query("undo_last", "SELECT * FROM customer WHERE c_acctbal > 0")
def undo_last(spark, sf):
    past = History(spark, fresh_path(spark, "history"), "customer")
    df = load(spark, sf, "customer")
    past.save_snapshot(df, "outlier")
    past.save_snapshot(df.where("c_acctbal > 0"), "dedup")
    return past.rollback_last()


@query("snapshot_history", """SELECT 'outlier' AS transform_type, count(*) AS rows FROM customer UNION ALL SELECT 'dedup', count(*) FILTER (WHERE c_acctbal > 0) FROM customer""")
def snapshot_history(spark, sf):
    past = History(spark, fresh_path(spark, "history"), "customer")
    df = load(spark, sf, "customer")
    past.save_snapshot(df, "outlier")
    past.save_snapshot(df.where("c_acctbal > 0"), "dedup")
    past.save_snapshot(df, "encoding")
    past.rollback_last()
    return past.history().select("transform_type", "rows")


@query("snapshot_storage", """SELECT 3 AS snapshots, (SELECT count(*) FROM orders) * 3 AS named_rows, (SELECT count(*) FROM orders) * 2 AS stored_rows""")
def snapshot_storage(spark, sf):
    """Twice the same rows, in another order the second time, then a value changed in every row."""
    past = History(spark, fresh_path(spark, "history"), "orders")
    df = load(spark, sf, "orders")
    past.save_snapshot(df, "dedup")
    past.save_snapshot(df.repartition(5, "o_custkey"), "dedup")
    past.save_snapshot(df.withColumn("o_totalprice", -F.col("o_totalprice") - 1), "outlier")
    return past.usage()


@query("append_results", "SELECT event_type, count(*) * 2 AS n FROM events GROUP BY 1")
def append_results(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "event_type")
    path = fresh_path(spark, "results")
    for _ in range(2):
        tables.append(rows, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("fixed_copies", """SELECT '_fixed' AS ending, count(*) AS rows, sum(c_custkey)::BIGINT AS keys FROM customer
    UNION ALL SELECT '_fixed_v2', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_acctbal > 0""")
def fixed_copies(spark, sf):
    """Two fixed copies of customer; the second is made from the name of the first. Their tables go once they are counted."""
    df, base = load(spark, sf, "customer"), f"customer_{uuid.uuid4().hex}"
    first = tables.save_copy(df, base)
    made = [first, tables.save_copy(df.where("c_acctbal > 0"), first)]
    counts = [spark.table(t).agg(F.count("*"), F.sum("c_custkey")).first() for t in made]
    for t in made:
        spark.sql(f"DROP TABLE {t}")
    return spark.createDataFrame([(t[len(base):], *c) for t, c in zip(made, counts)], "ending string, rows bigint, keys bigint")


# ---- sequences ------------------------------------------------------------------------------------------

@query("transform_batch", f"""WITH {GAPPY}, f AS (SELECT o_orderkey, o_orderstatus, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM g)) AS p FROM g),
    a AS (SELECT min(p) lo, max(p) hi FROM f) SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, round((p - lo) / (hi - lo), 6) AS o_totalprice FROM f, a""")
def transform_batch(spark, sf):
    df = gappy(spark, sf).select("o_orderkey", "o_orderstatus", "o_totalprice")
    done = steps.run_batch(df, [("imputation", {"column": "o_totalprice"}), ("string_clean", {"method": "lowercase"}),
                                ("date_parse", {"column": "none"}), ("minmax", {"column": "o_totalprice"})])
    return rounded(done["df"])


@query("conditional_steps", "SELECT DISTINCT lower(event_type) AS event_type, user_id FROM events")
def conditional_steps(spark, sf):
    seq = steps.Sequence("s1", "clean events")
    seq.add("string_clean", {"method": "lowercase", "column": "event_type"})
    seq.add("dedup", {}, condition="check_passed")
    seq.add("string_clean", {"method": "uppercase", "column": "event_type"}, condition="check_failed")
    seq.add("outlier", {"column": "user_id", "multiplier": 0}, condition="score > 80")
    copy = steps.Sequence.from_dict(seq.to_dict())
    return steps.run_sequence(load(spark, sf, "events").select("event_type", "user_id"), copy)["df"]


@query("step_statuses", """SELECT step, status FROM (VALUES (0, 'success'), (1, 'failed'), (2, 'success'), (3, 'skipped')) t(step, status),
    (SELECT count(*) n FROM events) WHERE n > 0""")
def step_statuses(spark, sf):
    seq = steps.Sequence("s2", "statuses")
    seq.add("string_clean", {"column": "event_type"})
    seq.add("normalization", {"columns": ["event_type"]})
    seq.add("dedup", {}, condition="check_failed")
    seq.add("dedup", {}, condition="check_failed")
    done = steps.run_sequence(load(spark, sf, "events").select("event_type", "user_id"), seq)
    return spark.createDataFrame([(i, s["status"]) for i, s in enumerate(done["steps"])], "step int, status string")


@query("every_transform_by_name", """SELECT count(*) * 9 AS rows FROM nation""")
def every_transform_by_name(spark, sf):
    whole = None
    for t in list_transforms():
        config = {"test_size": 0.0} if t["type"] == "data_split" else {"multiplier": 100, "columns": ["n_name" if t["type"] in ("date_parse", "type_conversion", "string_clean") else "n_nationkey"], "method": {"type_conversion": "to_string"}.get(t["type"])}
        part = apply_transform(load(spark, sf, "nation"), t["type"], config).df.agg(F.count("*").alias("n"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.agg(F.sum("n").alias("rows"))


# ---- SQL ------------------------------------------------------------------------------------------------

def sql_query(name: str, text: str, duck: str | None = None) -> None:
    @query(name, duck or text)
    def run(spark, sf):
        register_all(spark, sf)
        return guarded.query(spark, text)


sql_query("sql_filter_like", "SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE '%7' AND s_name NOT LIKE '%77' ORDER BY s_suppkey")
sql_query("sql_top_by_value", "SELECT o_custkey, MAX(o_totalprice) AS largest_order FROM orders GROUP BY o_custkey ORDER BY largest_order DESC, o_custkey LIMIT 25")
sql_query("sql_group_totals", "SELECT c_nationkey, COUNT(*) AS in_debt, ROUND(MIN(c_acctbal), 2) AS deepest FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey HAVING COUNT(*) > 1 ORDER BY c_nationkey")
sql_query("sql_two_conditions", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice BETWEEN 100000 AND 120000 ORDER BY o_orderkey")
sql_query("sql_join_two_tables", "SELECT c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 9900 ORDER BY c.c_name LIMIT 1000")
sql_query("sql_top_products", "SELECT p.p_brand, COUNT(*) AS lines_sent_back, ROUND(AVG(l.l_discount), 4) AS mean_discount FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE l.l_returnflag = 'R' GROUP BY p.p_brand ORDER BY lines_sent_back DESC, p.p_brand LIMIT 12")
sql_query("sql_monthly_trend", "SELECT substr(CAST(o_orderdate AS STRING), 1, 4) AS year, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders, COUNT(*) AS placed FROM orders GROUP BY 1 ORDER BY year",
          "SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS year, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders, COUNT(*) AS placed FROM orders GROUP BY 1 ORDER BY year")
sql_query("sql_group_averages", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS buyers, ROUND(AVG(o_totalprice), 2) AS mean_price FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus")
sql_query("sql_two_keys", "SELECT l_linestatus, l_linenumber, COUNT(*) AS small_lines FROM lineitem WHERE l_quantity < 10 GROUP BY l_linestatus, l_linenumber ORDER BY l_linestatus, l_linenumber")
sql_query("sql_not_null_totals", "SELECT event_type, COUNT(value) AS measured, ROUND(MAX(value) - MIN(value), 4) AS spread FROM events WHERE value IS NOT NULL GROUP BY event_type ORDER BY event_type")
sql_query("sql_left_join", "SELECT n.n_name, COUNT(s.s_suppkey) AS suppliers FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 GROUP BY n.n_name")
sql_query("sql_exists_joins", """SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)
    AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal < 0)""")
sql_query("sql_self_and_cross_join", """SELECT a.n_name AS first, b.n_name AS second, r.r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
    CROSS JOIN region r WHERE r.r_regionkey = a.n_regionkey""")
sql_query("sql_set_operations", """SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000
    EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0 INTERSECT SELECT n_nationkey FROM nation""")
sql_query("sql_window_functions", """WITH t AS (SELECT o_orderpriority, o_orderkey, o_totalprice, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn,
      LAG(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS above FROM orders) SELECT * FROM t WHERE rn <= 5""")
sql_query("sql_integer_division", "SELECT p_partkey div 7 AS bucket, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 1000", "SELECT p_partkey // 7 AS bucket, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 1000")


@query("sql_describe", "SELECT column_name AS col_name FROM (DESCRIBE supplier)")
def sql_describe(spark, sf):
    register_all(spark, sf)
    return guarded.query(spark, "PRAGMA table_info(supplier)").select("col_name")


@query("sql_row_limit", "SELECT least(count(*), 1000) AS rows, count(*) >= 1000 AS truncated FROM orders")
def sql_row_limit(spark, sf):
    register_all(spark, sf)
    found = guarded.query_rows(spark, "SELECT * FROM orders")
    return spark.createDataFrame([(found["row_count"], found["truncated"])], "rows bigint, truncated boolean")


# ---- ordered operators and sets -------------------------------------------------------------------------

@query("running_total", "SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM events")
def running_total(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    out = ordering.running_sum(df, "value", ["ts", "event_id"], rows_per_range=2_000)
    return out.select("event_id", F.col("running").cast("double").alias("running"))


@query("row_numbers_per_key", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_number FROM events")
def row_numbers_per_key(spark, sf):
    df = load(spark, sf, "events").select("event_id", "event_type", "ts")
    return ordering.row_numbers(df, ["ts", "event_id"], ["event_type"], rows_per_range=2_000).select("event_id", "row_number")


@query("average_ranks", "SELECT DISTINCT l_quantity AS value, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS average_rank FROM lineitem")
def average_ranks(spark, sf):
    counts = load(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("value")).agg(F.count("*").alias("n"))
    steps_up = ordering.running_sum(counts, "n", ["value"])
    return steps_up.select("value", (F.col("running") - (F.col("n") - 1) / 2).alias("average_rank"))


@query("fill_between_ranges", """SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v
    FROM (SELECT event_id, event_type, ts, CASE WHEN value > 5 THEN NULL ELSE value END AS v FROM events)""")
def fill_between_ranges(spark, sf):
    df = load(spark, sf, "events").select("event_id", "event_type", "ts", F.when(F.col("value") <= 5, F.col("value")).alias("v"))
    return ordering.fill(df, ["v"], ["ts", "event_id"], ["event_type"], rows_per_range=2_000).select("event_id", "v")


@query("fill_backward_whole_table", """SELECT event_id, coalesce(v, first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v
    FROM (SELECT event_id, ts, CASE WHEN value > 5 THEN NULL ELSE value END AS v FROM events)""")
def fill_backward_whole_table(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts", F.when(F.col("value") <= 5, F.col("value")).alias("v"))
    return ordering.fill(df, ["v"], ["ts", "event_id"], forward=False, rows_per_range=2_000).select("event_id", "v")


@query("sorted_listing", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def sorted_listing(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)


@query("duplicate_row_counts", """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS texts,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS rows FROM documents""")
def duplicate_row_counts(spark, sf):
    df = load(spark, sf, "documents")
    return spark.createDataFrame([(duplicate_rows(df, ["text"]), duplicate_rows(df, ["text", "lang", "source"]))], "texts bigint, rows bigint")


@query("numbers_from_text", "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events")
def numbers_from_text(spark, sf):
    df = load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return df.select("event_id", as_number(df, "k").alias("k"))


# ---- windows and streams --------------------------------------------------------------------------------

def metrics(rows, lateness=None):
    return quality.window_metrics(rows, "ts", "6h", present={"value": F.col("v").isNotNull()},
                                  valid={"range": F.when(F.col("v").isNotNull(), F.col("v") < 20)}, keys=["event_type"], lateness=lateness)


def watched(events):
    return events.select("ts", "event_type", F.when(F.col("value") > 1, F.col("value")).alias("v"))


METRICS = """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS volume,
    round((count(*) FILTER (WHERE value > 1))::DOUBLE / count(*) * 100, 6) AS value_completeness,
    round(CASE WHEN count(*) FILTER (WHERE value > 1) > 0 THEN (count(*) FILTER (WHERE value > 1 AND value < 20))::DOUBLE / count(*) FILTER (WHERE value > 1) * 100 ELSE 100 END, 6) AS range_validity
    FROM events GROUP BY 1, 2, 3"""


@query("quality_windows", METRICS)
def quality_windows(spark, sf):
    return naive(rounded(metrics(watched(load(spark, sf, "events")))))


@query("quality_stream", f"WITH w AS ({METRICS}) SELECT w.* FROM w, (SELECT max(ts) AS newest FROM events) WHERE window_end <= newest - INTERVAL 10 MINUTE")
def quality_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    events = quality.stream_table(spark, sf, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    path = fresh_path(spark, "windows")
    quality.run_available(metrics(watched(events), lateness="10 minutes"), path)
    return naive(rounded(spark.read.parquet(path)))


@query("quality_stream_flushed", METRICS)
def quality_stream_flushed(spark, sf):
    table = load(spark, sf, "events")
    events = quality.stream_table(spark, sf, "events.parquet", table.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    path = fresh_path(spark, "windows")
    quality.run_available(metrics(watched(events), lateness="10 minutes"), path)
    return naive(rounded(quality.with_open_windows(metrics(watched(table.withColumn("ts", F.col("ts").cast("timestamp")))), path, ["event_type"])))


def naive(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.startswith("window_") else F.col(c) for c in df.columns])
