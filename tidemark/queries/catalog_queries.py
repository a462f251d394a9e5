"""Catalog joins, scores, alerts and listings. Orders stand for check results, customers for rules,
nations for datasets and tables; events are a second set of results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import catalog, results
from .registry import load, query

CHECKS = """checks AS (SELECT o_orderkey AS id, o_custkey AS rule_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'passed' ELSE 'warning' END AS status,
    greatest(0, 100 - o_totalprice / 5000) AS score, o_orderpriority AS message, o_orderdate AS created_at FROM orders),
    rules AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS severity, c_nationkey AS dataset_id FROM customer),
    datasets AS (SELECT n_nationkey AS id, n_name AS name FROM nation),
    tables AS (SELECT 't' || n_nationkey AS id, n_name AS name, 'demo.' || n_name AS fully_qualified_name, n_regionkey AS service_id FROM nation)"""


def checks(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "passed").otherwise("warning")
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("rule_id"), status.alias("status"),
        F.greatest(F.lit(0.0), 100 - F.col("o_totalprice") / 5000).alias("score"), F.col("o_orderpriority").alias("message"),
        F.col("o_orderdate").alias("created_at"))


def rules(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                              F.col("c_mktsegment").alias("severity"), F.col("c_nationkey").alias("dataset_id"))


def datasets(spark, sf):
    return load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def tables(spark, sf):
    return load(spark, sf, "nation").select(
        F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("demo."), "n_name").alias("fully_qualified_name"), F.col("n_regionkey").alias("service_id"))


RESULTS = """r AS (SELECT event_id AS id, user_id AS rule_id, event_type AS table_name, event_type AS dataset_id,
    CASE event_type WHEN 'click' THEN 'completeness' WHEN 'view' THEN 'freshness' WHEN 'error' THEN 'volume' ELSE 'other' END AS check_type,
    CASE WHEN value > 20 THEN 'failed' ELSE 'passed' END AS status, greatest(0, 100 - value) AS score, floor(value)::BIGINT AS records_failed,
    CASE WHEN value > 60 THEN 'value too high' ELSE '' END AS message, ts AS created_at FROM events)"""


def outcomes(spark, sf):
    kind = F.when(F.col("event_type") == "click", "completeness").when(F.col("event_type") == "view", "freshness") \
        .when(F.col("event_type") == "error", "volume").otherwise("other")
    return load(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("rule_id"), F.col("event_type").alias("table_name"),
        F.col("event_type").alias("dataset_id"), kind.alias("check_type"),
        F.when(F.col("value") > 20, "failed").otherwise("passed").alias("status"),
        F.greatest(F.lit(0.0), 100 - F.col("value")).alias("score"), F.floor("value").cast("long").alias("records_failed"),
        F.when(F.col("value") > 60, "value too high").otherwise("").alias("message"), F.col("ts").alias("created_at"))


# ---- joins ----------------------------------------------------------------------------------------------

@query("failed_checks_per_table", f"""WITH {CHECKS} SELECT t.id AS table_id, c.id, c.created_at FROM checks c JOIN rules r ON c.rule_id = r.id
    JOIN datasets d ON r.dataset_id = d.id JOIN tables t ON t.name = d.name WHERE c.status = 'failed'
    QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY c.created_at DESC, c.id DESC) <= 10""")
def failed_checks_per_table(spark, sf):
    return catalog.failed_checks(checks(spark, sf), rules(spark, sf), datasets(spark, sf), tables(spark, sf)).select("table_id", "id", "created_at")


@query("failed_checks_by_table_name", f"""WITH {CHECKS} SELECT t.id AS table_id, c.id FROM checks c JOIN rules r ON c.rule_id = r.id JOIN tables t ON t.name = 'NATION_' || r.dataset_id
    WHERE c.status = 'failed' QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY c.created_at DESC, c.id DESC) <= 10""")
def failed_checks_by_table_name(spark, sf):
    named = rules(spark, sf).withColumn("dataset_id", F.concat(F.lit("NATION_"), F.col("dataset_id").cast("string")))
    return catalog.failed_checks(checks(spark, sf), named, datasets(spark, sf), tables(spark, sf)).select("table_id", "id")


@query("score_history", f"""WITH {CHECKS} SELECT table_id, position, created_at, score FROM (SELECT t.id AS table_id, c.created_at, c.score,
    row_number() OVER (PARTITION BY t.id ORDER BY c.created_at, c.id)::INT AS position FROM checks c JOIN rules r ON c.rule_id = r.id
    JOIN datasets d ON r.dataset_id = d.id JOIN tables t ON t.name = d.name)""")
def score_history(spark, sf):
    return catalog.score_history(checks(spark, sf), rules(spark, sf), datasets(spark, sf), tables(spark, sf))


@query("test_result_history", "SELECT c_nationkey AS table_id, o_custkey AS test_id, o_orderdate AS timestamp, o_totalprice AS score FROM orders JOIN customer ON c_custkey = o_custkey")
def test_result_history(spark, sf):
    found = load(spark, sf, "orders").select(F.col("o_custkey").alias("test_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("score"))
    tests = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("table_id"))
    return catalog.test_history(found, tests)


@query("checks_with_dataset_names", """SELECT s_suppkey, coalesce(n.n_name, r.r_name, k) AS dataset FROM (SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN s_nationkey::VARCHAR
    WHEN s_nationkey < 23 THEN 'r' || (s_nationkey - 20) ELSE 'raw' || s_nationkey END AS k FROM supplier) LEFT JOIN nation n ON k = n.n_nationkey::VARCHAR LEFT JOIN region r ON k = 'r' || r.r_regionkey""")
def checks_with_dataset_names(spark, sf):
    key = F.col("s_nationkey")
    named = F.when(key < 20, key.cast("string")).when(key < 23, F.concat(F.lit("r"), (key - 20).cast("string"))).otherwise(F.concat(F.lit("raw"), key.cast("string")))
    rows = load(spark, sf, "supplier").select("s_suppkey", named.alias("k"))
    regions = load(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"))
    return catalog.with_names(rows, "k", datasets(spark, sf), regions, out="dataset", fallback=F.col("k")).select("s_suppkey", "dataset")


@query("lineage_names", """SELECT s_suppkey AS id, a.n_name AS from_name, b.n_name AS to_name, 'demo.' || b.n_name AS to_qualified FROM supplier
    LEFT JOIN nation a ON a.n_nationkey = s_nationkey LEFT JOIN nation b ON b.n_nationkey = s_suppkey""")
def lineage_names(spark, sf):
    edges = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("from_table_id"),
                                               F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("to_table_id"))
    return catalog.lineage(edges, tables(spark, sf)).select("id", "from_name", "to_name", "to_qualified")


@query("dataset_listing", """WITH t AS (SELECT n_name AS name, n_nationkey::VARCHAR AS table_id, n_regionkey::BIGINT AS row_count FROM nation WHERE n_regionkey < 3),
    d AS (SELECT n_name AS name, 'd' || n_nationkey AS dataset_id, 10::BIGINT AS row_count FROM nation WHERE n_regionkey > 1),
    k AS (SELECT coalesce(dataset_id, table_id) AS id, coalesce(t.name, d.name) AS name, table_id, coalesce(d.row_count, t.row_count) AS row_count FROM t FULL JOIN d ON t.name = d.name),
    u AS (SELECT * FROM k UNION ALL SELECT r_name, r_name, NULL, 7 FROM region)
    SELECT id, name, table_id, row_count, (SELECT count(*) FROM customer WHERE c_nationkey::VARCHAR = u.id) AS rules FROM u""")
def dataset_listing(spark, sf):
    n = load(spark, sf, "nation")
    t = n.where("n_regionkey < 3").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("row_count"),
                                          F.lit(3).alias("column_count"), F.lit(90.0).alias("quality_score"))
    d = n.where("n_regionkey > 1").select(F.col("n_name").alias("name"), F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("id"),
                                          F.lit(10).alias("row_count"), F.lit(4).alias("column_count"), F.lit(80.0).alias("quality_score"), F.lit("active").alias("status"))
    stored = load(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit(7).alias("row_count"), F.lit(2).alias("column_count"))
    return catalog.dataset_listing(t, d, rules(spark, sf), stored).select("id", "name", "table_id", "row_count", "rules")


@query("child_counts", "SELECT n_nationkey, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def child_counts(spark, sf):
    return catalog.child_counts(load(spark, sf, "nation").select("n_nationkey", "n_name"), load(spark, sf, "supplier"), "n_nationkey", "s_nationkey", "suppliers")


@query("run_names", "SELECT o_orderkey, coalesce(c_name, 'Unknown') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey")
def run_names(spark, sf):
    known = load(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return catalog.with_names(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", known).select("o_orderkey", "name")


# ---- scores and reports ---------------------------------------------------------------------------------

@query("composite_score", f"WITH {RESULTS} SELECT round(avg(score), 1) AS overall_score FROM r")
def composite_score(spark, sf):
    return results.composite_score(outcomes(spark, sf))


WEIGHT = "CASE check_type WHEN 'completeness' THEN 20 WHEN 'freshness' THEN 15 ELSE 10 END"


@query("composite_score_weighted", f"WITH {RESULTS} SELECT round(sum({WEIGHT} * score) / sum({WEIGHT}), 1) AS overall_score FROM r")
def composite_score_weighted(spark, sf):
    return results.composite_score(outcomes(spark, sf), weighted=True)


@query("table_scores", f"""WITH {RESULTS} SELECT table_name, round(avg(score), 1) AS overall_score, count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS passed,
    count(*) FILTER (WHERE status <> 'passed') AS failed FROM r GROUP BY 1""")
def table_scores(spark, sf):
    return results.table_scores(outcomes(spark, sf))


@query("recent_dataset_scores", f"""WITH {RESULTS} SELECT dataset_id, round(avg(score), 1) AS quality_score, max(created_at) AS last_checked
    FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, id DESC) <= 10) GROUP BY 1""")
def recent_dataset_scores(spark, sf):
    return results.recent_dataset_scores(outcomes(spark, sf))


@query("alerts_from_failures", f"""WITH {RESULTS} SELECT 'Check failed: ' || coalesce(c_name, 'Unknown') AS title, message, coalesce(c_mktsegment, 'error') AS severity,
    'test_failure' AS alert_type, table_name AS source, 'active' AS status, created_at FROM r LEFT JOIN customer ON c_custkey = rule_id WHERE status = 'failed'""")
def alerts_from_failures(spark, sf):
    return results.alerts(outcomes(spark, sf), rules(spark, sf))


@query("platform_stats", f"""WITH {RESULTS} SELECT (SELECT count(*) FROM region) AS total_services, (SELECT count(*) FROM nation) AS total_tables, (SELECT count(*) FROM customer) AS total_tests,
    (SELECT count(*) FROM r WHERE status = 'failed') AS total_alerts, (SELECT count(*) FROM supplier) AS total_teams, (SELECT count(*) FROM nation WHERE n_regionkey < 2) AS fresh_tables,
    (SELECT count(*) FROM nation WHERE n_regionkey >= 2) AS stale_tables, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-19') AS recent_activity, count(*) AS total_results,
    count(*) FILTER (WHERE status = 'failed') AS failed_tests, round((count(*) FILTER (WHERE status = 'passed'))::DOUBLE / count(*) * 100, 1) AS tests_pass_rate, round(avg(score), 1) AS average_quality_score FROM r""")
def platform_stats(spark, sf):
    done = outcomes(spark, sf)
    t = tables(spark, sf).withColumn("quality_score", F.lit(90.0)).withColumn("freshness_status", F.when(F.col("service_id") < 2, "fresh").otherwise("stale"))
    active = done.where("status = 'failed'").withColumn("status", F.lit("active"))
    activity = load(spark, sf, "events").select(F.col("ts").alias("timestamp"))
    return results.platform_stats(done, rules(spark, sf), t, load(spark, sf, "region"), load(spark, sf, "supplier"), active, activity, datetime(2024, 1, 20))


@query("daily_pass_fail", f"""WITH {RESULTS}
    SELECT created_at::DATE AS date, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status <> 'passed') AS failed FROM r GROUP BY 1 ORDER BY 1 DESC LIMIT 14""")
def daily_pass_fail(spark, sf):
    return results.daily_series(outcomes(spark, sf))


@query("check_report", f"""WITH {RESULTS}, a AS (SELECT table_name, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status <> 'passed') AS failed,
      count(*) AS total, round(avg(score), 1) AS average_score FROM r GROUP BY 1)
    SELECT *, 'Table ''' || table_name || ''': ' || passed || '/' || total || ' checks passed, average score ' || average_score || '%.' AS summary,
      CASE WHEN failed = 0 THEN 'Every check passed.' ELSE failed || ' of ' || total || ' checks failed' END AS diagnosis,
      CASE WHEN failed = 0 THEN 'Nothing to mend; keep the schedule of checks.' ELSE 'Mend the ' || failed || ' failed checks, least score first, then run them again.' END AS action_plan FROM a""")
def check_report(spark, sf):
    return results.check_report(outcomes(spark, sf))


@query("failure_lines", f"""WITH {RESULTS} SELECT table_name, id, '- ' || CASE WHEN message = '' THEN 'score=' || round(score, 2) || ', records_failed=' || records_failed ELSE message END AS line FROM r WHERE status = 'failed'""")
def failure_lines(spark, sf):
    rows = outcomes(spark, sf).withColumn("score", F.round("score", 2))
    return results.failure_lines(rows)


@query("latest_per_key", "SELECT user_id, ts, event_id FROM (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def latest_per_key(spark, sf):
    return results.latest_per_key(load(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts").select("user_id", "ts", "event_id")


# ---- listings -------------------------------------------------------------------------------------------

@query("catalog_search", """SELECT 'tables' AS source, 't' || n_nationkey AS id, n_name AS name FROM (SELECT * FROM nation WHERE lower(n_name) LIKE '%on_1%' ORDER BY n_name, n_nationkey LIMIT 10)
    UNION ALL SELECT 'services', r_regionkey::VARCHAR, r_name FROM (SELECT * FROM region WHERE lower(r_name) LIKE '%on_1%')
    UNION ALL SELECT 'glossary', p_partkey::VARCHAR, p_name FROM (SELECT * FROM part WHERE contains(lower(p_name || ' on_1' || p_size), 'on_1') ORDER BY p_name, p_partkey::VARCHAR LIMIT 10)""".replace("LIKE '%on_1%'", "LIKE '%on\\_1%' ESCAPE '\\'"))
def catalog_search(spark, sf):
    services = load(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    terms = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
                                           F.concat("p_name", F.lit(" on_1"), F.col("p_size").cast("string")).alias("description"))
    return catalog.search("ON_1", tables=(tables(spark, sf), ["name", "fully_qualified_name"]), services=(services, ["name"]), glossary=(terms, ["name", "description"]))


@query("table_listing", """SELECT 't' || n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 1 AND n_name LIKE '%NATION%' ORDER BY n_name LIMIT 100""")
def table_listing(spark, sf):
    return catalog.list_tables(tables(spark, sf), service_id=1, search_text="nation").select("id", "name")


@query("table_listing_by_rows", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS quality_score FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 25")
def table_listing_by_rows(spark, sf):
    df = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("quality_score"))
    return catalog.list_tables(df, sort="quality_score", limit=25)


@query("fixed_copy_listing", "SELECT o_orderkey AS id, 'orders_fixed_v' || o_orderkey AS name, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F'")
def fixed_copy_listing(spark, sf):
    key = F.col("o_orderkey").cast("string")
    named = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("orders_fixed_v"), key)).otherwise(F.concat(F.lit("orders_"), key))
    return catalog.fixed_copies(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), named.alias("name"), F.col("o_orderdate").alias("created_at")))


@query("newest_by_status", f"WITH {RESULTS} SELECT id, created_at, status FROM r WHERE status = 'failed' AND table_name = 'error' ORDER BY created_at DESC, id DESC LIMIT 100")
def newest_by_status(spark, sf):
    return catalog.newest(outcomes(spark, sf), 100, status="failed", table_name="error").select("id", "created_at", "status")
