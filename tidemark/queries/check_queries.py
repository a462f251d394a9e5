"""Checks: completeness, uniqueness, validity, freshness, schema, volume, anomaly, and their runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.columns import is_blank, not_a_number, not_in_set, not_matching, out_of_range
from ..operators import checks
from ..plans import rule_runs
from .registry import GAPPY, gappy, load, query, rounded

SHOWN = ["rule_id", "column_name", "check_type", "status", "score", "records_checked", "records_failed",
         "pass_rate", "metric_value", "threshold_value"]


def run(df, rules, **options):
    return rounded(checks.check_table(df, rules, **options).select(*SHOWN))


def rule(rule_id: str, kind: str, **config) -> dict:
    return {"id": rule_id, "name": rule_id, "type": kind, "config": config}


def verdict(rule_id: str, column: str, kind: str, passed: str, rows: str, failed: str, metric: str, threshold: str,
            source: str) -> str:
    """SQL for one result row; the arguments are expressions over one aggregated row named a."""
    return f"""SELECT '{rule_id}' AS rule_id, '{column}' AS column_name, '{kind}' AS check_type,
      CASE WHEN {passed} THEN 'passed' ELSE 'failed' END AS status,
      CASE WHEN {passed} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score, ({rows})::BIGINT AS records_checked,
      ({failed})::BIGINT AS records_failed,
      pround((({rows}) - ({failed}))::DOUBLE / ({rows}) * 100, 2) AS pass_rate,
      round(({metric})::DOUBLE, 6) AS metric_value, round(({threshold})::DOUBLE, 6) AS threshold_value
      FROM ({source}) a"""


def share(rule_id: str, column: str, kind: str, bad: str, threshold: float, table: str, of: str = "count(*)") -> str:
    src = f"SELECT count(*) n, {of} m, count(*) FILTER (WHERE {bad}) bad FROM {table}"
    metric = "CASE WHEN m = 0 THEN 100.0 ELSE (m - bad)::DOUBLE / m * 100 END"
    return verdict(rule_id, column, kind, f"({metric}) >= {threshold}", "n", "bad", metric, str(threshold), src)


def repeated(rule_id: str, column: str, threshold: float, table: str) -> str:
    src = f"SELECT sum(c) n, coalesce(sum(c) FILTER (WHERE c > 1), 0) bad FROM (SELECT count(*) c FROM {table} GROUP BY {column})"
    metric = "(n - bad)::DOUBLE / n * 100"
    return verdict(rule_id, column, "uniqueness", f"({metric}) >= {threshold}", "n", "bad", metric, str(threshold), src)


@query("check_completeness", f"WITH {GAPPY} " + " UNION ALL ".join([
    share("price", "o_totalprice", "completeness", "o_totalprice IS NULL", 95.0, "g"),
    share("priority", "o_orderpriority", "completeness", "o_orderpriority IS NULL", 75.0, "g"),
    share("key", "o_orderkey", "completeness", "o_orderkey IS NULL", 95.0, "g"),
    verdict("gone", "no_such", "completeness", "false", "n", "n", "0", "0", "SELECT count(*) n FROM g")]))
def check_completeness(spark, sf):
    return run(gappy(spark, sf), [rule("price", "completeness", column="o_totalprice"),
                                  rule("priority", "not_null", column="o_orderpriority", threshold=75),
                                  rule("key", "missing", column="o_orderkey", threshold=0),
                                  rule("gone", "completeness", column="no_such")])


@query("check_uniqueness", f"WITH {GAPPY} " + " UNION ALL ".join([
    repeated("key", "o_orderkey", 100.0, "g"), repeated("customer", "o_custkey", 100.0, "g"),
    repeated("priority", "o_orderpriority", 50.0, "g")]))
def check_uniqueness(spark, sf):
    return run(gappy(spark, sf), [rule("key", "uniqueness", column="o_orderkey"),
                                  rule("customer", "unique", column="o_custkey"),
                                  rule("priority", "duplicate", column="o_orderpriority", threshold=50)])


@query("uniqueness_top_values", """
    SELECT "column", position, value, n FROM (
      SELECT 'o_custkey' AS "column", row_number() OVER (ORDER BY n DESC, v)::INTEGER AS position, v::VARCHAR AS value, n
      FROM (SELECT o_custkey v, count(*) n FROM orders GROUP BY 1 HAVING count(*) > 1)
      UNION ALL
      SELECT 'o_orderpriority', row_number() OVER (ORDER BY n DESC, v)::INTEGER, v, n
      FROM (SELECT o_orderpriority v, count(*) n FROM orders GROUP BY 1 HAVING count(*) > 1)) WHERE position <= 5""")
def uniqueness_top_values(spark, sf):
    from ..operators import values
    counts = values.value_counts(load(spark, sf, "orders"), ["o_custkey", "o_orderpriority"]).where("n > 1")
    return values.top_values(counts, 5)


PARTS = """p AS (SELECT p_partkey, p_name, p_brand, p_size, p_retailprice,
    CASE WHEN p_type = 'ECONOMY' THEN 'n/a' ELSE substr(p_brand, 7) END AS brand_number FROM part)"""


def parts(spark, sf):
    brand = F.when(F.col("p_type") == "ECONOMY", "n/a").otherwise(F.expr("substr(p_brand, 7)"))
    return load(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice",
                                          brand.alias("brand_number"))


@query("check_validity", f"WITH {PARTS} " + " UNION ALL ".join([
    share("set", "p_brand", "validity", "p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')", 95.0, "p", "count(p_brand)"),
    share("pattern", "p_brand", "validity", "NOT regexp_matches(p_brand, '^(?:Brand#[1-9])')", 95.0, "p", "count(p_brand)"),
    share("size", "p_size", "validity", "p_size < 5 OR p_size > 45", 80.0, "p", "count(p_size)"),
    share("parsed", "brand_number", "validity",
          "try_cast(brand_number AS DOUBLE) IS NULL OR try_cast(brand_number AS DOUBLE) > 20", 95.0, "p", "count(brand_number)"),
    share("words", "p_name", "validity", "false", 95.0, "p", "count(p_name)"),
    share("broken", "p_name", "validity", "false", 95.0, "p", "count(p_name)"),
    verdict("none", "p_name", "validity", "false", "n", "n", "0", "0", "SELECT count(*) n FROM p")]))
def check_validity(spark, sf):
    return run(parts(spark, sf), [
        rule("set", "valid_values", column="p_brand", valid_values=["Brand#1", "Brand#2", "Brand#3"]),
        rule("pattern", "regex", column="p_brand", regex="Brand#[1-9]"),
        rule("size", "range", column="p_size", min_value=5, max_value=45, threshold=80),
        rule("parsed", "range", column="brand_number", max_value=20),
        rule("words", "range", column="p_name", min_value=0),
        rule("broken", "regex", column="p_name", regex="("),
        rule("none", "validity", column="p_name")])


@query("check_freshness", " UNION ALL ".join(
    verdict(i, "ts", "freshness", f"age <= {limit}", "n", "stale", "age", limit, f"""
      SELECT count(*) n, date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3600000000.0::DOUBLE age,
      count(*) FILTER (WHERE ts < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL {limit} HOUR) stale FROM events""")
    for i, limit in (("day", "24"), ("month", "720"))))
def check_freshness(spark, sf):
    return run(load(spark, sf, "events"), [rule("day", "freshness", column="ts"),
                                           rule("month", "timeliness", column="ts", threshold=720)],
               as_of=datetime(2024, 2, 1))


@query("check_freshness_day_first", verdict("day", "d", "freshness", "age <= 5000", "n", "stale", "age", "5000", """
      SELECT count(*) n, date_diff('microsecond', max(o_orderdate)::TIMESTAMP, TIMESTAMP '1999-01-01 00:00:00') / 3600000000.0::DOUBLE age,
      count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 5000 HOUR) stale FROM orders"""))
def check_freshness_day_first(spark, sf):
    """Texts such as 31/12/1998, of which some could be read with the month first as well."""
    df = load(spark, sf, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    return run(df, [rule("day", "freshness", column="d", threshold=5000)], as_of=datetime(1999, 1, 1))


@query("check_schema", " UNION ALL ".join([
    verdict("open", "", "schema", "true", "n", "0", "3", "0", "SELECT count(*) n FROM nation"),
    verdict("same", "", "schema", "true", "n", "0", "3", "3", "SELECT count(*) n FROM nation"),
    verdict("moved", "", "schema", "false", "n", "2", "2", "3", "SELECT count(*) n FROM nation")]))
def check_schema(spark, sf):
    return run(load(spark, sf, "nation"), [
        rule("open", "schema"), rule("same", "schema", valid_values=["n_nationkey", "n_name", "n_regionkey"]),
        rule("moved", "schema_change", valid_values=["n_nationkey", "n_name", "n_comment"])])


COUNTED = "SELECT count(*) n FROM orders"


@query("check_volume", " UNION ALL ".join([
    verdict("any", "", "volume", "true", "n", "0", "n", "0", COUNTED),
    verdict("range", "", "volume", "n BETWEEN 10000 AND 20000", "n", "CASE WHEN n BETWEEN 10000 AND 20000 THEN 0 ELSE n END",
            "n", "0", COUNTED),
    verdict("near", "", "volume", "abs(n - 9000) / 9000.0 * 100 <= 50",
            "n", "CASE WHEN abs(n - 9000) / 9000.0 * 100 <= 50 THEN 0 ELSE n END", "n", "9000", COUNTED)]))
def check_volume(spark, sf):
    return run(load(spark, sf, "orders"), [rule("any", "volume"), rule("range", "row_count", min_value=10000, max_value=20000),
                                           rule("near", "volume", threshold=9000)])


def zscores(rule_id: str, column: str, t: float, table: str) -> str:
    src = f"""SELECT count(*) n, count({column}) m, count(*) FILTER (WHERE abs(({column} - mu) / sd) > {t}) bad
        FROM {table}, (SELECT avg({column}) mu, stddev_samp({column}) sd FROM {table})"""
    pct = "pround(bad::DOUBLE / m * 100, 2)"
    return verdict(rule_id, column, "anomaly", f"{pct} < 5.0", "n", "bad", pct, str(t), src)


@query("check_anomaly_column", f"WITH {GAPPY} " + " UNION ALL ".join([
    zscores("three", "o_totalprice", 3.0, "g"), zscores("one", "o_totalprice", 1.0, "g")]))
def check_anomaly_column(spark, sf):
    return run(gappy(spark, sf), [rule("three", "anomaly", column="o_totalprice"),
                                  rule("one", "zscore", column="o_totalprice", threshold=1)])


@query("check_anomaly_volume", " UNION ALL ".join(
    verdict(i, "", "anomaly", f"abs(n - {e}) / {e}.0 <= {tol}", "n",
            f"CASE WHEN abs(n - {e}) / {e}.0 <= {tol} THEN 0 ELSE abs(n - {e}) END",
            f"pround(abs(n - {e})::DOUBLE / {e} * 100, 1)", f"{tol} * 100", COUNTED)
    for i, e, tol in (("default", 1000, 0.5), ("wide", 12000, 0.9))))
def check_anomaly_volume(spark, sf):
    return run(load(spark, sf, "orders"), [rule("default", "drift"), rule("wide", "outlier", threshold=12000, max_value=0.9)])


@query("check_expression", share("early", "", "expression", "NOT (o_orderdate < TIMESTAMP '2000-01-01')", 95.0, "orders"))
def check_expression(spark, sf):
    return run(load(spark, sf, "orders"), [rule("early", "expression", expression="o_orderdate < timestamp_ntz'2000-01-01'")])


@query("check_of_ones_own", """SELECT 'even' AS rule_id, 'even_keys' AS check_type, count(*) AS records_checked, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS records_failed FROM orders
    UNION ALL SELECT 'low', 'even_keys', count(*), count(*) FILTER (WHERE o_custkey % 2 <> 0) FROM orders
    UNION ALL SELECT 'full', 'completeness', count(*), count(*) FILTER (WHERE o_totalprice IS NULL) FROM orders""")
def check_of_ones_own(spark, sf):
    """A registered check, used twice in one batch with a check of the library; it joins their aggregation."""
    checks.register_check("even_keys", lambda df, config: [F.count_if(F.col(config["column"]) % 2 != 0)],
                          lambda config, got, rows: (got[0] == 0, got[0], float(got[0]), 0.0, "odd keys"))
    try:
        rules = [rule("even", "even_keys", column="o_orderkey"), rule("low", "even_keys", column="o_custkey"), rule("full", "completeness", column="o_totalprice")]
        return checks.check_table(load(spark, sf, "orders"), rules).select("rule_id", "check_type", "records_checked", "records_failed")
    finally:
        checks.CUSTOM.pop("even_keys")


LINE_RULES = [
    rule("qty_full", "completeness", column="l_quantity"), rule("qty_range", "range", column="l_quantity", min_value=1, max_value=45),
    rule("flag_set", "valid_values", column="l_returnflag", valid_values=["A", "N"]),
    rule("status_pattern", "regex", column="l_linestatus", regex="[FO]"), rule("order_unique", "uniqueness", column="l_orderkey"),
    rule("price_odd", "anomaly", column="l_extendedprice", threshold=2), rule("rows", "volume", min_value=1),
    rule("ship_fresh", "freshness", column="l_shipdate", threshold=100000)]


@query("check_rule_batch", " UNION ALL ".join([
    share("qty_full", "l_quantity", "completeness", "l_quantity IS NULL", 95.0, "lineitem"),
    share("qty_range", "l_quantity", "validity", "l_quantity < 1 OR l_quantity > 45", 95.0, "lineitem"),
    share("flag_set", "l_returnflag", "validity", "l_returnflag NOT IN ('A', 'N')", 95.0, "lineitem"),
    share("status_pattern", "l_linestatus", "validity", "NOT regexp_matches(l_linestatus, '^(?:[FO])')", 95.0, "lineitem"),
    repeated("order_unique", "l_orderkey", 100.0, "lineitem"), zscores("price_odd", "l_extendedprice", 2.0, "lineitem"),
    verdict("rows", "", "volume", "n >= 1", "n", "0", "n", "0", "SELECT count(*) n FROM lineitem"),
    verdict("ship_fresh", "l_shipdate", "freshness", "age <= 100000", "n", "stale", "age", "100000", """
      SELECT count(*) n, date_diff('microsecond', max(l_shipdate), TIMESTAMP '2010-01-01') / 3600000000.0::DOUBLE age,
      count(*) FILTER (WHERE l_shipdate < TIMESTAMP '2010-01-01' - INTERVAL 100000 HOUR) stale FROM lineitem""")]))
def check_rule_batch(spark, sf):
    return run(load(spark, sf, "lineitem"), LINE_RULES, as_of=datetime(2010, 1, 1))


@query("check_rule_batch_totals", """
    SELECT 3::BIGINT AS total, ((SELECT (count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 45))::DOUBLE / count(*) <= 0.05 FROM lineitem)::INT
      + 1 + (SELECT count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N'))::DOUBLE / count(*) <= 0.05 FROM lineitem)::INT)::BIGINT AS passed""")
def check_rule_batch_totals(spark, sf):
    done = rule_runs.run_all(load(spark, sf, "lineitem"), LINE_RULES[:3])
    return spark.createDataFrame([(done["total"], done["passed"])], "total bigint, passed bigint")


@query("check_single_rule", f"WITH {GAPPY} " +
       share("price", "o_totalprice", "completeness", "o_totalprice IS NULL", 90.0, "g"))
def check_single_rule(spark, sf):
    one = rule_runs.run_one(spark, rule("price", "completeness", column="o_totalprice", threshold=90), "orders", gappy(spark, sf))
    return rounded(one.select(*SHOWN))


@query("check_profile_estimate", f"""WITH {GAPPY}, prof AS (
      SELECT count(*) n, count(*) - count(o_totalprice) nulls, count(DISTINCT o_custkey) d FROM g)
    SELECT 'full' AS rule_id, CASE WHEN 100 - pround(nulls::DOUBLE / n * 100, 2) >= 95 THEN 'passed' ELSE 'failed' END AS status,
      round(100 - pround(nulls::DOUBLE / n * 100, 2), 6) AS score, n AS records_checked, nulls AS records_failed FROM prof
    UNION ALL SELECT 'once', CASE WHEN d::DOUBLE / n * 100 >= 95 THEN 'passed' ELSE 'failed' END, round(d::DOUBLE / n * 100, 6),
      n, n - d FROM prof
    UNION ALL SELECT 'other', 'passed', 100.0, n, 0 FROM prof""")
def check_profile_estimate(spark, sf):
    from ..operators import profile
    df = gappy(spark, sf).select("o_custkey", "o_totalprice")
    rows, _ = profile.moments(df)
    stored = profile.data_profile(df).withColumn("row_count", F.lit(rows))
    rules = spark.createDataFrame(
        [("full", "completeness", "o_totalprice", None), ("once", "uniqueness", "o_custkey", None), ("other", "volume", "", None)],
        "rule_id string, check_type string, column_name string, threshold double")
    whole = checks.profile_estimates(rules, stored)
    other = whole.withColumn("records_checked", F.when(F.col("rule_id") == "other", F.lit(rows)).otherwise(F.col("records_checked")))
    return rounded(other.select("rule_id", "status", "score", "records_checked", "records_failed"))


@query("failed_row_sample", """SELECT p_size, p_partkey, p_name, p_brand FROM part WHERE p_size > 45
    ORDER BY p_partkey LIMIT 10""")
def failed_row_sample(spark, sf):
    df = load(spark, sf, "part")
    return checks.failed_sample(df, out_of_range(df, "p_size", high=45), "p_size", ["p_partkey"])


@query("predicate_missing_or_blank", f"""WITH {GAPPY} SELECT o_orderkey FROM g
    WHERE o_orderpriority IS NULL OR trim(o_orderpriority) = ''""")
def predicate_missing_or_blank(spark, sf):
    df = gappy(spark, sf)
    return df.where(is_blank(df, "o_orderpriority")).select("o_orderkey")


@query("predicate_not_in_set", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def predicate_not_in_set(spark, sf):
    df = load(spark, sf, "events")
    return df.where(not_in_set(df, "event_type", ["click", "view"])).select("event_id", "event_type")


@query("predicate_pattern", """SELECT c_custkey, c_name FROM customer
    WHERE NOT regexp_matches(c_name, '^(?:Customer#0000001)')""")
def predicate_pattern(spark, sf):
    df = load(spark, sf, "customer")
    return df.where(not_matching(df, "c_name", "Customer#0000001")).select("c_custkey", "c_name")


@query("predicate_nested_class", r"""SELECT c_custkey, c_name FROM customer
    WHERE NOT regexp_matches(c_name, '^(?:[C\[]ustomer#0+[1-4\[&\]]\d*$)')""")
def predicate_nested_class(spark, sf):
    """Brackets and && are plain characters of a class."""
    df = load(spark, sf, "customer")
    return df.where(not_matching(df, "c_name", r"[C[]ustomer#0+[1-4[&&\]]\d*$")).select("c_custkey", "c_name")


@query("predicate_range", f"""WITH {PARTS} SELECT p_partkey, brand_number FROM p
    WHERE try_cast(brand_number AS DOUBLE) IS NULL OR try_cast(brand_number AS DOUBLE) > 20""")
def predicate_range(spark, sf):
    df = parts(spark, sf)
    bad = out_of_range(df, "brand_number", high=20) | not_a_number(df, "brand_number")
    return df.where(bad).select("p_partkey", "brand_number")
