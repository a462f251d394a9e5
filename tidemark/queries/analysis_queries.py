"""Contracts, suggestions, statistical tests and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, forecast, stats, suggest
from .registry import GAPPY, gappy, load, query, rounded

# ---- contracts ------------------------------------------------------------------------------------------

CONTRACT = {
    "schema": {"columns": [{"name": "o_orderkey", "type": "int"}, {"name": "o_totalprice", "type": "numeric"},
                           {"name": "o_orderdate", "type": "string"}, {"name": "o_comment", "type": "string"}]},
    "columns": {"o_totalprice": {"nullable": False, "min": 5000, "max": 400000},
                "o_orderpriority": {"allowed_values": ["1-URGENT", "2-HIGH"], "pattern": "[1-3]-"},
                "o_orderstatus": {"nullable": False, "min": 1}},
    "rules": [{"type": "row_count", "min": 1}, {"type": "no_duplicates", "columns": ["o_custkey"]},
              {"type": "completeness", "threshold": 99}],
    "freshness": {"max_age_hours": 24},
    "unique_keys": ["o_orderkey", ["o_custkey", "o_orderdate"]],
}


@query("contract_violations", f"""WITH {GAPPY}, a AS (SELECT count(*) - count(o_totalprice) pn, count(*) FILTER (WHERE o_totalprice < 5000 OR o_totalprice > 400000) rng,
      count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) enum, count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^(?:[1-3]-)')) pat,
      count(*) - count(o_totalprice) + count(*) - count(o_orderpriority) gaps, count(*) - count(DISTINCT o_custkey) dup FROM g),
    k AS (SELECT coalesce(sum(c - 1), 0)::BIGINT d FROM (SELECT count(*) c FROM g GROUP BY o_custkey, o_orderdate)),
    v AS (SELECT 'missing_column' AS type, 'o_comment' AS "column", 'critical' AS severity, NULL::BIGINT AS count
      UNION ALL SELECT 'type_mismatch', 'o_orderdate', 'warning', NULL
      UNION ALL SELECT 'not_nullable', 'o_totalprice', 'error', pn FROM a UNION ALL SELECT 'range_violation', 'o_totalprice', 'warning', rng FROM a
      UNION ALL SELECT 'invalid_values', 'o_orderpriority', 'error', enum FROM a UNION ALL SELECT 'pattern_violation', 'o_orderpriority', 'warning', pat FROM a
      UNION ALL SELECT 'duplicates', '', 'warning', dup FROM a UNION ALL SELECT 'completeness', '', 'error', gaps FROM a
      UNION ALL SELECT 'unique_key_violation', 'o_custkey,o_orderdate', 'error', d FROM k)
    SELECT * FROM v WHERE count IS NULL OR count > 0""")
def contract_violations(spark, sf):
    return contracts.validate(gappy(spark, sf), CONTRACT)["violations"].drop("detail")


@query("contract_verdict", f"""WITH {GAPPY}, k AS (SELECT coalesce(sum(c - 1), 0) d FROM (SELECT count(*) c FROM g GROUP BY o_custkey, o_orderdate)),
    f AS (SELECT 8 + (d > 0)::BIGINT AS n FROM k)
    SELECT false AS valid, greatest(0, 100 - 5 * n)::DOUBLE AS score, 16::BIGINT AS total_checks, 15 - n AS passed_checks, n AS failed_checks FROM f""")
def contract_verdict(spark, sf):
    return contracts.verdict_frame(gappy(spark, sf), CONTRACT)


@query("contract_schema_types", """SELECT name, ok FROM (VALUES ('ts', true), ('value', true), ('event_id', true), ('user_id', false), ('props', true)) t(name, ok),
    (SELECT count(*) n FROM events) WHERE n > 0""")
def contract_schema_types(spark, sf):
    df = load(spark, sf, "events")
    wanted = [("ts", "datetime"), ("value", "float"), ("event_id", "int"), ("user_id", "bool"), ("props", "string")]
    return spark.createDataFrame([(c, contracts.has_type(df.schema[c].dataType, t)) for c, t in wanted], "name string, ok boolean")


@query("contract_offending_values", f"""WITH {GAPPY} SELECT DISTINCT o_orderpriority AS value FROM g WHERE o_orderpriority NOT IN ('1-URGENT') ORDER BY 1 LIMIT 10""")
def contract_offending_values(spark, sf):
    return contracts.invalid_values(gappy(spark, sf), "o_orderpriority", ["1-URGENT"])


@query("values_missing_from_reference", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def values_missing_from_reference(spark, sf):
    return contracts.values_not_in(load(spark, sf, "orders"), "o_custkey", load(spark, sf, "supplier").select("s_suppkey"))


@query("contract_duplicate_keys", """SELECT (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) c FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS by_line,
    (SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem) AS by_order""")
def contract_duplicate_keys(spark, sf):
    from ..operators.values import duplicate_rows
    df = load(spark, sf, "lineitem")
    return spark.createDataFrame([(duplicate_rows(df, ["l_orderkey", "l_linenumber"]), duplicate_rows(df, ["l_orderkey"]))], "by_line bigint, by_order bigint")


# ---- suggestions ----------------------------------------------------------------------------------------

@query("suggest_from_data", f"""WITH {GAPPY}, a AS (SELECT (count(*) - count(o_totalprice) > 0)::INT p, (count(*) - count(o_orderpriority) > 0)::INT q FROM g)
    SELECT 'imputation' AS type, 'high' AS priority, 'mode' AS method, 'o_totalprice,o_orderpriority' AS columns FROM a WHERE p + q = 2
    UNION ALL SELECT 'encoding', 'medium', 'one_hot', 'o_orderstatus,o_orderpriority' FROM a""")
def suggest_from_data(spark, sf):
    return suggest.from_data(gappy(spark, sf)).select("type", "priority", "method", F.concat_ws(",", "columns").alias("columns"))


@query("suggest_outliers", """WITH x AS (SELECT CASE WHEN o_totalprice > 470000 THEN o_totalprice * 100 ELSE o_totalprice END AS v FROM orders),
    b AS (SELECT quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 FROM x),
    c AS (SELECT count(*) n, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) o FROM x, b)
    SELECT 'outlier' AS type, 'iqr_cap' AS method, 'v' AS columns FROM c WHERE o > n * 0.05
    UNION ALL SELECT 'info', 'profile', '' FROM c WHERE o <= n * 0.05""")
def suggest_outliers(spark, sf):
    price = F.col("o_totalprice")
    df = load(spark, sf, "orders").select("o_orderkey", F.when(price > 470000, price * 100).otherwise(price).alias("v"))
    found = suggest.from_data(df)
    return found.select("type", "method", F.concat_ws(",", "columns").alias("columns"))


@query("suggest_from_profile", f"""WITH {GAPPY}, s AS (SELECT 0 AS place, 'dedup' AS type, 'high' AS priority, 'Drop repeated rows' AS label, 'o_custkey' AS columns
      UNION ALL SELECT 1, 'imputation', 'high', 'Fill gaps', string_agg(c, ',' ORDER BY c) FROM (
        SELECT 'o_totalprice' AS c FROM g HAVING count(*) - count(o_totalprice) > 0.05 * count(*)
        UNION ALL SELECT 'o_orderpriority' FROM g HAVING count(*) - count(o_orderpriority) > 0.05 * count(*)) HAVING count(*) > 0
      UNION ALL SELECT 2, 'encoding', 'medium', 'Turn texts into codes', string_agg(c, ',' ORDER BY c) FROM (
        SELECT 'o_orderstatus' AS c FROM g HAVING count(DISTINCT o_orderstatus) < count(*) / 2
        UNION ALL SELECT 'o_orderpriority' FROM g HAVING count(DISTINCT o_orderpriority) < count(*) / 2) HAVING count(*) > 0
      UNION ALL SELECT 2, 'review', 'medium', 'Gather more rows', '' FROM g HAVING count(*) < 1000)
    SELECT row_number() OVER (ORDER BY priority, label)::INT AS position, type, priority, label, columns FROM s""")
def suggest_from_profile(spark, sf):
    checks = [{"type": "uniqueness", "status": "failed", "column": "o_custkey", "score": 0, "message": ""}]
    found = suggest.from_profile_frame(gappy(spark, sf), checks)
    return found.withColumn("columns", F.concat_ws(",", F.from_json(F.get_json_object("config", "$.columns"), "array<string>"))).drop("config")


@query("suggest_fix_for_failed_checks", """SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 'dedup' ELSE 'imputation' END AS fix_type FROM events WHERE value > 50""")
def suggest_fix_for_failed_checks(spark, sf):
    said = F.when(F.col("event_type").isin("click", "view"), "12 duplicate rows").otherwise("5 null values")
    failed = load(spark, sf, "events").where("value > 50").select(
        F.col("event_id").alias("id"), said.alias("message"), F.col("event_type").alias("rule_name"), F.col("value").alias("score"))
    return suggest.propose_fixes(failed).select("id", "fix_type")


@query("apply_fix", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def apply_fix(spark, sf):
    df = load(spark, sf, "documents").select("text", "doc_id")
    return suggest.apply_fix(df, "dedup", {"columns": ["text"], "order_by": "doc_id"}).df


# ---- statistical tests ----------------------------------------------------------------------------------

def numbers(kind, df, *names, **config):
    return stats.test_frame(kind, df, config).select(*names)


@query("test_t_groups", """WITH a AS (SELECT avg(l_extendedprice) m, var_samp(l_extendedprice) v, count(*) n FROM lineitem WHERE l_linestatus = 'F'),
    b AS (SELECT avg(l_extendedprice) m, var_samp(l_extendedprice) v, count(*) n FROM lineitem WHERE l_linestatus = 'O')
    SELECT pround((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 6) AS statistic,
      pround(a.m, 4) AS group1_mean, pround(b.m, 4) AS group2_mean, a.n AS group1_n, b.n AS group2_n FROM a, b""")
def test_t_groups(spark, sf):
    return numbers("t_test", load(spark, sf, "lineitem"), "statistic", "group1_mean", "group2_mean", "group1_n", "group2_n",
                   column="l_extendedprice", group_column="l_linestatus")


@query("test_t_columns", """WITH a AS (SELECT avg(l_discount) m, var_samp(l_discount) v, count(*) n FROM lineitem), b AS (SELECT avg(l_tax) m, var_samp(l_tax) v, count(*) n FROM lineitem)
    SELECT pround((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 4) AS statistic, true AS significant FROM a, b""")
def test_t_columns(spark, sf):
    return rounded(numbers("t_test", load(spark, sf, "lineitem"), "statistic", "significant", column1="l_discount", column2="l_tax"), 4)


def chi(a: str, b: str, table: str, yates: bool, digits: int = 4) -> str:
    gap = "abs(o - e) - least(0.5, abs(o - e))" if yates else "abs(o - e)"
    return f"""WITH c AS (SELECT {a} a, {b} b, count(*)::DOUBLE o FROM {table} GROUP BY 1, 2), t AS (SELECT sum(o) n FROM c),
      ra AS (SELECT a, sum(o) r FROM c GROUP BY 1), cb AS (SELECT b, sum(o) k FROM c GROUP BY 1),
      f AS (SELECT coalesce(o, 0) o, r * k / n e FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN c ON c.a = ra.a AND c.b = cb.b)
      SELECT pround(sum(({gap}) ** 2 / e), {digits}) AS statistic, (SELECT ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1)) AS degrees_of_freedom FROM f"""


@query("test_chi_square", chi("o_orderstatus", "o_orderpriority", "orders", False))
def test_chi_square(spark, sf):
    return numbers("chi_square", load(spark, sf, "orders"), "statistic", "degrees_of_freedom", column1="o_orderstatus", column2="o_orderpriority")


@query("test_chi_square_yates", chi("l_linestatus", "l_quantity > 25", "lineitem", True))
def test_chi_square_yates(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("big", F.col("l_quantity") > 25)
    return numbers("chi_square", df, "statistic", "degrees_of_freedom", column1="l_linestatus", column2="big")


@query("test_anova", """WITH g AS (SELECT c_mktsegment, count(*)::DOUBLE n, avg(c_acctbal) m, var_pop(c_acctbal) v FROM customer GROUP BY 1),
    t AS (SELECT count(*) k, sum(n) n, sum(n * m) / sum(n) m FROM g)
    SELECT pround((sum(g.n * (g.m - t.m) ** 2) / (any_value(t.k) - 1)) / (sum(g.n * g.v) / (any_value(t.n) - any_value(t.k))), 4) AS statistic, any_value(t.k) AS num_groups FROM g, t""")
def test_anova(spark, sf):
    return numbers("anova", load(spark, sf, "customer"), "statistic", "num_groups", value_column="c_acctbal", group_column="c_mktsegment")


@query("test_ks_normal", """WITH c AS (SELECT l_quantity x, count(*) n FROM lineitem GROUP BY 1), s AS (SELECT x, n, sum(n) OVER (ORDER BY x) u, sum(n) OVER () t FROM c),
    f AS (SELECT *, CASE x WHEN 1 THEN 0.8413447460685429 WHEN 2 THEN 0.9772498680518208 WHEN 3 THEN 0.9986501019683699 WHEN 4 THEN 0.9999683287581669
      WHEN 5 THEN 0.9999997133484281 WHEN 6 THEN 0.9999999990134123 ELSE 1 END::DOUBLE p FROM s)
    SELECT round(max(greatest(u / t - p, p - (u - n) / t)), 5) AS statistic FROM f""")
def test_ks_normal(spark, sf):
    return rounded(numbers("ks_test", load(spark, sf, "lineitem"), "statistic", column="l_quantity"), 5)


@query("test_ks_uniform", """WITH x AS (SELECT l_quantity / 50 AS x FROM lineitem), c AS (SELECT x, count(*) n FROM x GROUP BY 1),
    s AS (SELECT x, n, sum(n) OVER (ORDER BY x)::DOUBLE u, sum(n) OVER ()::DOUBLE t FROM c)
    SELECT pround(max(greatest(u / t - x, x - (u - n) / t)), 6) AS statistic FROM s""")
def test_ks_uniform(spark, sf):
    df = load(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("x"))
    return numbers("ks_test", df, "statistic", column="x", distribution="uniform")


@query("test_chi_square_p_value", f"""SELECT pround(statistic, 4) AS statistic, pround(exp(-x) * (1 + x + x ** 2 / 2 + x ** 3 / 6), 6) AS p_value, exp(-x) * (1 + x + x ** 2 / 2 + x ** 3 / 6) < 0.05 AS significant
    FROM (SELECT statistic, statistic::DOUBLE / 2 AS x FROM ({chi("o_orderstatus", "o_orderpriority", "orders", False, 12)}))""")
def test_chi_square_p_value(spark, sf):
    """Eight degrees of freedom, for which the tail is a finite sum."""
    return numbers("chi_square", load(spark, sf, "orders"), "statistic", "p_value", "significant", column1="o_orderstatus", column2="o_orderpriority")


@query("test_ks_p_value", """WITH v AS (SELECT (round(l_extendedprice * 100)::BIGINT % 9973) / 9973.0::DOUBLE AS x FROM lineitem), c AS (SELECT x, count(*) n FROM v GROUP BY 1),
    s AS (SELECT x, n, sum(n) OVER (ORDER BY x)::DOUBLE u, sum(n) OVER ()::DOUBLE t FROM c),
    d AS (SELECT max(greatest(u / t - x, x - (u - n) / t)) AS d, any_value(t) AS n FROM s), z AS (SELECT d, n, d * sqrt(n) AS z FROM d),
    k AS (SELECT d, n, z, (pi() * (2 * k - 1) / 2) ** 2 AS a, exp(-((pi() * (2 * k - 1) / z) ** 2) / 8) AS w, (pi() * k) ** 2 AS b, exp(-((pi() * k / z) ** 2) / 2) AS y FROM z, range(1, 30) AS r(k))
    SELECT pround(d, 6) AS statistic, round(1 - sqrt(2 * pi()) * (sum(w) / z + sum((a - z ** 2) * w) / (6 * z ** 4) / sqrt(n)
      + (sum((6 * z ** 6 + 2 * z ** 4 + a * (2 * z ** 4 - 5 * z ** 2) + a ** 2 * (1 - 2 * z ** 2)) * w) / (72 * z ** 7) - sum(b * y) / (36 * z ** 3)) / n), 5) AS p_value FROM k GROUP BY d, n, z""")
def test_ks_p_value(spark, sf):
    """Cents of a price by a prime, against the uniform law; over 5,000 values, so the SQL's series is the one in use."""
    df = load(spark, sf, "lineitem").select((F.round(F.col("l_extendedprice") * 100).cast("long") % 9973 / 9973.0).alias("x"))
    return numbers("ks_test", df, "statistic", "p_value", column="x", distribution="uniform").withColumn("p_value", F.round("p_value", 5))


@query("test_mann_whitney", """WITH x AS (SELECT l_linestatus g, l_quantity v FROM lineitem), r AS (SELECT v, count(*) n, count(*) FILTER (WHERE g = 'F') n1 FROM x GROUP BY 1),
    k AS (SELECT n1, sum(n) OVER (ORDER BY v) - (n - 1) / 2.0::DOUBLE AS mid FROM r), s AS (SELECT sum(n1 * mid) r1, sum(n1)::DOUBLE n1 FROM k)
    SELECT pround(r1 - n1 * (n1 + 1) / 2, 4) AS statistic FROM s""")
def test_mann_whitney(spark, sf):
    return numbers("mann_whitney", load(spark, sf, "lineitem"), "statistic", column="l_quantity", group_column="l_linestatus")


@query("test_pearson", """SELECT pround(corr(l_quantity, l_extendedprice), 6) AS correlation, count(*) AS n, CASE WHEN corr(l_quantity, l_extendedprice) > 0 THEN 'positive' ELSE 'negative' END AS direction,
    CASE WHEN abs(corr(l_quantity, l_extendedprice)) > 0.9 THEN 'very_strong' WHEN abs(corr(l_quantity, l_extendedprice)) > 0.7 THEN 'strong' WHEN abs(corr(l_quantity, l_extendedprice)) > 0.5 THEN 'moderate'
      WHEN abs(corr(l_quantity, l_extendedprice)) > 0.3 THEN 'weak' ELSE 'very_weak' END AS strength FROM lineitem""")
def test_pearson(spark, sf):
    df = load(spark, sf, "lineitem")
    return numbers("pearson", df, "correlation", "n", "direction", "strength", column1="l_quantity", column2="l_extendedprice")


@query("test_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a,
      rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
    SELECT pround(corr(a, b), 6) AS correlation, count(*) AS n FROM r""")
def test_spearman(spark, sf):
    return numbers("spearman", load(spark, sf, "lineitem"), "correlation", "n", column1="l_quantity", column2="l_extendedprice")


@query("test_normality", """SELECT round(n / 6.0::DOUBLE * (g1 ** 2 + g2 ** 2 / 4), 3) AS statistic, pround(s, 4) AS skewness, pround(k, 4) AS kurtosis, false AS is_normal FROM (
    SELECT count(*) n, skewness(c_acctbal) s, kurtosis(c_acctbal) k, skewness(c_acctbal) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)) g1, kurtosis_pop(c_acctbal) g2 FROM customer)""")
def test_normality(spark, sf):
    return rounded(numbers("normality", load(spark, sf, "customer"), "statistic", "skewness", "kurtosis", "is_normal", column="c_acctbal").withColumn(
        "statistic", F.round("statistic", 3)), 4)


@query("describe_numbers", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS "min",
    max({c})::DOUBLE AS "max", round(median({c})::DOUBLE, 4) AS median FROM part""" for c in ("p_partkey", "p_size", "p_retailprice")))
def describe_numbers(spark, sf):
    return rounded(stats.describe(load(spark, sf, "part")), 4)


@query("anomaly_test_listing", """SELECT event_id AS id, 'anomaly_' || event_type AS test_type, ts AS created_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100""")
def anomaly_test_listing(spark, sf):
    kind = F.when(F.col("event_type") == "error", F.concat(F.lit("anomaly_"), "event_type")).otherwise(F.col("event_type"))
    results = load(spark, sf, "events").select(F.col("event_id").alias("id"), kind.alias("test_type"), F.col("ts").alias("created_at"))
    return stats.anomaly_tests(results)


# ---- forecasts ------------------------------------------------------------------------------------------

def scores(spark, sf):
    """A daily score per event type: how far the day's mean value stays under 100."""
    daily = load(spark, sf, "events").groupBy(F.col("event_type").alias("table_name"), F.to_date("ts").alias("date")) \
        .agg(F.round(100 - F.avg("value"), 4).alias("score"))
    return daily


SCORES = """d AS (SELECT event_type AS table_name, ts::DATE AS date, least(100, greatest(0, round(100 - avg(value), 4))) AS score FROM events GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY table_name) AS n FROM d),
    f AS (SELECT table_name, any_value(n) AS n, max(date) AS last_date, max(score) FILTER (WHERE k = 1) AS s1, max(score) FILTER (WHERE k = 2) AS s2, max(score) FILTER (WHERE k = 3) AS s3,
      avg(score) FILTER (WHERE k <= 7) AS ma, sum(0.3 * 0.7 ** (k - 1) * score) + 0.7 * 0.7 ** (any_value(n) - 1) * max(score) FILTER (WHERE k = n) AS smoothed,
      (sum(0.3 * 0.7 ** (k - 3) * score) FILTER (WHERE k > 2)) + 0.7 * 0.7 ** (any_value(n) - 3) * max(score) FILTER (WHERE k = n) AS before,
      regr_slope(score, n - k) AS slope, regr_intercept(score, n - k) AS intercept FROM p GROUP BY 1 HAVING any_value(n) >= 3)"""


@query("forecast_summary", f"""WITH {SCORES}, e AS (SELECT *, smoothed + (smoothed - before) / 3 * 7 AS x FROM f)
    SELECT table_name, n AS points, CASE WHEN s3 > s2 AND s2 > s1 THEN 'degrading' WHEN s3 < s2 AND s2 < s1 THEN 'improving' WHEN slope < -0.5 THEN 'degrading'
      WHEN slope > 0.5 THEN 'improving' ELSE 'stable' END AS trend, round(s1, 4) AS current_score, round(least(100, greatest(0, x)), 4) AS predicted_score,
      round(x - s1, 4) AS predicted_change, x < s1 AS will_degrade, CASE WHEN s1 - x > 10 THEN 'critical' WHEN s1 - x > 5 THEN 'high' WHEN s1 - x > 2 THEN 'medium' ELSE 'low' END AS degradation_risk,
      round(ma, 4) AS moving_average FROM e""")
def forecast_summary(spark, sf):
    return rounded(forecast.forecast(scores(spark, sf), "table_name", digits=4)[0], 4)


@query("forecast_points", f"""WITH {SCORES} SELECT table_name, (last_date + i::INT)::DATE AS date, round(least(100, greatest(0, smoothed + (smoothed - before) / 3 * i)), 4) AS exponential_smoothing,
    round(least(100, greatest(0, intercept + slope * (n - 1 + i))), 4) AS linear_trend FROM f, range(1, 8) r(i)""")
def forecast_points(spark, sf):
    return rounded(forecast.forecast(scores(spark, sf), "table_name", digits=4)[1], 4)


@query("forecast_moving_average", f"WITH {SCORES} SELECT table_name, round(ma, 4) AS moving_average FROM f")
def forecast_moving_average(spark, sf):
    return rounded(forecast.series_facts(scores(spark, sf), "table_name").select(F.col("key").alias("table_name"), "moving_average"), 4)


@query("forecast_trend_line", f"WITH {SCORES} SELECT table_name, round(slope, 6) AS slope FROM f")
def forecast_trend_line(spark, sf):
    return rounded(forecast.series_facts(scores(spark, sf), "table_name").select(F.col("key").alias("table_name"), "slope"), 6)


@query("forecast_too_short", "SELECT c_custkey, count(*) AS points FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) < 3")
def forecast_too_short(spark, sf):
    o = load(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return forecast.too_short(load(spark, sf, "customer").join(o, "c_custkey"), "c_custkey")
