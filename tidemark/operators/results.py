"""Scores, alerts and reports over stored check results.

Check results have: id, rule_id, dataset_id, table_name, check_type, status, score, records_failed,
message, created_at.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Weight of each check type in the weighted score; 10 for any other.
WEIGHTS = {"completeness": 20, "uniqueness": 20, "validity": 20, "freshness": 15, "volume": 10, "schema": 15}


def _score(weighted: bool) -> Column:
    if not weighted:
        mean = F.avg("score")
    else:
        w = F.lit(10)
        for kind, weight in WEIGHTS.items():
            w = F.when(F.col("check_type") == kind, weight).otherwise(w)
        mean = F.sum(w * F.col("score")) / F.sum(w)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(mean, F.lit(100.0)))), 1)


def composite_score(results: DataFrame, weighted: bool = False) -> DataFrame:
    """Mean score, 100 when there are no results. `weighted` uses the weight of each check type."""
    return results.agg(_score(weighted).alias("overall_score"))


def table_scores(results: DataFrame, key: str = "table_name", weighted: bool = False) -> DataFrame:
    return results.groupBy(key).agg(
        _score(weighted).alias("overall_score"), F.count("*").alias("total"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") != "passed").alias("failed"))


def recent_dataset_scores(results: DataFrame, last: int = 10) -> DataFrame:
    """Mean of the last 10 scores per dataset. The rank filter prunes before the shuffle."""
    order = W.partitionBy("dataset_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = results.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= last)
    return recent.groupBy("dataset_id").agg(F.round(F.avg("score"), 1).alias("quality_score"),
                                            F.max("created_at").alias("last_checked"))


def alerts(results: DataFrame, rules: DataFrame) -> DataFrame:
    """An active alert per failed check, with the severity of its rule."""
    r = rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "severity")
    return results.where("status = 'failed'").join(r, "rule_id", "left").select(
        F.concat(F.lit("Check failed: "), F.coalesce("rule_name", F.lit("Unknown"))).alias("title"),
        F.col("message"), F.coalesce("severity", F.lit("error")).alias("severity"),
        F.lit("test_failure").alias("alert_type"), F.col("table_name").alias("source"),
        F.lit("active").alias("status"), F.col("created_at"))


def platform_stats(checks: DataFrame, rules: DataFrame, tables: DataFrame, services: DataFrame, teams: DataFrame,
                   alert_rows: DataFrame, activity: DataFrame, as_of: datetime) -> DataFrame:
    """One row of counts and averages; each source is aggregated to one row before they meet."""
    since = F.lit((as_of - timedelta(days=1)).isoformat(sep=" ")).cast("timestamp_ntz")
    parts = [
        services.agg(F.count("*").alias("total_services")),
        tables.agg(F.count("*").alias("total_tables"), F.avg("quality_score").alias("table_score"),
                   F.count_if(F.col("freshness_status") == "fresh").alias("fresh_tables"),
                   F.count_if(F.col("freshness_status") == "stale").alias("stale_tables")),
        rules.agg(F.count("*").alias("total_tests")),
        alert_rows.agg(F.count_if(F.col("status") == "active").alias("total_alerts")),
        teams.agg(F.count("*").alias("total_teams")),
        activity.agg(F.count_if(F.col("timestamp") >= since).alias("recent_activity")),
        checks.agg(F.avg("score").alias("check_score"), F.count("*").alias("total_results"),
                   F.count_if(F.col("status") == "passed").alias("passed_results"),
                   F.count_if(F.col("status") == "failed").alias("failed_tests")),
    ]
    tagged = [p.withColumn("one", F.lit(1)) for p in parts]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.join(p, "one")
    rate = F.when(F.col("total_results") > 0, F.col("passed_results") / F.col("total_results") * 100).otherwise(0.0)
    return whole.select(
        "total_services", "total_tables", "total_tests", "total_alerts", "total_teams", "fresh_tables", "stale_tables",
        "recent_activity", "total_results", "failed_tests", F.round(rate, 1).alias("tests_pass_rate"),
        F.round(F.coalesce("check_score", "table_score", F.lit(0.0)), 1).alias("average_quality_score"))


def daily_series(checks: DataFrame, last_days: int = 14) -> DataFrame:
    """Passed and failed per day, over all checks of the newest `last_days` days that have any."""
    days = checks.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") != "passed").alias("failed"))
    return days.orderBy(F.desc("date")).limit(last_days).orderBy("date")


def check_report(results: DataFrame, key: str = "table_name") -> DataFrame:
    """Summary per table. Failure lines are rows of `failure_lines`, so no table's failures are collected."""
    counted = results.groupBy(key).agg(
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") != "passed").alias("failed"), F.count("*").alias("total"),
        F.round(F.avg(F.coalesce("score", F.lit(100.0))), 1).alias("average_score"))
    summary = F.concat(F.lit("Table '"), F.col(key), F.lit("': "), F.col("passed").cast("string"), F.lit("/"),
                       F.col("total").cast("string"), F.lit(" checks passed, average score "),
                       F.col("average_score").cast("string"), F.lit("%."))
    good = F.lit("Every check passed.")
    bad = F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" checks failed"))
    plan_good = F.lit("Nothing to mend; keep the schedule of checks.")
    plan_bad = F.concat(F.lit("Mend the "), F.col("failed").cast("string"), F.lit(" failed checks, least score first, then run them again."))
    clean = F.col("failed") == 0
    return counted.withColumn("summary", summary) \
        .withColumn("diagnosis", F.when(clean, good).otherwise(bad)) \
        .withColumn("action_plan", F.when(clean, plan_good).otherwise(plan_bad))


def failure_lines(results: DataFrame, key: str = "table_name") -> DataFrame:
    """One line per failed check."""
    numbers = F.concat(F.lit("score="), F.col("score").cast("string"), F.lit(", records_failed="),
                       F.coalesce("records_failed", F.lit(0)).cast("string"))
    text = F.when(F.coalesce(F.col("message"), F.lit("")) == "", numbers).otherwise(F.col("message"))
    return results.where("status = 'failed'").select(key, "id", F.concat(F.lit("- "), text).alias("line"))


def latest_per_key(rows: DataFrame, key: str, order_by: str) -> DataFrame:
    """Newest row per key, as an aggregation."""
    rest = [c for c in rows.columns if c not in (key, order_by)]
    return rows.groupBy(key).agg(F.max(F.struct(order_by, *rest)).alias("r")).select(key, "r.*")
