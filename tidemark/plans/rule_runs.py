"""Run the rules of a table, with the stored profile as a stand-in when the data is gone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import checks, onehot


def run_all(df: DataFrame, rules: list[dict], table: str = "", **options) -> dict:
    """All enabled rules in fused jobs; one-hot layouts are decoded first."""
    results = checks.run_rules(onehot.decode(df), rules, table, **options)
    passed = sum(r.status == "passed" for r in results)
    return {"results": results, "total": len(results), "passed": passed, "failed": len(results) - passed}


def run_one(spark: SparkSession, rule: dict, table: str, df: DataFrame | None = None, profile: DataFrame | None = None,
            as_of: datetime | None = None) -> DataFrame:
    """One rule on the data, else an estimate from its profile. With neither there is no result to give."""
    if df is not None:
        return checks.results_frame(spark, checks.run_rules(onehot.decode(df), [rule], table, as_of))
    if profile is None:
        raise ValueError("neither data nor a profile is left to check")
    cfg = checks.rule_config(rule)
    row = [(str(rule.get("id", "")), rule.get("type", "completeness"), cfg.get("column") or "",
            float(cfg["threshold"]) if cfg.get("threshold") else None)]
    rules = spark.createDataFrame(row, "rule_id string, check_type string, column_name string, threshold double")
    return checks.profile_estimates(rules, profile)
