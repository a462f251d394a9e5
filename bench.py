"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.queries import QUERIES  # noqa: E402

HEADLINE = [
    "check_rule_batch", "check_uniqueness", "check_anomaly_column", "type_detection", "ingest_profile", "data_profile",
    "top_values_per_column", "exact_quantiles", "eda_overview", "eda_column_profiles", "eda_correlations", "eda_histogram",
    "eda_outlier_summary", "readiness_dimensions", "impute_mean", "impute_median", "impute_mode", "impute_forward",
    "impute_knn", "outliers_iqr_remove", "outliers_winsorize", "outliers_in_sequence", "dedup_exact", "dedup_keep_first",
    "encode_label_many", "encode_target_mean", "encode_one_hot", "scale_robust", "text_title_case", "text_camel_case",
    "date_features", "split_random", "split_stratified", "convert_auto", "contract_violations", "suggest_from_data",
    "test_chi_square", "test_mann_whitney", "test_spearman", "forecast_points", "failed_checks_per_table",
    "platform_stats", "sql_top_products", "transform_batch", "quality_stream",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
