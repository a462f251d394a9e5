"""Quality-score forecasts per table, as plain aggregates over numbered points.

With k counting points back from the newest, the smoothed value is a sum of alpha * (1 - alpha)^(k - 1)
times the score, plus what the first score carries as the seed. So no series is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..functions.dates import micros
from . import ordering

ALPHA = 0.3


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))


def _smoothed(skip: int) -> Column:
    """Smoothed value when the newest `skip` points are left out."""
    keep = 1 - ALPHA
    body = F.sum(F.when(F.col("k") > skip, F.lit(ALPHA) * F.pow(F.lit(keep), F.col("k") - 1 - skip) * F.col("score")))
    seed = F.lit(keep) * F.pow(F.lit(keep), F.max("k") - 1 - skip) * F.max_by("score", "k")
    return body + seed


def series_facts(scores: DataFrame, key: str, date: str = "date", score: str = "score",
                 rows_per_range: int = ordering.ROWS_PER_RANGE) -> DataFrame:
    """Per key: point count, last date and scores, moving average, smoothed value, line and trend inputs."""
    points = scores.select(col(key).alias("key"), (-micros(col(date).cast("timestamp_ntz"))).alias("back"),
                           col(date).cast("date").alias("day"), clamp(col(score)).alias("score"))
    numbered = ordering.row_numbers(points, ["back", "score"], ["key"], out="k", rows_per_range=rows_per_range)
    at = {i: F.max(F.when(F.col("k") == i, F.col("score"))) for i in (1, 2, 3)}
    x = -F.col("k")
    return numbered.groupBy("key").agg(
        F.count("*").alias("n"), F.max("day").alias("last_date"),
        at[1].alias("s1"), at[2].alias("s2"), at[3].alias("s3"),
        F.avg(F.when(F.col("k") <= 7, F.col("score"))).alias("moving_average"),
        _smoothed(0).alias("smoothed"), _smoothed(2).alias("smoothed_before"),
        F.regr_slope(F.col("score"), x).alias("slope"), F.regr_intercept(F.col("score"), x).alias("level"),
    ).withColumn("step", (F.col("smoothed") - F.col("smoothed_before")) / 3)


def trend_label() -> Column:
    s1, s2, s3 = F.col("s1"), F.col("s2"), F.col("s3")
    return F.when((s3 > s2) & (s2 > s1), "degrading").when((s3 < s2) & (s2 < s1), "improving") \
        .when(F.col("slope") < -0.5, "degrading").when(F.col("slope") > 0.5, "improving").otherwise("stable")


def risk_label(drop: Column) -> Column:
    return F.when(drop > 10, "critical").when(drop > 5, "high").when(drop > 2, "medium").otherwise("low")


def forecast_summary(facts: DataFrame, key: str, periods: int = 7, digits: int = 1) -> DataFrame:
    """Trend, risk and predicted change per key; keys with fewer than 3 points are left out."""
    end = F.col("smoothed") + F.col("step") * periods
    return facts.where("n >= 3").select(
        F.col("key").alias(key), F.col("n").alias("points"), trend_label().alias("trend"),
        F.col("s1").alias("current_score"), F.round(clamp(end), digits).alias("predicted_score"),
        F.round(end - F.col("s1"), digits).alias("predicted_change"), (end < F.col("s1")).alias("will_degrade"),
        risk_label(F.col("s1") - end).alias("degradation_risk"),
        F.round("moving_average", digits).alias("moving_average"))


def forecast_points(facts: DataFrame, key: str, periods: int = 7, digits: int = 1) -> DataFrame:
    """One row per key and future day: smoothed and linear forecasts, kept within 0 to 100."""
    days = facts.where("n >= 3").withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return days.select(
        F.col("key").alias(key), F.date_add("last_date", F.col("ahead")).alias("date"),
        F.round(clamp(F.col("smoothed") + F.col("step") * F.col("ahead")), digits).alias("exponential_smoothing"),
        F.round(clamp(F.col("level") + F.col("slope") * (F.col("ahead") - 1)), digits).alias("linear_trend"))


def forecast(scores: DataFrame, key: str, periods: int = 7, digits: int = 1) -> tuple[DataFrame, DataFrame]:
    """(summary per key, forecast points) from rows (key, date, score)."""
    facts = series_facts(scores, key)
    return forecast_summary(facts, key, periods, digits), forecast_points(facts, key, periods, digits)


def too_short(scores: DataFrame, key: str) -> DataFrame:
    """Keys that have fewer than the 3 points a forecast needs."""
    return scores.groupBy(key).agg(F.count("*").alias("points")).where("points < 3")
