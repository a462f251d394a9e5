"""Parse dates and derive calendar features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions import dates
from ...functions.columns import col, datetime_columns, pick_columns, text_columns
from .result import TransformResult, choose_method

METHODS = ["parse", "extract_features", "to_format", "auto_detect"]


def detect_date_columns(df: DataFrame) -> list[str]:
    """Date columns, and text columns of which over 80 % of the non-null values parse; counted over all rows and
    columns at once."""
    found, texts = datetime_columns(df), text_columns(df)
    if texts:
        row = df.agg(*[e for i, c in enumerate(texts) for e in (
            F.count(col(c)).alias(f"n{i}"), F.count(dates.as_timestamp(df, c)).alias(f"p{i}"))]).first()
        found += [c for i, c in enumerate(texts) if row[f"n{i}"] and row[f"p{i}"] / row[f"n{i}"] > 0.8]
    return [c for c in df.columns if c in found]


def parse_dates(df: DataFrame, config: dict) -> TransformResult:
    """Config: column/columns (default detected), method (parse), format/date_format, output_format
    (%Y-%m-%d), features (year, month, day, dayofweek, quarter). Monday is day 0."""
    method = choose_method(config, METHODS, "parse")
    fmt = config.get("format", config.get("date_format"))
    targets = pick_columns(df, config, []) or detect_date_columns(df)
    if not targets:
        return TransformResult(df, success=False, note="No date-like columns found")
    features = [f for f in config.get("features", ["year", "month", "day", "dayofweek", "quarter"])
                if f in dates.FEATURES]
    days = {} if fmt and method not in ("extract_features", "to_format") else dates.day_first(df, targets)
    added: list[str] = []
    if method == "extract_features":
        extra = [dates.FEATURES[f](dates.as_timestamp(df, c, day_first=days.get(c, False))).alias(f"{c}_{f}") for c in targets for f in features]
        added = [f"{c}_{f}" for c in targets for f in features]
        out = df.select("*", *extra)
    elif method == "to_format":
        pattern = dates.java_pattern(config.get("output_format", "%Y-%m-%d"))
        shown = {c: F.date_format(dates.as_timestamp(df, c, day_first=days.get(c, False)), pattern) for c in targets}
        out = df.select(*[shown[c].alias(c) if c in shown else col(c) for c in df.columns])
    else:
        parsed = {c: dates.as_timestamp(df, c, fmt, days.get(c, False)) for c in targets}
        out = df.select(*[parsed[c].alias(c) if c in parsed else col(c) for c in df.columns])

    def measure() -> dict:
        row = df.agg(F.count("*"), *[F.count(dates.as_timestamp(df, c, fmt)).alias(f"p{i}")
                                     for i, c in enumerate(targets)]).first()
        return {"rows_affected": row[0],
                "details": {c: {"method": method, "parsed_count": row[i + 1],
                                "new_columns": [a for a in added if a.startswith(c + "_")]}
                            for i, c in enumerate(targets)},
                "message": f"Date processing: {method} on {len(targets)} columns, "
                           f"{len(added)} features extracted"}

    return TransformResult(out, columns_affected=targets + added, measure=measure)
