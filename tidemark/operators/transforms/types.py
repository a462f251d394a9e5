"""Convert column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions import dates
from ...functions.columns import (FALSE_TOKENS, TRUE_TOKENS, as_number, col,
                                  is_text, pick_columns, value)
from .. import values
from .result import TransformResult, choose_method

METHODS = ["auto", "to_numeric", "to_string", "to_datetime", "to_category", "to_boolean"]


def to_boolean(c: Column, true_values=TRUE_TOKENS, false_values=FALSE_TOKENS) -> Column:
    """Tokens to booleans; anything else becomes null."""
    token = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+\z", ""))
    return F.when(token.isin(list(true_values)), F.lit(True)).when(token.isin(list(false_values)), F.lit(False))


def choose_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """For each column: numeric, datetime, boolean, category or keep. One pass, and one more for the
    distinct counts of columns that are none of the first three."""
    open_ = [c for c in columns if is_text(df.schema[c].dataType)]
    chosen = {c: "keep" for c in columns}
    if not open_:
        return chosen
    tokens = TRUE_TOKENS + FALSE_TOKENS
    exprs = [F.count("*").alias("rows")]
    for i, c in enumerate(open_):
        low = F.lower(col(c))
        exprs += [F.count(col(c)).alias(f"n{i}"), F.count(as_number(df, c)).alias(f"num{i}"),
                  F.count(dates.as_timestamp(df, c)).alias(f"dt{i}"),
                  F.count_if(low.isin(tokens)).alias(f"tok{i}"),
                  F.size(F.collect_set(F.when(low.isin(tokens), low))).alias(f"set{i}")]
    row = df.agg(*exprs).first()
    rest = []
    for i, c in enumerate(open_):
        n = max(row[f"n{i}"], 1)
        if row[f"num{i}"] / n > 0.9:
            chosen[c] = "numeric"
        elif row[f"dt{i}"] / n > 0.8:
            chosen[c] = "datetime"
        elif row[f"tok{i}"] == row[f"n{i}"] and row[f"set{i}"] <= 2:
            chosen[c] = "boolean"
        else:
            rest.append(c)
    for c, (distinct, _) in values.distinct_map(df, rest).items():
        if row["rows"] and distinct / row["rows"] < 0.5:
            chosen[c] = "category"
    return chosen


def _converted(df: DataFrame, name: str, kind: str, config: dict) -> Column:
    if kind == "numeric":
        return as_number(df, name).alias(name)
    if kind == "string":
        return value(df, name).cast("string").alias(name)
    if kind == "datetime":
        fmt = config.get("date_format")
        return dates.as_timestamp(df, name, fmt, not fmt and dates.day_first(df, [name]).get(name, False)).alias(name)
    if kind == "boolean":
        return to_boolean(col(name), config.get("true_values", TRUE_TOKENS),
                          config.get("false_values", FALSE_TOKENS)).alias(name)
    if kind == "category":
        return value(df, name).cast("string").alias(name, metadata={"category": True})
    return col(name)


def convert_types(df: DataFrame, config: dict) -> TransformResult:
    """Config: method (auto), column/columns (default all for auto), target_type, date_format,
    true_values, false_values. Text null stays null."""
    method = choose_method(config, METHODS, "auto")
    targets = pick_columns(df, config, df.columns if method == "auto" else [])
    if not targets:
        return TransformResult(df, success=False, note="No columns specified for type conversion")
    kinds = choose_types(df, targets) if method == "auto" else \
        {c: method.removeprefix("to_") for c in targets}
    out = df.select(*[_converted(df, c, kinds.get(c, "keep"), config) for c in df.columns])
    moved = {c: {"from": df.schema[c].dataType.simpleString(), "to": out.schema[c].dataType.simpleString(),
                 "converted": kinds[c] != "keep"} for c in targets}
    n = sum(m["converted"] for m in moved.values())
    return TransformResult(out, columns_affected=targets, measure=lambda: {
        "rows_affected": df.count(), "details": moved,
        "message": f"Type conversion: {n} columns converted ({method})"})
