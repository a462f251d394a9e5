"""Clean text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions import text
from ...functions.columns import col, pick_columns, text_columns
from .result import TransformResult, choose_method

METHODS = list(text.METHODS)


def clean_text(df: DataFrame, config: dict) -> TransformResult:
    """Config: column/columns (default all text), method (trim), pattern/regex, replacement."""
    method = choose_method(config, METHODS, "trim")
    targets = pick_columns(df, config, text_columns(df))
    if not targets:
        return TransformResult(df, success=False, note="No string columns found to clean")
    cleaned = {c: text.METHODS[method](col(c).cast("string"), config) for c in targets}
    out = df.select(*[cleaned[c].alias(c) if c in cleaned else col(c) for c in df.columns])

    def measure() -> dict:
        row = df.agg(*[F.count_if(cleaned[c] != col(c).cast("string")).alias(f"n{i}")
                       for i, c in enumerate(targets)]).first()
        total = sum(row)
        return {"rows_affected": total,
                "details": {c: {"method": method, "values_changed": row[i]} for i, c in enumerate(targets)},
                "message": f"Cleaned {len(targets)} string columns: {total} values changed via {method}"}

    return TransformResult(out, columns_affected=targets, measure=measure)
