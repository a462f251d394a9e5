"""Column classes, null-safe casts and row predicates shared by every operator."""

from __future__ import annotations

import re
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .patterns import java_regex

# Text tokens read as booleans.
TRUE_TOKENS = ["true", "yes", "1", "y", "t"]
FALSE_TOKENS = ["false", "no", "0", "n", "f"]

# Plain decimal text. Java would also take "1d" or "2f", which are not numbers in a data file.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, also when the name has dots or spaces."""
    return F.col(quoted(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def select_class(df: DataFrame, *classes: str) -> DataFrame:
    """Keep the columns of the given classes: numeric, text, datetime."""
    pick = {"numeric": numeric_columns, "text": text_columns, "datetime": datetime_columns}
    keep = {name for c in classes for name in pick[c](df)}
    return df.select(*[col(c) for c in df.columns if c in keep])


def pick_columns(df: DataFrame, config: dict, default: list[str]) -> list[str]:
    """Target columns of a transform: `columns`, else `column`, else the default set."""
    wanted = list(config.get("columns") or [])
    if not wanted:
        single = config.get("column", config.get("columnName", ""))
        wanted = [single] if single in df.columns else default
    return [c for c in wanted if c in df.columns]


def drop_nan(c: Column, dtype: T.DataType) -> Column:
    """NaN counts as missing, as null does."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null."""
    return drop_nan(col(name), df.schema[name].dataType)


def as_number(df: DataFrame, name: str) -> Column:
    """The column as a number; text that is not a number becomes null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DecimalType):
        return col(name).cast("double")
    if is_numeric(dtype):
        return drop_nan(col(name), dtype)
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("int")
    text = col(name).cast("string")
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def as_double(df: DataFrame, name: str) -> Column:
    return as_number(df, name).cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    return value(df, name).isNull()


def is_blank(df: DataFrame, name: str) -> Column:
    """Null, NaN, or text of whitespace only."""
    missing = is_missing(df, name)
    if is_text(df.schema[name].dataType):
        return missing | ~col(name).rlike(r"\S")
    return missing


def not_in_set(df: DataFrame, name: str, allowed: list) -> Column:
    """Non-null value outside the allowed list. Entries that the column's type cannot hold allow nothing: texts
    in the list of a number column, numbers in that of a text column."""
    dtype = df.schema[name].dataType
    if is_numeric(dtype):
        fits = [int(a) if isinstance(a, bool) else a for a in allowed if isinstance(a, (bool, int, float, Decimal))]
    elif is_text(dtype):
        fits = [a for a in allowed if isinstance(a, str)]
    elif isinstance(dtype, T.BooleanType):
        fits = [bool(a) for a in allowed if isinstance(a, (bool, int, float)) and a in (0, 1)]
    else:
        fits = [a for a in allowed if a is not None]
    if is_datetime(dtype):
        kind = dtype.simpleString()
        fits = [F.lit(a).try_cast(kind) for a in fits]
    return value(df, name).isNotNull() & ~F.coalesce(value(df, name).isin(fits) if fits else F.lit(False), F.lit(False))


def not_matching(df: DataFrame, name: str, pattern: str) -> Column:
    """Non-null value that the pattern does not match from its start.

    A pattern that is no regular expression marks nothing; one that only Python understands is an error here,
    before any job runs.
    """
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    java = java_regex(pattern)  # an error where Java has no equal
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(java)
    except Py4JJavaError as error:
        raise ValueError(f"pattern {pattern!r} is not supported on Spark") from error
    text = value(df, name).cast("string")
    return F.coalesce(~text.rlike(r"\A(?:" + java + ")"), F.lit(False))


def out_of_range(df: DataFrame, name: str, low=None, high=None) -> Column:
    """Value that parses as a number and lies outside the closed range."""
    number = as_number(df, name)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (number < F.lit(low))
    if high is not None:
        bad = bad | (number > F.lit(high))
    return F.coalesce(bad, F.lit(False))


def not_a_number(df: DataFrame, name: str) -> Column:
    """Non-null value that does not parse as a number."""
    return value(df, name).isNotNull() & as_number(df, name).isNull()


def json_safe(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row, with NaN and infinities written as missing."""
    safe = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        safe.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias(name))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values; null where one of them does not vary.

    `corr` itself divides by zero there, which is an error in ANSI mode.
    """
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.when(spread > 0, F.covar_pop(x, y) / spread)
