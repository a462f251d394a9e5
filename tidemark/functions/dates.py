"""Date parsing, formatting and calendar features.

Times are naive (TIMESTAMP_NTZ), so results do not depend on the session time zone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import col, is_datetime

# Strptime directives and their Java pattern letters.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx",
}

# Layouts tried, in this order, after ISO 8601, each with the shape text must have. The
# shape keeps text that is no date away from the parser, whose failures are slow.
LAYOUTS = [
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("yyyyMMdd", r"^\d{4}(0[1-9]|1[0-2])\d{2}$"),
    ("dd MMM yyyy", r"^\d{2} [A-Z][a-z]{2} \d{4}$"),
    ("MMM dd, yyyy", r"^[A-Z][a-z]{2} \d{2}, \d{4}$"),
    ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"),
]

# The shape of dates that begin with the month or the day (05/06/2024, 05-06-2024, 05/06/24), with or without a
# time; and the first of the two-digit years that are of the last century, as in strptime.
DAY_OR_MONTH, LAST_CENTURY = r"^(\d{2})([/-])(\d{2})\2(\d{4}|(?<=/)\d{2})( \d{2}:\d{2}:\d{2})?$", "69"


def java_pattern(fmt: str) -> str:
    """Translate a strptime/strftime format to a Java date pattern."""
    out, i = [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            out.append(DIRECTIVES.get(fmt[i + 1], "'" + fmt[i + 1] + "'"))
            i += 2
            continue
        if ch.isalpha():
            end = i
            while end < len(fmt) and fmt[end].isalpha():
                end += 1
            out.append("'" + fmt[i:end] + "'")
            i = end
            continue
        out.append("''" if ch == "'" else ch)
        i += 1
    return "".join(out)


def in_order(text: Column, day_first: bool) -> Column:
    """Text of the shape DAY_OR_MONTH, read with the day or the month first; null where it can't be."""
    iso = F.regexp_replace(text, DAY_OR_MONTH, "$4-$3-$1$5" if day_first else "$4-$1-$3$5")
    century = F.when(~iso.rlike(r"^\d{2}-"), "").when(F.substring(iso, 1, 2) >= LAST_CENTURY, "19").otherwise("20")
    return F.when(text.rlike(DAY_OR_MONTH), F.concat(century, iso).try_cast("timestamp_ntz"))


def day_first(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """Whether dates such as 05/06/2024 begin with the day: one answer for a whole column, yes if more of its values, with
    a time or without, can be read with the day first than with the month first. All columns are counted in one pass."""
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return {}
    row = df.agg(*[e for i, c in enumerate(texts) for e in (
        F.count(in_order(col(c), True)).alias(f"d{i}"), F.count(in_order(col(c), False)).alias(f"m{i}"))]).first()
    return {c: row[f"d{i}"] > row[f"m{i}"] for i, c in enumerate(texts)}


def as_timestamp(df: DataFrame, name: str, fmt: str | None = None, day_first: bool = False) -> Column:
    """The column as a naive timestamp; text that does not parse becomes null. With `day_first`, the day goes before
    the month where both orders can be read."""
    dtype = df.schema[name].dataType
    if is_datetime(dtype):
        return col(name).cast("timestamp_ntz")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    text = col(name)
    if fmt:
        return F.try_to_timestamp(text, F.lit(java_pattern(fmt))).cast("timestamp_ntz")
    tries = [F.when(text.rlike(r"\d{4}"), text.try_cast("timestamp_ntz")), in_order(text, day_first), in_order(text, not day_first)]
    tries += [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz")) for p, shape in LAYOUTS]
    return F.coalesce(*tries)


class Reading(NamedTuple):
    """A column as timestamps in one order of day and month; `sure` is not null where that order itself can be read."""

    value: Column
    sure: Column


def readings(df: DataFrame, name: str) -> list[Reading]:
    """For one pass over a column whose order is not known yet: texts with the month first, then with the day first. As in
    `day_first`, the second holds if more of its values are sure. Other columns have one reading."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        ts = as_timestamp(df, name)
        return [Reading(ts, ts)]
    return [Reading(as_timestamp(df, name, day_first=first), in_order(col(name), first)) for first in (False, True)]


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp, as a long."""
    day = F.unix_date(ts.cast("date")).cast("long") * F.lit(86_400_000_000)
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * F.lit(1_000_000)
    return day + clock + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


FEATURES = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "quarter": F.quarter,
    "dayofweek": F.weekday,
    "dayofyear": F.dayofyear,
    "weekofyear": F.weekofyear,
    "is_weekend": lambda t: F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0)),
    "is_month_start": lambda t: F.coalesce((F.dayofmonth(t) == 1).cast("int"), F.lit(0)),
    "is_month_end": lambda t: F.coalesce((F.last_day(t) == t.cast("date")).cast("int"), F.lit(0)),
}
