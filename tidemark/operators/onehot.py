"""Turn 0/1 columns named `Unnamed: N_value` back into one column per N."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import NUMBER_TEXT, as_double, col

# Fixed value: the layout of the column names.
LAYOUT = re.compile(r"^Unnamed:\s*(\d+)_(.+)$")


def is_one_hot(columns: list[str]) -> bool:
    """More than half of the columns, and more than five, have the layout."""
    n = sum(bool(LAYOUT.match(c)) for c in columns)
    return n > 5 and n > len(columns) * 0.5


def groups(columns: list[str]) -> dict[int, list[tuple[str, str]]]:
    """Per group number its (column, value) pairs, in column order."""
    out: dict[int, list[tuple[str, str]]] = {}
    for c in columns:
        m = LAYOUT.match(c)
        if m:
            out.setdefault(int(m[1]), []).append((c, m[2].strip()))
    return dict(sorted(out.items()))


def header(values: list[str]) -> str:
    """The value that reads most like a column name: the first with a space or parenthesis and a letter,
    else the longest one with letters, else the first."""
    named = [v for v in values if any(ch.isalpha() for ch in v)]
    spaced = [v for v in named if any(ch in v for ch in " ()")]
    if spaced:
        return spaced[0]
    return max(named, key=len) if named else (values[0] if values else "")


def _pick(df: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Value of the first column equal to 1, else of the largest one above 0, else null."""
    cells = [(as_double(df, c), v) for c, v in pairs]
    hits = [F.when(x == 1, F.lit(v)) for x, v in cells]
    if len(cells) == 1:
        x, v = cells[0]
        return F.coalesce(hits[0], F.when(x > 0, F.lit(v)))
    top = F.greatest(*[x for x, _ in cells])
    return F.coalesce(*hits, *[F.when((x == top) & (top > 0), F.lit(v)) for x, v in cells])


def decode(df: DataFrame) -> DataFrame:
    """One projection; then columns of which over half the values are numbers become numeric."""
    if not is_one_hot(df.columns):
        return df
    plain = [c for c in df.columns if not LAYOUT.match(c)]
    made: dict[str, Column] = {}
    for number, pairs in groups(df.columns).items():
        made[header([v for _, v in pairs]) or f"Column_{number}"] = _pick(df, pairs)
    out = df.select(*[col(c) for c in plain if c not in made], *[e.alias(name) for name, e in made.items()])
    text = [f.name for f in out.schema.fields if f.dataType.typeName() == "string"]
    if not text:
        return out
    row = out.agg(*[e for i, c in enumerate(text) for e in (
        F.count(col(c)).alias(f"n{i}"), F.count_if(col(c).rlike(NUMBER_TEXT)).alias(f"x{i}"))]).first()
    numeric = {c for i, c in enumerate(text) if row[f"n{i}"] and row[f"x{i}"] / row[f"n{i}"] > 0.5}
    return out.select(*[as_double(out, c).alias(c) if c in numeric else col(c) for c in out.columns])
