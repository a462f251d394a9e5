"""Counts by codes against plain counts, also where codes collide."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import values

ROWS = [("a", 1, 0.5, None), ("a", 1, -0.0, "x"), ("b", 2, 0.0, "x"), (None, None, float("nan"), "y"), (None, None, None, ""), ("ab", 2, 0.5, " "), ("a", 1, 0.5, None), ("long " * 9_000, 3, 7.0, "z")]


@pytest.mark.parametrize("collide", [False, True])
def test_counts_by_codes(spark, monkeypatch, collide):
    monkeypatch.setattr(values, "SHORT", 0 if collide else 3)
    if collide:  # texts of equal length share their code
        monkeypatch.setattr(values.F, "xxhash64", lambda *c: F.coalesce(F.length(F.col(c[0]).cast("string")), F.lit(0)).cast("long"))
    df = spark.createDataFrame(ROWS * 2 + [("c", 4, 9.0, "w")], "t string, n int, x double, u string")
    plain = {c: Counter(v + 0.0 if isinstance(v, float) else v for r in df.collect() for v in [r[c]] if v is not None and v == v) for c in df.columns}
    assert values.distinct_map(df, df.columns) == {c: (len(k), sum(n == 1 for n in k.values())) for c, k in plain.items()}
    top = {}
    for r in values.commonest(df, ["t", "u", "n"], 3).orderBy("column", "position").collect():
        top.setdefault(r["column"], []).append((r["value"], r["n"]))
    assert top == {c: [(str(v), n) for v, n in sorted(plain[c].items(), key=lambda x: (-x[1], x[0]))[:3]] for c in ("t", "u", "n")}
    assert values.duplicate_rows(df) == 9 and values.duplicate_rows(df, ["t", "u"]) == 9 and values.duplicate_rows(df, ["n"]) == 12


def test_counts_of_nothing(spark):
    df = spark.createDataFrame([], "t string, n int")
    assert values.distinct_map(df, ["t", "n"]) == {"t": (0, 0), "n": (0, 0)} and values.duplicate_rows(df) == 0 and values.commonest(df, ["t"], 3).count() == 0
