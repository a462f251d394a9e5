"""Compare a query's rows with those of its SQL on DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 2**53 else v)
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def differences(spark_df, con, sql: str) -> str:
    """Empty when the rows agree exactly."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(want_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_columns)}"
    if len(got_rows) != len(want_rows):
        return f"{len(got_rows)} rows, expected {len(want_rows)}"
    g = [spark_df.columns.index(c) for c in sorted(want_columns)]
    w = [want_columns.index(c) for c in sorted(want_columns)]
    got = order([tuple(plain(r[i]) for i in g) for r in got_rows])
    want = order([tuple(plain(r[i]) for i in w) for r in want_rows])
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else ""
