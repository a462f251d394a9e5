"""CSV files read range by range must give the rows of the reader that takes a whole file in one task."""

from __future__ import annotations

import random

import pytest

from tidemark.sources import readers
from tidemark.sources.split_csv import ends_inside


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rnd: random.Random) -> str:
    kind = rnd.random()
    if kind < 0.2:
        return ""
    if kind < 0.5:
        return str(rnd.randint(0, 9999))
    if kind < 0.6:
        return '5" pipe'
    text = "".join(rnd.choice(["a", "\n", '"', ",", " ", "é", "\n\n", "x" * 50]) for _ in range(rnd.randint(0, 40)))
    return '"' + text.replace('"', '""') + '"'


def rows(n: int, seed: int = 1) -> list[str]:
    rnd = random.Random(seed)
    return [f"{i},{value(rnd)},{value(rnd)}" for i in range(n)]


# name: (file, rows, whether many tasks read it)
FILES = {
    "random": ("a,b,c\n" + "\n".join(rows(400)) + "\n", 400, True),
    "no last line end": ("a,b,c\n" + "\n".join(rows(200, 2)), 200, True),
    "windows": ("a,b,c\r\n" + "\r\n".join(r.replace("\n", "\r\n") for r in rows(200, 3)) + "\r\n", 200, True),
    "windows, plain breaks in values": ("a,b,c\r\n" + "\r\n".join(rows(200, 4)) + "\r\n", 200, True),
    "values over many ranges": ("a,b,c\n1,\"" + "z\n" * 9000 + "\",2\n3,4,\"" + 'q,""\n' * 5000 + "\"\n5,6,7\n", 3, True),
    "header over many ranges": ("\n\na,\"b\n" + "h\n" * 4000 + "\",c\n1,2,3\n\"4\n\",5,6\n", 2, True),
    "byte order mark": ("﻿\"a\",b,c\n" + "\n".join(rows(150, 5)), 150, True),
    "no breaks in values": ("a,b,c\n" + "\n".join(f"{i},x,y" for i in range(900)), 900, True),
    "blank lines": ("a,b,c\n\n\n1,\"\n\",3\n\n" * 1 + "\n" * 5000 + "4,5,6\n", 2, True),
    "short and long rows": ("a,b,c\n" + "1\n2,\"3\n\",4,5\n" * 300, 600, True),
    "stray carriage return": ("a,b,c\n" + "1,\"x\ry\nz\",3\n" * 300, 300, False),
    "header only": ("a,b,c\n", 0, True),
}


@pytest.mark.parametrize("name", FILES)
def test_same_rows_as_one_task(small_ranges, tmp_path, name):
    text, n, many = FILES[name]
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    one = readers.read_csv(small_ranges, str(path), infer=False, split=False)
    split = readers.read_csv(small_ranges, str(path), infer=False, split=True)
    assert split.columns == one.columns and split.count() == n
    assert sorted(map(repr, split.collect())) == sorted(map(repr, one.collect()))
    if n:
        assert (split.rdd.getNumPartitions() > 1) == many


def test_large_files_are_split_unasked_and_options_kept(small_ranges, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a;b\n" + "".join(f'{i};"x;\n{k}"\n' for i in range(300)))
    df = readers.read_csv(small_ranges, str(tmp_path), sep=";")
    assert dict(df.dtypes) == {"a": "bigint", "b": "string"} and df.rdd.getNumPartitions() > 3
    assert df.groupBy("b").count().orderBy("b").collect() == [(f"x;\n{k}", 300) for k in range(3)]
    # where another option decides where records end, one task reads a file
    assert readers.read_csv(small_ranges, str(tmp_path), sep=";", quote="'").rdd.getNumPartitions() <= 3


def test_invalid_bytes_and_typed_schema(small_ranges, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"a,b\n" + b'7,"x\n\xff"\n' * 500)
    df = readers.read_csv(small_ranges, str(path), schema=small_ranges.createDataFrame([], "a int, b string").schema, split=True)
    assert df.dtypes == [("a", "int"), ("b", "string")] and df.distinct().collect() == [(7, "x\n�")]


@pytest.mark.parametrize("line, from_out, from_in", [
    (b"", False, True), (b"a,b", False, True), (b'a,"b', True, False), (b'a"b', False, False), (b'"a""', True, False), (b'"a"",', True, False),
    (b'"a""",b', False, False), (b'"a"b"c,"', True, True), (b'""', False, True), (b',"",","', False, True)])
def test_state_at_the_end_of_a_line(line, from_out, from_in):
    assert (ends_inside(line, False), ends_inside(line, True)) == (from_out, from_in)
