"""The Merkle manifest against a plain one, row by row."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tidemark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, tree int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels_of(digests):
    out = [digests]
    while len(digests) > 1:
        digests = [digest(*digests[k:k + 3]) for k in range(0, len(digests), 3)]
        out.append(digests)
    return out


def path_of(levels, pos):
    for level in levels[:-1]:
        run, i = level[pos // 3 * 3:pos // 3 * 3 + 3], pos % 3
        yield run[:i], run[i + 1:]
        pos //= 3


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    trees = []
    for k in sorted(by):
        ordered = sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees.append((ordered, levels_of([leaf_of(r, r[4]) for r in ordered])))
    top, out = levels_of([levels[-1][0] for _, levels in trees]), []
    for t, (ordered, levels) in enumerate(trees):
        for k, r in enumerate(ordered):
            path = [*path_of(levels, k), *path_of(top, t)]
            text = r[4].replace("\n", "") if r[4] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            folded = leaf_of(r, text)
            for left, right in path:
                folded = digest(*left, folded, *right)
            out.append((r[0], leaf_of(r, r[4]), levels[-1][0], top[-1][0], digest(*[x for a, b in path for x in a + b]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def many():
    draw = random.Random(1)
    rows = [(k, None if k % 7 == 0 else f"s{k % 5}" if k % 11 else f"é{k}", None if k % 3 else "é", k if k % 2 else None, draw.choice([None, "", "a\nb", "x\n" * k])) for k in range(200)]
    return rows + [(None, "s1", None, None, "zz"), (None, "s1", None, None, "z\nz"), (5, "s1", "q", 1, "r"), (5, "s1", "q", 1, "r"), (6, "s1", None, 1, "wide " * 50_000)]


CASES = {"none": [], "one": [(2, "a", "en", 3, "a\nb")], "one null": [(None,) * 5], "one run": [(k, "a", "en", 3, "a\nb") for k in range(3)],
         "short run": [(k, "a", "en", 3, "a\nb") for k in range(4)], "lone leaves": [(k, f"s{k}", "en", 3, "a\nb") for k in range(5)], "many": many()}


@pytest.mark.parametrize("case", CASES)
def test_manifest_against_a_plain_one(spark, case):
    rows = spark.createDataFrame([(*r, "x", 1) for r in CASES[case]], SCHEMA)
    assert sorted([tuple(r) for r in merkle.manifest(rows).collect()], key=str) == plain(CASES[case])


def test_rows_of_nodes_are_salted(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES_PER_COPY", 7)
    rows = spark.createDataFrame([(*r, "x", 1) for r in many()], SCHEMA)
    assert sorted([tuple(r) for r in merkle.manifest(rows).collect()], key=str) == plain(many())
