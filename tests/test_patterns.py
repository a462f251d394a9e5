"""Python patterns on Spark against Python itself."""

from __future__ import annotations

import random
import re
import warnings
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import not_matching
from tidemark.functions.patterns import java_regex
from tidemark.functions.text import regex_replace

PIECES = ["a", "b", "[a[b]]", "[^a[b]", "[a&&b]", "[]x]", r"[\d\-]", r"[^\W_]", r"[\s.]", r"\w", r"\W", r"\d", r"\D", r"\s", r"\S", ".", r"\b", r"\B", "^", "$", r"\Z", r"\A", "(a|b)", "(?:ab|a)", "(?P<n>\\w)", "(?i:A)",
          "(?=a)", "(?!b)", "(?<=a)", "(?<!b)", "é", r"\.", r"\\", "\\[", "-", " ", "(?s:.)", "(?>ab?)", "x|y", "(?a:\\w)", "#", "&&", "[A-z]", "[^é]"]
TIMES = ["", "", "", "?", "*", "+", "*?", "+?", "{1,2}", "{2}", "?+"]
TEXTS = ["", "a", "b", "ab", "ba", "aab", "a[b]", "[", "b]", "a]", "&", "a&b", "a b", "A", "é", "É", "a\n", "\na", "a\nb", "a\n\n", "x", "y-", "1", "٣", "a1_", "_", "\u00a0", "\u200b", "ⅷ", "a.b", "\\", "]x", "#&&", "日本",
         "a\u0301", "\r\n", "İ", "ß", "Straße 5, b\n"]


def made(n=200):
    draw, out = random.Random(7), ["[a[b]]$", r"a$", r"(?m)^a$", r"(?i)É", r"(\w)\1", r"(?x) a  b # no", r"a\Z", r"[[:alpha:]]", r"\bab\b"]
    while len(out) < n:
        p = "".join(x + (draw.choice(TIMES) if x not in ("^", "$", r"\b", r"\B", r"\A", r"\Z", "x|y") and "(?=" not in x and "(?!" not in x and "(?<" not in x else "") for x in draw.choices(PIECES, k=draw.randrange(1, 5)))
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def differing(df, patterns):
    flags = df.select("text", *[F.expr("true").alias("t")], *[not_matching(df, "text", p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    return [(p, r["text"][:40]) for r in flags for k, p in enumerate(patterns) if r[f"p{k}"] != (re.match(p, r["text"]) is None)]


@pytest.mark.filterwarnings("ignore")
def test_generated_patterns_read_as_python_reads_them(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
        patterns = made()
        for k in range(0, len(patterns), 50):
            assert differing(df, patterns[k:k + 50]) == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_patterns_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text"))
    assert differing(df, [r"[A-Z[]\w+ ", r".*\bthe\b", r"\S+(?: \S+){5,}?\.", r"(?s).*@[\w.-]+\.(?:org|com)", r"(?i)the [^aeiou\s]", r"\w+$", r"(\w)\w*\1\b"]) == []


def test_replacing_and_errors(spark):
    df = spark.createDataFrame([("a[b] c",)], "t string")
    assert df.select(regex_replace(F.col("t"), r"[a[](?P<x>.)", r"<\g<x>$>")).first()[0] == "<[$>b] c"
    assert not_matching(df, "t", "(") is not None and df.where(not_matching(df, "t", "(")).count() == 0
    with pytest.raises(ValueError):
        java_regex(r"(a)?(?(1)b|c)")
