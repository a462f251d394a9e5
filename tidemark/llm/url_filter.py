"""URL rules: a trie over reversed host labels, then path segments; the longest rule that fits wins.

A rule is (host, path, verdict). It fits its host and all subdomains, if the url's path starts with the rule's
path; the last segment of a rule's path may therefore be the beginning of a url's segment. The longest rule is that
with the most characters in host and path together, then the longer host; between equal rules `block` wins.

Defined cases: a null url and one without `://` have an empty host and path and fit no rule; urls that no rule
fits get `default`; the empty table gives no rows; a repeated row is judged again; columns of the input named like
the four results (host, path, rule, verdict) are replaced, all others are kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Rules and characters of rules that may be broadcast; beyond either, rules are joined by shuffles.
MAX_RULES, MAX_CHARS = 200_000, 32_000_000
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
RESULTS = ["host", "path", "rule", "verdict"]


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end].translate(LOWER), rest[end:]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host, rest[:cut]


class Trie:
    """Nodes are dicts: by host label, and below a host, by path segment. A host node keeps its path trie under
    None; a path node keeps under None the rules whose path ends there or in a part of the next segment."""

    def __init__(self, rules):
        self.root = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, []).append((last, (len(host) + len(path), len(host), verdict == "block"), host + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(None)
            for segment in segments:
                if at is None:
                    break
                for start, rank, rule, verdict in at.get(None, ()):
                    if segment.startswith(start) and (best is None or rank > best[0]):
                        best = rank, rule, verdict
                at = at.get(segment)
        return best and best[1:]


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The input with host, path, rule (null if none fits) and verdict. `rules` has host, path and verdict; how
    many they are and how long is counted before they are broadcast."""
    clean = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").select(
        F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"), "verdict")
    n, chars = clean.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    if n > MAX_RULES or chars > MAX_CHARS:
        return judge_by_joins(urls, clean, url, default)
    trie = urls.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in clean.collect()]))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def verdicts(column: pd.Series) -> pd.DataFrame:
        rows = []
        for value in column:
            host, path = split_url(value)
            rule, verdict = trie.value.find(host, path) or (None, default)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=RESULTS)

    kept = [c for c in urls.columns if c not in RESULTS]
    judged = urls.withColumn("_judged", verdicts(F.col(f"`{url}`").cast("string")))
    return judged.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_judged.{c}").alias(c) for c in RESULTS])


def judge_by_joins(urls: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    """The same rows for rules of any number: distinct hosts and paths are joined with the rules on host suffix
    and path prefix, so both sides are shuffled and equal urls are judged once. Only the lengths that paths of
    rules have reach the driver."""
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    rest = F.try_element_at(F.split(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), "://", 2), F.lit(2))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    kept = [c for c in urls.columns if c not in RESULTS]
    parsed = urls.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    pairs = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keyed = (pairs.select("host", "path", F.explode(suffixes).alias("suffix"))
             .select("host", "path", "suffix", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))).alias("n"))
             .select("host", "path", "suffix", F.expr("substring(path, 1, n)").alias("prefix")))
    listed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict").groupBy("suffix", "prefix").agg(F.max("verdict").alias("verdict"))
    best = keyed.join(listed, ["suffix", "prefix"]).groupBy("host", "path").agg(F.max_by(
        F.struct(F.concat("suffix", "prefix").alias("rule"), "verdict"),
        F.struct(F.length("suffix") + F.length("prefix"), F.length("suffix"))).alias("best"))
    return (parsed.join(best, ["host", "path"], "left")
            .select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
