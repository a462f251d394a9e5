"""SimHash fingerprints and the search for those within a Hamming radius.

Terms are pairs of neighbouring words (the first word also with the start of the text). A term's 64-bit hash votes on
every bit, +1 or -1, with the weight 1 + ln(count in the text); the signs of the sums are the fingerprint. Texts that
share most of their terms get fingerprints that differ in few bits; unrelated ones differ in about half.

`near` finds all fingerprints within a radius by permuted block tables: with five blocks and a radius of three, two
fingerprints within the radius agree in at least two blocks, so for each of the ten choices of two blocks the
fingerprints are grouped by those blocks and compared within the group. Equal fingerprints are one entry. A pair counts in
the first table in which it meets, so no pairs are stored; groups over `BLOCK` entries are compared block by block
in tasks of their own.

Three bits hold few of the documents that share four fifths of their five-word shingles; nine bits held all of them where
it was measured (README). `search` therefore counts both: n_near within RADIUS, n_wide within WIDE. One search finds both, in
tables for WIDE; how many blocks they have follows from the number of fingerprints, and any choice finds every pair.

Defined cases: a null text is empty; a text without words has the fingerprint 0; terms that balance leave a bit 0; repeated
rows are documents of their own; rows that tie in doc_id follow each other by text, and a null doc_id comes after all
others; the empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Memo, attach, grouped, settle, text_of

BITS, RADIUS, BLOCKS = 64, 3, 5
#: Bits within which near copies (similarity 0.8 of five-word shingles) lie.
WIDE = 9
#: What an entry of a table costs, in comparisons: it is shuffled, a comparison is not.
ENTRY_COST = 1_000
#: Entries that one task compares with each other or with as many others.
BLOCK = 4096
#: Documents that should lie in one range of doc_id.
ROWS_PER_RANGE = 4_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def hasher():
    """A function from a text to its fingerprint."""
    memo = Memo(xxhash.xxh3_64_intdigest)

    def fingerprint(text: str) -> int:
        memo.trim()
        words = text.split()
        if not words:
            return 0
        votes = np.zeros(BITS)
        hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        terms = np.concatenate([[np.uint64(0)], hashes[:-1]]) * MIX + hashes
        terms ^= terms >> np.uint64(31)
        terms *= np.uint64(0xBF58476D1CE4E5B9)
        terms ^= terms >> np.uint64(29)
        terms, counts = np.unique(terms, return_counts=True)
        weights = 1 + np.log(counts)
        for k in range(0, len(terms), 4096):
            bits = np.unpackbits(terms[k:k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += 2 * (weights[k:k + 4096] @ bits) - weights[k:k + 4096].sum()
        return int(np.packbits(votes > 1e-9, bitorder="little").view(np.uint64)[0])
    return fingerprint


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def ranges_of(documents: DataFrame) -> list[int]:
    """doc_ids that cut the documents into ranges of about ROWS_PER_RANGE rows; a bounded summary finds them."""
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    parts = max(1, -(-n // ROWS_PER_RANGE))
    cuts = ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], min(0.01, 0.2 / parts)) if parts > 1 else []
    return sorted({int(c) for c in cuts})


def with_next(documents: DataFrame) -> DataFrame:
    """bucket, rank, doc_id, text of every row, and after the rows of each bucket a copy (look = true) of the row that
    comes next in descending doc_id. Each text is shuffled once; only the ids of first rows are broadcast."""
    cuts = ranges_of(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    bucket = F.lit(0)
    if cuts:
        listed = F.array(*map(F.lit, cuts))
        width = max(1, int(len(cuts) ** 0.5))
        blocks = [cuts[k:k + width] for k in range(0, len(cuts), width)]
        block = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda c: c < F.col("doc_id")))
        inside = F.size(F.filter(F.slice(listed, (block - 1) * width + 1, width), lambda c: c < F.col("doc_id")))
        bucket = F.coalesce(F.when(block > 0, (block - 1) * width + inside), F.lit(0))
    # descending ids: the last range comes first; nulls come after all others
    placed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - bucket).cast("int"))
    heads = {r["bucket"]: r["head"] for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    if not heads:
        return placed.select("bucket", F.lit(False).alias("look"), "doc_id", "text")
    order = sorted(heads)
    before = dict(zip(order, [order[-1], *order[:-1]]))
    ids = sorted({h for h in heads.values() if h is not None})
    first = rows.where(F.col("doc_id").isin(ids)) if len(ids) <= 200 else rows.join(
        F.broadcast(documents.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")
    if None in heads.values():
        first = first.unionByName(rows.where("doc_id is null"))
    # of rows that tie in the first doc_id, the least text comes first
    first = first.groupBy("doc_id").agg(F.min("text").alias("text"))
    target = F.create_map(*[F.lit(x) for b in order for x in (-1 if heads[b] is None else heads[b], before[b])])
    looks = first.withColumn("bucket", F.element_at(target, F.coalesce("doc_id", F.lit(-1))).cast("int"))
    return (placed.select("bucket", F.lit(False).alias("look"), "doc_id", "text")
            .unionByName(looks.select("bucket", F.lit(True).alias("look"), "doc_id", "text")))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (16 hex digits), near_edited, near_next."""
    def make():
        fingerprint = hasher()

        def rows(key, parts):
            held = None
            for part in parts:
                for look, i, t in zip(*[part.column(k).to_pylist() for k in (1, 4, 3)]):
                    own = fingerprint(t)
                    if held is not None:
                        before, text, mark = held
                        n = len(text)
                        edited = text[:n - n // 3] + t[:n // 3]
                        other = fingerprint(edited)
                        yield (before, n, hashlib.sha256(edited.encode()).hexdigest(), f"{mark:016x}", f"{other:016x}",
                               likeness(mark, other), likeness(mark, own))
                    held = None if look else (i, t, own)
        return rows

    source = with_next(documents).select("bucket", "look", F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)).alias("down"), "text", "doc_id")
    return grouped(source, ["bucket"], ["look", "down", "text"], make,
                   "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks - radius blocks, the bits of those blocks."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(bits, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """The number of blocks with which the tables of n fingerprints cost least: more blocks make more tables of smaller groups."""
    def cost(blocks: int) -> float:
        meet = n / 2 ** (BITS * (blocks - radius) / blocks)
        return math.comb(blocks, radius) * (ENTRY_COST * max(1.0, meet / BLOCK) + meet / 2)
    return min(range(radius + 1, radius + 5), key=cost)


def near(marks: DataFrame, radius: int = RADIUS, blocks: int | None = BLOCKS, wide: int | None = None) -> DataFrame:
    """For distinct fingerprints (column `fingerprint`, 16 hex digits, and `copies`): fingerprint, n_near (documents
    with another fingerprint within the radius), n_near_marks (such fingerprints) and, if `wide` (a larger radius) is given,
    n_wide (documents within it). Those without any are left out. `blocks`: None chooses them by the number of fingerprints."""
    reach = radius if wide is None else wide
    n_marks = marks.count()
    tables = masks(reach, blocks or blocks_for(n_marks, reach))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    high = F.shiftleft(F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long"), 32)
    value = high.bitwiseOR(F.conv(F.substring("fingerprint", 9, 8), 16, 10).cast("long"))
    entries = marks.select(value.alias("mark"), F.col("copies").cast("long").alias("copies"))
    keyed = entries.select("mark", "copies", F.explode(F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("mark").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(tables)])).alias("x")
    ).select(F.col("x.t").alias("t"), F.col("x.key").alias("key"), "mark", "copies")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # a group of n entries is cut into blocks; every two blocks meet in one task
    cut = attach(keyed, sizes, ["t", "key"], n_marks * len(tables)).withColumn("of", F.ceil(F.col("n") / BLOCK)).withColumn("b", F.pmod(F.xxhash64("mark"), F.col("of")))
    met = cut.select("t", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("o"), "b", "mark", "copies").select(
        "t", "key", F.least("o", "b").alias("i"), F.greatest("o", "b").alias("j"), "b", "mark", "copies")

    def make():
        bits = np.array(tables, np.uint64)

        def rows(key, parts):
            import pyarrow as pa

            both = pa.Table.from_batches(list(parts))
            t, _, i, j = key
            mark = both.column("mark").to_numpy().astype(np.int64).view(np.uint64)
            copies, b = both.column("copies").to_numpy(), both.column("b").to_numpy()
            left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
            near_, marks_, wide_ = (np.zeros(len(mark), np.int64) for _ in range(3))
            for k in range(0, len(left), 256):
                rows_ = left[k:k + 256]
                x = mark[rows_][:, None] ^ mark[right][None, :]
                p, q = np.nonzero((np.bitwise_count(x) <= reach) & (x != 0))
                x = x[p, q]
                for m in bits[:t]:  # pairs that met in an earlier table
                    new = (x & m) != 0
                    p, q, x = p[new], q[new], x[new]
                inner = np.bitwise_count(x) <= radius
                for a, b_ in ((rows_[p], right[q]), (right[q], rows_[p]))[:1 if i == j else 2]:
                    np.add.at(wide_, a, copies[b_])
                    np.add.at(near_, a[inner], copies[b_[inner]])
                    np.add.at(marks_, a[inner], 1)
            for k in np.flatnonzero(wide_):
                yield int(mark[k].astype(np.int64)), int(near_[k]), int(marks_[k]), int(wide_[k])
        return rows

    found = grouped(met, ["t", "key", "i", "j"], ["b", "mark"], make, "mark long, n_near long, n_near_marks long, n_wide long")
    names = ["n_near", "n_near_marks", *(["n_wide"] if wide is not None else [])]
    return found.groupBy("mark").agg(*[F.sum(c).alias(c) for c in names]).select(
        F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), *names)


def search(documents: DataFrame) -> DataFrame:
    """`fingerprints` with n_copies (other documents with the fingerprint), n_near (those within RADIUS besides) and n_wide (those
    within WIDE besides, which holds the near copies)."""
    marked = settle(fingerprints(documents))
    counts = settle(marked.groupBy("fingerprint").agg(F.count("*").alias("copies")))
    found = counts.join(near(counts, blocks=None, wide=WIDE), "fingerprint", "left").select(
        "fingerprint", "copies", (F.col("copies") - 1).alias("n_copies"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_near", "n_wide")])
    return attach(marked, found, ["fingerprint"], marked.count(), "copies").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                                    "near_edited", "near_next", "n_copies", "n_near", "n_wide")
