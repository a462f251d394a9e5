"""Best-fit packing of token sequences by exact complements.

Texts become token ids with an end id after each; what is longer than a sequence is cut. How pieces are combined depends
on their lengths alone, so the plan is made on the histogram of lengths, which has at most `capacity` entries however
many documents there are: every length, longest first, looks for one length, a pair or a triple that fills its gap
exactly, and takes as many as their counts allow; what is left is packed best-fit, longest first, into the fullest
open sequences it fits. Pieces of a length are then numbered, and the plan says for each number which sequence and
offset it has. Numbering is by buckets of a hash, so a very frequent length is no single task.

Defined cases: a null text is empty and has the end id only; repeated rows are packed each; equal lengths are told
apart by doc_id, then piece and checksum; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, settle, text_of

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: ASCII marks but the apostrophe, which may begin a contraction.
MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
ROWS_PER_BUCKET = 100_000
#: Words in one generation of the memo.
GENERATION = 400_000


def letters_only(word: str) -> bool:
    """Letters that are still letters only after the tokenizer's normalization (NFC, lower case)."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Encoder:
    """Ids of texts as bytes (little-endian unsigned 32-bit, without the end id), by way of a memo of words. The tokenizer drops
    white space and never joins across it, so words between spaces and line breaks are encoded once per task.

    Words that are new to a task are encoded together: those of letters only as one text, whose ids fall apart at the ids that
    end a word. A word of letters with marks behind it is the word and the marks, since the tokenizer never joins
    them. The memo has two generations, so frequent words stay while memory is bounded."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        young, old = self.young, self.old
        known = old.keys() & words
        parts: set[str] = set()
        cores: dict[str, tuple[str, str]] = {}
        for word in words.difference(known) if known else words:
            core = word.rstrip(MARKS)
            if core == word or not letters_only(core):
                core = word
            tail = word[len(core):]
            if core.isascii() and core.isalpha():
                core = core.lower()
            parts.add(core)
            if core != word:
                parts.add(tail)
                cores[word] = core, tail
        for word in known | (old.keys() & parts):
            young[word] = old[word]
        new = parts.difference(young)
        letters = [w for w in new if letters_only(w)]
        ids = np.array(self.encode([" ".join(letters)])[0], "<u4")
        cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1).tolist() if len(ids) else [0]
        if len(cuts) != len(letters) + 1:  # some letters are joined or dropped by the normalizer: one by one then
            letters, cuts = [], []
        data = ids.tobytes()
        for word, start, end in zip(letters, cuts, cuts[1:]):
            young[word] = data[4 * start:4 * end]
        rest = list(new.difference(letters))
        for word, found in zip(rest, self.encode(rest)):
            young[word] = np.array(found, "<u4").tobytes()
        for word, (core, tail) in cores.items():
            young[word] = young[core] + young[tail] if tail else young[core]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids without places in the text, which would cost about as much as the ids."""
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.young) > GENERATION:
            self.young, self.old = {}, self.young
        self.young[""] = b""  # between two spaces
        self.learn(set().union(*split).difference(self.young))
        return [b"".join(map(self.young.__getitem__, words)) for words in split]


@lru_cache(1)
def encoder_of(path: str | None) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def stretches(ids: list, texts: list[str], chars: int = 1_000_000):
    """The rows in stretches of about so many characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars or k == len(texts) - 1:
            yield ids[start:k + 1], texts[start:k + 1]
            start, size = k + 1, 0


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document."""
    def make():
        encode, end = encoder_of(path), np.array([end_id], "<u4").tobytes()

        def rows(ids, texts):
            for some_ids, some in stretches(ids, texts):
                for i, data in zip(some_ids, encode(some)):
                    data += end
                    for k in range(0, len(data), 4 * capacity):
                        part = data[k:k + 4 * capacity]
                        yield i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)
        return rows

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), make, SCHEMA)


class Plan:
    """Rows (length, first, n, per, sequence, offset): pieces first .. first + n - 1 of that length, `per` in each
    sequence, go to the sequences from `sequence` on, one behind the other from `offset`."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.used, self.sequences = capacity, [], defaultdict(int), 0

    def add(self, content: list[tuple[int, int]], times: int) -> None:
        """`times` sequences that hold (length, how many) each."""
        offset = 0
        for length, per in content:
            self.rows.append((length, self.used[length], per * times, per, self.sequences, offset))
            self.used[length] += per * times
            offset += length * per
        self.sequences += times


def runs(lengths: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for length in sorted(lengths, reverse=True):
        if out and out[-1][0] == length:
            out[-1] = length, out[-1][1] + 1
        else:
            out.append((length, 1))
    return out


def complement(gap: int, left: np.ndarray, pairs: np.ndarray) -> list[int] | None:
    """One, two or three lengths that sum to the gap and are there often enough. `pairs` marks sums of two lengths that
    occurred at the start, an index that may say yes too often but never no wrongly."""
    if left[gap]:
        return [gap]

    def pair(total: int, spare: int = 0) -> list[int] | None:
        if total < 2 or not pairs[total]:
            return None
        low = np.arange(1, total // 2 + 1)
        have = left[low] - (low == spare)
        there = left[total - low] - (total - low == spare)
        fits = np.flatnonzero((have > 0) & (there > 0) & ((low * 2 != total) | (have > 1)))
        return [int(total - low[fits[0]]), int(low[fits[0]])] if len(fits) else None

    if found := pair(gap):
        return found
    large = np.flatnonzero(left[:gap - 1])[::-1] if gap > 2 else []
    for first in large:
        if 3 * first < gap:
            break
        if pairs[gap - first] and (found := pair(gap - int(first), int(first))):
            return [int(first), *found]
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    made = Plan(capacity)
    made.add([(capacity, 1)], int(left[capacity])) if left[capacity] else None
    left[capacity] = 0
    occurs = (left > 0).astype(float)
    sums = np.rint(np.fft.irfft(np.fft.rfft(occurs, 4 * capacity) ** 2, 4 * capacity)) > 0
    pairs = sums[:capacity + 1]
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1  # this one needs the complement
            rest = complement(capacity - length, left, pairs)
            left[length] += 1
            if rest is None:
                break
            need = runs([length, *rest])
            times = int(min(left[k] // n for k, n in need))
            for k, n in need:
                left[k] -= n * times
            made.add(need, times)
    best_fit(left, made)
    return made


def best_fit(left: np.ndarray, made: Plan) -> None:
    """Longest first into the open sequences with the least room that suffices; sequences of equal content are one entry."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [content, times]
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        for room in sorted(k for k in open_ if k >= length):
            while n and open_[room]:
                content, times = open_[room].pop()
                per = min(room // length, n)
                full = min(times, n // per)
                if full < times:
                    open_[room].append([content, times - full])
                open_[room - per * length].append([[*content, (length, per)], full])
                n -= full * per
            if not n:
                break
        if n:
            per = made.capacity // length
            if n >= per:
                open_[made.capacity - per * length].append([[(length, per)], n // per])
            if n % per:
                open_[made.capacity - n % per * length].append([[(length, n % per)], 1])
        left[length] = 0
    for room in sorted(open_):
        for content, times in open_[room]:
            made.add(content, times)


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. The texts are read once."""
    cut = settle(pieces(documents, path, capacity, end_id))
    buckets = max(32, -(-cut.count() // ROWS_PER_BUCKET))
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = settle(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = (bucketed.withColumn("k", F.row_number().over(within) - 1).join(starts, ["length", "bucket"])
                .withColumn("number", F.col("k") + F.col("before")))
    table = documents.sparkSession.sparkContext.broadcast(np.array(sorted(made.rows), np.int64).reshape(-1, 6))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        rows = table.value
        wide = 1 << 44
        at = np.searchsorted(rows[:, 0] * wide + rows[:, 1], length.to_numpy() * wide + number.to_numpy(), "right") - 1
        k = number.to_numpy() - rows[at, 1]
        return pd.DataFrame({"sequence_id": rows[at, 4] + k // rows[at, 3], "offset": rows[at, 5] + k % rows[at, 3] * rows[at, 0]})

    placed = numbered.withColumn("_at", place("length", "number"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
