"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items share seeds: runs of `MIN_MATCH` equal words. Pairs whose seeds could cover enough of the item
are tiled: the longest common run of unmarked words is looked for with Karp-Rabin hashes of windows, marked on both sides, and
so on for shorter runs down to `MIN_MATCH`. The share of the item under tiles decides, so passages whose sentences were
put in another order are found too.

Words are lower-case stretches between spaces without the punctuation at their ends. The benchmark is read in blocks of
bounded size; each is broadcast and all documents pass it, so an item may be found in a document of any length.

Defined cases: a null text is empty and clean; items of fewer words than `MIN_WORDS` are found only where all their words follow
each other (coverage 1); those of fewer than `MIN_MATCH` (or null) have no seed and are left out; repeated items and rows are judged each; of items with equal coverage the least item_id is reported;
empty tables give no rows, or clean documents; `split` keeps all columns of the documents, whatever their names, other than
`contaminated`, `coverage`, `item_id`, `n_items`, which it replaces.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Memo, settle, text_of

MIN_MATCH, MIN_WORDS, THRESHOLD = 4, 8, 0.6
#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 32_000_000
RESULTS = ["contaminated", "coverage", "item_id", "n_items"]
MIX = np.uint64(0x9E3779B97F4A7C15)
STRIP = "".join(chr(k) for k in range(33, 127) if not chr(k).isalnum()) + "¡¿«»“”„‘’–—…"


def core(chunk: str) -> str:
    return chunk.strip(STRIP)


def words_of(text: str) -> list[str]:
    return [w for w in map(core, text.lower().split()) if w]


def window_hashes(ids: np.ndarray, size: int, prefix: np.ndarray | None = None) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of `size` ids: each rolls out of two prefix hashes."""
    prefix = prefix_hashes(ids) if prefix is None else prefix
    power = np.uint64(pow(int(MIX), size, 1 << 64))
    return prefix[size:] - prefix[:max(len(prefix) - size, 0)] * power


def prefix_hashes(ids: np.ndarray) -> np.ndarray:
    out, h = np.zeros(len(ids) + 1, np.uint64), 0
    for k, x in enumerate(ids.tolist()):
        h = (h * int(MIX) + x + 1) & 0xFFFFFFFFFFFFFFFF
        out[k + 1] = h
    return out


def tile(document: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in document, place in item, length) of maximal tiles that do not overlap, longest
    first; among equal lengths, those first in the document, then first in the item."""
    free_d, free_i = np.ones(len(document), bool), np.ones(len(item), bool)
    hashes_d, hashes_i = prefix_hashes(document), prefix_hashes(item)
    tiles, size = [], min(len(item), len(document))

    def open_windows(free: np.ndarray) -> np.ndarray:
        taken = np.append(0, np.cumsum(~free))
        return np.flatnonzero(taken[size:] == taken[:-size])

    while size >= least:
        table = defaultdict(list)
        open_i = open_windows(free_i)
        for at, h in zip(open_i.tolist(), window_hashes(item, size, hashes_i)[open_i].tolist()):
            table[h].append(at)
        open_d = open_windows(free_d)
        seen = window_hashes(document, size, hashes_d)[open_d]
        common = np.isin(seen, np.fromiter(table, np.uint64, len(table)))
        for at, h in zip(open_d[common].tolist(), seen[common].tolist()):
            for there in table[h]:
                if free_d[at:at + size].all() and free_i[there:there + size].all() and (document[at:at + size] == item[there:there + size]).all():
                    free_d[at:at + size] = free_i[there:there + size] = False
                    tiles.append((at, there, size))
                    break
        size = min(size - 1, int(free_i.sum()), int(free_d.sum()))
    return tiles


class Benchmark:
    """Items as word ids, and an index of their seeds."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, least: int):
        self.min_words, self.least, self.vocabulary, self.ids, self.items = min_words, least, {}, [], []
        for item_id, text in items:
            words = words_of(text or "")
            if len(words) >= least:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        seeds = [(h, k, at) for k, item in enumerate(self.items) for at, h in enumerate(window_hashes(item, least).tolist())]
        seeds.sort()
        self.seeds = np.array([s[0] for s in seeds], np.uint64)
        self.places = [(k, at) for _, k, at in seeds]

    def judge(self, text: str, memo: Memo, threshold: float) -> list[tuple[int, float]]:
        """(item_id, coverage) of the items whose coverage reaches the threshold."""
        memo.trim()
        ids = np.fromiter(map(memo.__getitem__, text.lower().split()), np.int64)
        ids = ids[ids >= 0]
        if len(ids) < self.least or not len(self.seeds):
            return []
        known = ids > 0
        whole = known[:len(known) - self.least + 1].copy()
        for k in range(1, self.least):
            whole &= known[k:len(known) - self.least + 1 + k]
        at = np.flatnonzero(whole)
        if not len(at):
            return []
        hashes = np.zeros(len(at), np.uint64)
        for k in range(self.least):  # the same polynomial as window_hashes, for these windows only
            hashes = hashes * MIX + ids[at + k].astype(np.uint64) + np.uint64(1)
        low, high = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        covered, spots = {}, defaultdict(list)
        for k in np.flatnonzero(high > low).tolist():
            for item, place in self.places[low[k]:high[k]]:
                if item not in covered:
                    covered[item] = np.zeros(len(self.items[item]), bool)
                covered[item][place:place + self.least] = True
                spots[item].append(int(at[k]))
        found = []
        for item, mask in covered.items():
            need = threshold if len(mask) >= self.min_words else 1.0
            if mask.sum() >= need * len(mask):  # tiles are made of seeds, so they cover no more than seeds do
                share = sum(n for _, _, n in tile(self.near(ids, spots[item]), self.items[item], self.least)) / len(mask)
                if share >= need:
                    found.append((self.ids[item], share))
        return found

    def near(self, ids: np.ndarray, spots: list[int]) -> np.ndarray:
        """The words under seeds; a zero, which is no word of the benchmark, stands for what lies between."""
        keep = np.zeros(len(ids) + 1, bool)
        for s in spots:
            keep[s:s + self.least] = True
        gap = ~keep & np.append(True, keep[:-1])
        return np.where(keep, np.append(ids, 0), 0)[keep | gap]


def judge_with(shared, threshold: float):
    """A function of a text column: coverage, item_id and n_items by the broadcast benchmark."""
    @F.pandas_udf("coverage double, item_id long, n_items long")
    def judged(texts: pd.Series) -> pd.DataFrame:
        bench, rows = shared.value, []
        memo = Memo(lambda chunk: bench.vocabulary.get(core(chunk), 0) if core(chunk) else -1)
        for text in texts:
            found = bench.judge(text, memo, threshold)
            best = min(found, key=lambda x: (-x[1], x[0])) if found else (None, 0.0)
            rows.append((best[1], best[0], len(found)))
        return pd.DataFrame({"coverage": [r[0] for r in rows], "item_id": pd.array([r[1] for r in rows], "Int64"), "n_items": [r[2] for r in rows]})

    return judged


def split(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with contaminated, coverage (of the item covered most, if it reaches the threshold, else 0), item_id (that
    item, or null) and n_items (items that reach it)."""
    context, kept = documents.sparkSession.sparkContext, [c for c in documents.columns if c not in RESULTS]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks, names = max(1, -(-chars // BLOCK_CHARS)), []
    out = documents.select(*[F.col(f"`{c}`") for c in kept])
    for k in range(blocks):
        # one block at a time: about BLOCK_CHARS of text on the driver and in each executor
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        shared = context.broadcast(Benchmark([tuple(r) for r in block], MIN_WORDS, MIN_MATCH))

        names.append(f"_block_{k}")
        out = out.withColumn(names[-1], judge_with(shared, threshold)(text_of()))
        if blocks > 1:
            out = settle(out)
            shared.unpersist()
    best = F.array_max(F.array(*[F.struct(F.col(f"{n}.coverage").alias("coverage"), (-F.col(f"{n}.item_id")).alias("down")) for n in names]))
    total = sum((F.col(f"{n}.n_items") for n in names), F.lit(0))
    return out.withColumn("_best", best).withColumn("_n", total).select(
        *[F.col(f"`{c}`") for c in kept], (F.col("_n") > 0).alias("contaminated"), F.col("_best.coverage").alias("coverage"),
        (-F.col("_best.down")).alias("item_id"), F.col("_n").cast("long").alias("n_items"))
