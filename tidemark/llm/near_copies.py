"""N-gram Jaccard join by MinHash banding.

A document is the set of its shingles of five words (lower case, between spaces); a text of one to four words is one
shingle. Documents with equal sets are one class. Band and row counts are chosen for a target recall at the wanted
similarity; classes that agree in a band are joined to the least of them, and connected classes come together in
tasks of bounded size, where the pairs that share a band are verified on their full sets. Counts of links and the edges
of a spanning forest leave those tasks, never all pairs. Each set is shuffled once for each block of its component;
a component of up to BLOCK_CLASSES classes and BLOCK_SHINGLES shingles is one block. Where only the groups are wanted, classes first
meet the least of their bands only, and blocks are made just of those that share a band with a class of another group.

Defined cases: a null text is empty; texts without words are one class; repeated rows are in one class; a null
doc_id is ignored as class id unless all ids of a class are null; ties of ids cannot change the result; empty tables give no
rows; other columns are ignored by `join`, and `keep_one` keeps them and exactly one row of each group: that with the least
(doc_id, text), nulls last.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Memo, attach, connected, grouped, map_rows, settle, sized, text_of

WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.9999, 4
#: Shingles and classes that one block of a component has on average at most; every two blocks meet in a task of their own.
BLOCK_SHINGLES, BLOCK_CLASSES = 1_000_000, 512
PRIME = np.uint64((1 << 61) - 1)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` hashes so that a pair at the similarity meets in one with the wanted chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity ** rows)))


def shingler(words: int = WORDS):
    """A function from a text to its sorted distinct shingle hashes."""
    memo = Memo(xxhash.xxh3_64_intdigest)

    def shingles(text: str) -> np.ndarray:
        memo.trim()
        parts = text.lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        size = min(words, len(parts))
        hashes = np.fromiter(map(memo.__getitem__, parts), np.uint64, len(parts))
        out = np.full(len(parts) - size + 1, np.uint64(size))
        for k in range(size):
            out = (out ^ hashes[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)
    return shingles


def signer(bands: int, rows: int = ROWS, seed: int = 11):
    """A function from shingle hashes to one 64-bit hash per band."""
    draw = np.random.default_rng(seed)
    a = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    mixers = draw.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def sign(sets: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
        for k in range(0, len(sets), 2048):
            x = sets[k:k + 2048, None] * a + b  # the high bits of an odd multiple are well mixed
            np.minimum(least, (x ^ (x >> np.uint64(33))).min(axis=0), out=least)
        least = least.reshape(bands, rows)
        out = np.zeros(bands, np.uint64)
        for k in range(rows):
            out = (out ^ least[:, k]) * mixers[:, k]
            out ^= out >> np.uint64(29)
        return out.view(np.int64)
    return sign


def signed(documents: DataFrame, similarity: float, recall: float) -> DataFrame:
    """doc_id, text_hash, class_key (128-bit hash of the set), n_shingles, bands."""
    bands = choose_bands(similarity, recall)

    def make():
        shingles, sign = shingler(), signer(bands)

        def rows(ids, hashes, texts):
            for i, h, t in zip(ids, hashes, texts):
                s = shingles(t)
                yield i, h, xxhash.xxh3_128_digest(s.tobytes()), len(s), sign(s).tolist() if len(s) else []
        return rows

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text")),
                    make, "doc_id long, text_hash long, class_key binary, n_shingles long, bands array<long>")


def blocks_of(n: str, shingles: str) -> Column:
    """Blocks for so many classes and shingles."""
    return F.greatest(F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.ceil(F.col(n) / BLOCK_CLASSES), F.lit(1)).cast("int")


def verified(documents: DataFrame, members: DataFrame, similarity: float, every_link: bool) -> DataFrame:
    """Verified links of classes that meet: rows (class_key, other, copies, n). With `other` null: the class has n links to classes which
    have `copies` documents together, found in one meeting (only if every link is wanted); else an edge of a spanning forest of the links.

    `members` has class_key, part, copies, bands, doc_id, text_hash and meets: where the class goes, as (root, i, j, side). In a
    meeting, classes of side 0 are compared with those of side 1, and those of side 2 with each other, if they share a band and differ in part."""
    # the text of one document of each class, for the full set
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    first = members.join(texts, members["text_hash"].eqNullSafe(texts["text_hash"]) & members["doc_id"].eqNullSafe(texts["doc_id"])).select(
        "class_key", "part", "copies", "bands", "meets", "text")

    def make_sets():
        shingles = shingler()

        def rows(key, part, copies, bands, meets, text):
            for c, p, n, h, m, t in zip(key, part, copies, bands, meets, text):
                yield c, p, n, h, m, shingles(t).tobytes()
        return rows

    sets = map_rows(first, make_sets, "class_key binary, part binary, copies long, bands array<long>, meets array<struct<root binary, i int, j int, side int>>, shingles binary")
    met = sets.select(F.explode("meets").alias("m"), "class_key", "part", "copies", "bands", "shingles").select(
        "m.root", "m.i", "m.j", "m.side", "class_key", "part", "copies", "bands", "shingles")

    def make_pairs():
        def rows(key, parts):
            seen, sides = set(), ([], [], [])
            for part in parts:
                for side, c, p, n, h, s in zip(*[part.column(k).to_pylist() for k in range(3, 9)]):
                    if c not in seen:  # a repeated row of the document that stands for the class
                        seen.add(c)
                        sides[side].append((c, p, n, np.array(h, np.int64), np.frombuffer(s, np.uint64)))
            left, right = (sides[2], sides[2]) if sides[2] else sides[:2]
            if not left or not right:
                return
            count, reach, forest = {}, {}, {}
            bands = np.array([e[3] for e in right])
            for x, (c, v, n, h, s) in enumerate(left):
                shared = np.flatnonzero((bands == h).any(axis=1))
                for y in shared.tolist():
                    d, w, m, _, t = right[y]
                    if (left is right and y <= x) or v == w or min(len(s), len(t)) < similarity * max(len(s), len(t)):
                        continue
                    if not every_link and _root(forest, c) == _root(forest, d):
                        continue
                    common = int(np.isin(s, t, assume_unique=True).sum())
                    if common >= similarity * (len(s) + len(t) - common) - 1e-9:
                        for p, q in ((c, m), (d, n)) if every_link else ():
                            count[p], reach[p] = count.get(p, 0) + 1, reach.get(p, 0) + q
                        p, q = _root(forest, c), _root(forest, d)
                        if p != q:
                            forest[max(p, q)] = min(p, q)
            for p in count:
                yield p, None, reach[p], count[p]
            for p in forest:
                yield p, _root(forest, p), 0, 0
        return rows

    return settle(grouped(met, ["root", "i", "j"], ["side", "class_key"], make_pairs, "class_key binary, other binary, copies long, n long"))


def in_blocks(classes: DataFrame, component: DataFrame, n_classes: int) -> DataFrame:
    """Members that meet all others of their component, in tasks of bounded size: `component` has (class_key, part, root)."""
    placed = settle(sized(classes.join(component, "class_key").select("class_key", "part", "root", "copies", "n_shingles", "bands", "doc_id", "text_hash"), n_classes))
    sizes = sized(placed.groupBy("root").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n")), n_classes).select("root", blocks_of("n", "s").alias("blocks"), "n")
    numbered = attach(placed, sizes, ["root"], n_classes).withColumn("b", F.pmod(F.xxhash64("class_key"), F.col("blocks")).cast("int"))
    side = lambda o: F.when(o == F.col("b"), 2).when(o < F.col("b"), 1).otherwise(0)
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.col("root").alias("root"), F.least(o, "b").alias("i"), F.greatest(o, "b").alias("j"), side(o).alias("side")))
    return settle(numbered.select("class_key", "part", "copies", "bands", "doc_id", "text_hash", meets.alias("meets")))


def in_stars(classes: DataFrame, stars: DataFrame, n_edges: int, n_classes: int) -> DataFrame:
    """Members that meet the least class of each of their bands: `stars` has distinct (a, b), b the least."""
    sized_edges = stars.join(classes.select(F.col("class_key").alias("a"), "n_shingles"), "a")  # a class has no more edges than bands
    hubs = settle(sized(sized_edges.groupBy("b").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n")), n_edges).select("b", blocks_of("n", "s").alias("blocks"), "n"))
    meeting = lambda root, i, side: F.struct(F.col(root).alias("root"), i.cast("int").alias("i"), F.lit(0).alias("j"), F.lit(side).alias("side"))
    rays = attach(stars, hubs, ["b"], n_edges).select(F.col("a").alias("class_key"), F.array(meeting("b", F.pmod(F.xxhash64("a"), F.col("blocks")), 1)).alias("meets"))
    centres = hubs.select(F.col("b").alias("class_key"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: meeting("b", i, 0)).alias("meets"))
    meets = sized(rays.unionByName(centres).groupBy("class_key").agg(F.flatten(F.collect_list("meets")).alias("meets")), n_edges)
    return settle(sized(classes.join(meets, "class_key"), n_classes).select("class_key", F.col("class_key").alias("part"), "copies", "bands", "doc_id", "text_hash", "meets"))


def links(documents: DataFrame, classes: DataFrame, similarity: float, every_link: bool = True) -> DataFrame:
    """Verified links of the classes, as `verified` has them. `classes` has class_key, copies, n_shingles, bands, doc_id, text_hash.

    For every link, classes that are connected by shared bands meet all in blocks. Where only the groups are wanted, each class first meets the
    least class of each of its bands; what this connects is done, and only classes that share a band with one of another group meet in blocks."""
    keyed = classes.select("class_key", F.posexplode("bands").alias("band", "hash"))
    n_classes, n_keys = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()
    least = settle(sized(keyed.groupBy("band", "hash").agg(F.min("class_key").alias("least"), F.count("*").alias("n")).where("n > 1"), n_keys))
    near = attach(keyed, least, ["band", "hash"], n_keys)
    stars = settle(sized(near.where("class_key <> least").select(F.col("class_key").alias("a"), F.col("least").alias("b")).distinct(), n_keys))
    if every_link:
        component = connected(stars).select(F.col("node").alias("class_key"), F.col("node").alias("part"), "root")
        return verified(documents, in_blocks(classes, component, n_classes), similarity, True)
    n_edges = stars.count()
    found = verified(documents, in_stars(classes, stars, n_edges, n_classes), similarity, False)
    groups = connected(found.select(F.col("class_key").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("class_key"), F.col("root").alias("group"))
    shared = settle(sized(near.select("class_key", "band", "hash", "n").join(groups, "class_key", "left").select(
        "class_key", "band", "hash", "n", F.coalesce("group", "class_key").alias("part")), n_keys))
    open_bands = settle(sized(shared.groupBy("band", "hash").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low < high"), n_keys))
    open_keys = settle(attach(shared.drop("n"), open_bands, ["band", "hash"], n_keys).select("class_key", "part", "low"))
    parts = connected(open_keys.select(F.col("part").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("part"), "root")
    active = open_keys.select("class_key", "part").distinct()
    sizes = active.groupBy("part").agg(F.count("*").alias("n")).join(parts, "part")
    component = attach(active, sizes, ["part"], n_classes).select("class_key", "part", "root")
    return found.unionByName(verified(documents, in_blocks(classes, component, n_classes), similarity, False))


def _root(forest: dict, node: bytes) -> bytes:
    while node in forest:
        forest[node] = forest.get(forest[node], forest[node])
        node = forest[node]
    return node


def classed(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, every_link: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, class_key) of the documents, and classes (class_key, class_id, group_id, copies, n_links, n_class_links,
    group_key, and of the first document doc_id and text_hash). Without every link, numbers of links are not counted."""
    rows = settle(signed(documents, similarity, recall))
    classes = settle(rows.groupBy("class_key").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")).select(
        "class_key", "class_id", "copies", "n_shingles", "bands", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")))
    found = links(documents, classes, similarity, every_link)
    counts = found.where("other is null").groupBy("class_key").agg(F.sum("copies").alias("reach"), F.sum("n").alias("n"))
    groups = connected(found.where("other is not null").select(F.col("class_key").alias("a"), F.col("other").alias("b"))).select(
        F.col("node").alias("class_key"), F.col("root").alias("group_key"))
    joined = settle(classes.drop("n_shingles", "bands").join(counts, "class_key", "left").join(groups, "class_key", "left").withColumn(
        "group_key", F.coalesce("group_key", "class_key")))
    ids = joined.groupBy("group_key").agg(F.min("class_id").alias("group_id"), F.count("*").alias("n_classes"))
    return rows.select("doc_id", "text_hash", "class_key"), settle(attach(joined, ids, ["group_key"], classes.count(), "n_classes").select(
        "class_key", "group_key", "class_id", "group_id", "copies", (F.col("copies") - 1 + F.coalesce("reach", F.lit(0))).alias("n_links"),
        F.coalesce("n", F.lit(0)).alias("n_class_links"), "doc_id", "text_hash"))


def join(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least id with the same set), group_id (least id connected by links), n_links (other
    documents that are similar enough, copies included), n_class_links (other classes)."""
    rows, classes = classed(documents, similarity, recall)
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    facts = classes.drop("doc_id", "text_hash")
    return attach(rows.drop("text_hash"), facts, ["class_key"], total, "copies").select("doc_id", "class_id", "group_id", "n_links", "n_class_links")


def keep_one(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents with one row of each group left, and all their columns."""
    _, classes = classed(documents, similarity, recall, every_link=False)
    kept = classes.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")).select(
        F.col("first.none").alias("_none"), F.coalesce("first.doc_id", F.lit(0)).alias("_id"), F.col("first.text_hash").alias("_hash"))
    number = F.col("doc_id").cast("long")
    hashed = documents.select(F.struct(*[f"`{c}`" for c in documents.columns]).alias("row"), number.isNull().alias("_none"),
                              F.coalesce(number, F.lit(0)).alias("_id"), F.xxhash64(text_of()).alias("_hash"))
    # repeated rows are dropped by the keys of the join, so that texts are shuffled once
    return hashed.join(kept, ["_none", "_id", "_hash"]).dropDuplicates(["_none", "_id", "_hash"]).select("row.*")
