"""Hard negatives by angular triangle filtering.

Rows are integer vectors with a label; a score is the inner product of two rows. For each anchor its positives are the
best rows of its own label, and for each positive the best rows of other labels that score between FLOOR_SHARE and all of the
positive's score.

Every row is indexed with its angles to a few reference directions (fitted on a bounded sample, which only decides how much is
ruled out), its norm and the direction it is nearest to. If a row's angle to a direction is t and the anchor's is s, the angle between them lies
between |s - t| and s + t; over all directions this bounds the cosine, and times both norms, widened for rounding, the score. The
rows are dealt into shelves of bounded size, by position, so that a hot label or vector is spread like any other. A shelf
holds its rows by direction, sorted by angle: an anchor that needs a cosine of at least c can only meet rows whose angle is within arccos(c)
of its own, a window that binary search finds. Rows of the windows whose score bounds overlap what is asked for get integer scores.

Two visits of all anchors to all shelves: the first finds positives, starting from what the anchor's own direction has; the second
knows the exact window of each positive. Each shelf returns at most the first `n` rows for each question, and these are merged.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of unequal length are compared as if
padded with zeros; components of 2^54 and more and scores beyond a long raise an error; a null vec_id is no anchor, is never relabelled,
and comes last among ties; repeated rows each take part, as anchors too, and are ordered by nothing visible among themselves; a zero vector scores 0 with
all; a positive with a negative score has no negatives; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_schema, settle

SCALE = 256
#: Directions, and rows (those with the least hash of the id) that they are fitted on.
DIRECTIONS, SAMPLE, ROUNDS = 16, 4_096, 4
#: Rows of a shelf at most, on average, and least where there are fewer rows than tasks need.
SHELF, LEAST_SHELF = 65_536, 512
#: Relative slack of bounds that are computed in floating point; errors are below 1e-13.
SLACK = 1e-9


def as_integers(vectors: DataFrame, anchor_step: int, relabel_step: int, labels: int) -> DataFrame:
    """Rows (row, vec_id, label, anchor, vector) that take part; row numbers are distinct."""
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.coalesce(F.col("vec_id") % relabel_step == 0, F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .where(usable).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.when(moved, (F.col("label") + 1) % labels).otherwise(F.col("label")).alias("label"),
        F.coalesce(F.col("vec_id") % anchor_step == 0, F.lit(False)).alias("anchor"),
        F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("vector"))


def directions(rows: DataFrame, k: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors by spherical k-means on the sample."""
    sample = rows.select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).collect()
    width = max([1, *(len(r["vector"]) for r in sample)])
    x = np.array([r["vector"] + [0] * (width - len(r["vector"])) for r in sample], float).reshape(-1, width)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.eye(1, width)
    x /= np.linalg.norm(x, axis=1)[:, None]
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):  # the one furthest from those chosen
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[nearest == c].sum(axis=0) for c in range(len(centres))])
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def indexed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """With vector as bytes of 64-bit integers, its norm, angles to the directions (bytes of doubles), and which is nearest."""
    schema = "row long, vec_id long, label long, anchor boolean, vector binary, norm double, angles binary, cell int"
    target = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            column = batch.column(4)
            if not batch.num_rows:
                continue
            ends = np.asarray(column.offsets)
            values = np.asarray(column.values)[ends[0]:ends[-1]]
            lengths = np.diff(ends)
            width = max(centres.shape[1], int(lengths.max()))
            if len(values) and max(int(values.max()), -int(values.min())) >= 1 << 62:
                raise ValueError("components of 2^54 and more")
            x = np.zeros((batch.num_rows, width), np.int64)
            x[np.arange(width) < lengths[:, None]] = values
            unit = x.astype(float)
            norm = np.linalg.norm(unit, axis=1)
            unit /= np.maximum(norm, 1e-300)[:, None]
            cosine = np.clip(unit[:, :centres.shape[1]] @ centres.T, -1, 1)
            angles = np.arccos(cosine)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:4], pa.array([v[:n].tobytes() for v, n in zip(x, lengths)], pa.binary()), pa.array(norm),
                pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(cosine.argmax(axis=1).astype(np.int32))], schema=target)

    return rows.mapInArrow(run, schema)


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), width)
    return np.array([np.frombuffer(b + bytes(8 * width - len(b)), np.int64) for b in blobs], np.int64).reshape(len(blobs), width)


class Shelf:
    """Indexed rows in memory, by direction and angle."""

    def __init__(self, row, vec_id, label, vector, norm, angles, cell):
        order = np.lexsort((np.frombuffer(b"".join(angles)).reshape(len(row), -1)[np.arange(len(row)), cell], cell)) if len(row) else np.zeros(0, int)
        self.width = max([1, *(len(v) // 8 for v in vector)])
        self.row, self.label, self.norm = (np.array(x)[order] for x in (row, label, norm))
        self.missing = np.array([v is None for v in vec_id])[order]
        self.vec_id = np.array([0 if v is None else v for v in vec_id], np.int64)[order]
        self.x = matrix([vector[k] for k in order], self.width)
        self.angles = np.frombuffer(b"".join(angles)).reshape(len(row), -1)[order]
        self.cos, self.sin = np.cos(self.angles), np.sin(self.angles)
        cells = np.array(cell)[order]
        self.cells = [(c, *np.searchsorted(cells, (c, c + 1))) for c in np.unique(cells)]
        self.most = [self.norm[a:b].max() for _, a, b in self.cells]
        self.exact = self.norm.max(initial=0)
        self.reals = self.x.astype(float)

    def windows(self, angles: np.ndarray, norm: float, least: float) -> np.ndarray:
        """Rows that may score `least`, by the angle to the direction of their cell."""
        if least <= 0:
            return np.arange(len(self.row))
        found = []
        for (c, a, b), most in zip(self.cells, self.most):
            cosine = least / max(norm * most, 1e-300) - SLACK
            if cosine <= 1:
                reach = np.arccos(max(cosine, -1)) + SLACK
                start, stop = np.searchsorted(self.angles[a:b, c], (angles[c] - reach, angles[c] + reach))
                found.append(np.arange(a + start, a + stop))
        return np.concatenate(found) if found else np.zeros(0, int)

    def bounds(self, rows: np.ndarray, angles: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of the rows with the anchor, by all directions."""
        near, away = self.cos[rows] * np.cos(angles), self.sin[rows] * np.sin(angles)
        size = norm * self.norm[rows]
        slack = size * SLACK
        return np.ceil(size * (near - away).max(axis=1) - slack), np.floor(size * (near + away).min(axis=1) + slack)

    def scores(self, rows: np.ndarray, vector: np.ndarray, norm: float) -> np.ndarray:
        """Integer inner products: in doubles where every partial sum is exact in them, else in Python's integers."""
        width = min(self.width, len(vector))
        if norm * self.exact < 2.0 ** 52:
            return (self.reals[rows, :width] @ vector[:width].astype(float)).astype(np.int64)
        return np.array([int(sum(int(p) * int(q) for p, q in zip(r, vector))) for r in self.x[rows, :width]], np.int64)

    def first(self, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Places in `rows` of the first n: higher scores, then smaller ids, missing ids last."""
        if len(rows) > n:
            least = np.partition(scores, -n)[-n]
            some = np.flatnonzero(scores >= least)
        else:
            some = np.arange(len(rows))
        r = rows[some]
        return some[np.lexsort((self.row[r], self.vec_id[r], self.missing[r], -scores[some]))[:n]]


def own_label(shelf: Shelf, row: int, label: int, vector: np.ndarray, norm: float, angles: np.ndarray, cell: int, n: int) -> list[tuple]:
    """The first n rows of the anchor's label."""
    def others(rows):
        return rows[(shelf.label[rows] == label) & (shelf.row[rows] != row)]

    least = -np.inf  # that of the n-th row in the anchor's own cell
    near = next((others(np.arange(a, b)) for c, a, b in shelf.cells if c == cell), ())
    if len(near) >= n:
        least = float(np.partition(shelf.scores(near, vector, norm), -n)[-n])
    rows = others(shelf.windows(angles, norm, least))
    if not len(rows):
        return []
    low, high = shelf.bounds(rows, angles, norm)
    if len(rows) >= n:
        least = max(least, np.partition(low, -n)[-n])
    rows = rows[high >= least]
    scores = shelf.scores(rows, vector, norm)
    return [(rows[k], int(scores[k])) for k in shelf.first(rows, scores, n)]


def other_labels(shelf: Shelf, label: int, vector: np.ndarray, norm: float, angles: np.ndarray, n: int, goals: list[tuple[int, int]]) -> list[tuple]:
    """Of the rows of other labels, the first n for each goal (least, greatest score)."""
    goals = [g for g in goals if g[0] <= g[1]]
    if not goals:
        return []
    least, greatest = min(g[0] for g in goals), max(g[1] for g in goals)
    rows = shelf.windows(angles, norm, least)
    rows = rows[shelf.label[rows] != label]
    if not len(rows):
        return []
    low, high = shelf.bounds(rows, angles, norm)
    rows = rows[(high >= least) & (low <= greatest)]
    scores = shelf.scores(rows, vector, norm)
    chosen = {}
    for a, b in sorted(set(goals)):
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        for k in shelf.first(rows[inside], scores[inside], n):
            chosen[inside[k]] = None
    return [(rows[k], int(scores[k])) for k in chosen]


def visits(rows: DataFrame, anchors: DataFrame, shelves: int, n: int, second: bool) -> DataFrame:
    """(anchor, row, vec_id, score): what each shelf has for each anchor, which in the second visit brings its goals."""
    shelf_of = F.pmod(F.xxhash64("row"), F.lit(shelves)).cast("int").alias("shelf")
    nothing = F.lit(None).cast("array<long>")
    own = rows.select(shelf_of, F.lit(0).alias("kind"), "row", "vec_id", "label", "vector", "norm", "angles", "cell", nothing.alias("goals"))
    every = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))).alias("shelf"), F.lit(1).alias("kind"), "row", "vec_id", "label", "vector", "norm", "angles",
                           "cell", "goals")
    schema = "anchor long, row long, vec_id long, score long"
    target = arrow_schema(schema)

    def run(batches):
        # rows of a task come by shelf, those of the index first; one shelf is held at a time
        number, gathered, shelf, out = None, [], None, []
        for batch in batches:
            for shelf_no, kind, row, vec_id, label, vector, norm, angles, cell, goals in zip(*[c.to_pylist() for c in batch.columns]):
                if shelf_no != number:
                    number, gathered, shelf = shelf_no, [], None
                if kind == 0:
                    gathered.append((row, vec_id, label, vector, norm, angles, cell))
                    continue
                if not gathered:
                    continue
                shelf = shelf or Shelf(*zip(*gathered))
                vector, angles = np.frombuffer(vector, np.int64), np.frombuffer(angles)
                if second:
                    found = other_labels(shelf, label, vector, norm, angles, n, list(zip(goals[::2], goals[1::2])))
                else:
                    found = own_label(shelf, row, label, vector, norm, angles, cell, n)
                out += [(row, int(shelf.row[k]), None if shelf.missing[k] else int(shelf.vec_id[k]), score) for k, score in found]
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=target)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=target)

    return own.unionByName(every).repartition(shelves, "shelf").sortWithinPartitions("shelf", "kind").mapInArrow(run, schema)


def ranked(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n of each key with their rank: higher scores, then smaller ids."""
    order: list[Column] = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, floor_share: int = 80, anchor_step: int = 100, relabel_step: int = 7, labels: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. A negative scores at least `floor_share` hundredths
    of the positive and at most as much."""
    spark = vectors.sparkSession
    raw = settle(as_integers(vectors, anchor_step, relabel_step, labels))
    rows = settle(indexed(raw, directions(raw)))
    n = rows.count()
    # at least so many shelves that a task's rows fit in memory; more where there are tasks to keep busy
    shelves = max(1, -(-n // SHELF), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_SHELF)))
    anchors = rows.where("anchor")
    first = visits(rows, anchors.withColumn("goals", F.lit(None).cast("array<long>")), shelves, positives, second=False)
    best = settle(ranked(first, ["anchor"], positives).select(
        "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("row").alias("positive_row")))
    floor = F.expr(f"(positive_score * {floor_share} + 99) div 100")
    goals = best.where("positive_score >= 0").groupBy("anchor").agg(F.flatten(F.collect_list(F.array(floor, F.col("positive_score")))).alias("goals"))
    asking = anchors.join(goals, anchors["row"] == goals["anchor"]).drop("anchor")
    found = visits(rows, asking, shelves, negatives, second=True)
    pairs = found.join(best, "anchor").where((F.col("score") * 100 >= F.col("positive_score") * floor_share) & (F.col("score") <= F.col("positive_score")))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked(pairs, ["anchor", "positive_row"], negatives).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
