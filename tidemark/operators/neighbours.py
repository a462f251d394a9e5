"""Exact nearest-neighbour imputation, with gaps in the features.

The distance of two rows is the root mean square over the features both have. Donors with equal
features are merged (at most k target values of them can matter) and so are receivers, so a hot group
shrinks to a few rows.

Rows are told apart by which features they have, their pattern. A receiver of one pattern and a donor of another compare the
features both patterns have, and on these the distance is a metric. So for every donor pattern and every such projection that
receivers need, donors are put in the cell of their nearest pivot, by that projection; a receiver visits only cells that the
triangle inequality cannot rule out, with one bound over all the indexes it uses. Pairs of patterns with little to compare, rare
patterns and rows with infinite features get no index; receivers visit those donors all. Each donor is met once by each receiver.

Cells are cut into blocks of bounded size, a task compares two blocks in NumPy and passes on k candidates per receiver.
Patterns, indexes and pivots on the driver are bounded in number. Work is at worst the product of distinct donors and receivers;
memory per task stays bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import as_double
from ..sources.scratch import settle
from .lookup import lookup

DONOR_BLOCK = 20_000
RECEIVER_BLOCK = 20_000
CELL_ROWS = 1_000   # donors a cell should hold, where MAX_PIVOTS allows
MAX_PIVOTS = 1_024   # of all indexes together
MAX_INDEXES = 64   # the pairs of patterns with most to compare
MAX_PATTERNS = 64   # the commonest of donors and of receivers
REST_CELL = -1   # donors of other patterns, or with infinite features


def fill_from_neighbours(df: DataFrame, target: str, features: list[str], k: int = 5,
                         donor_block: int = DONOR_BLOCK, receiver_block: int = RECEIVER_BLOCK,
                         cell_rows: int = CELL_ROWS) -> DataFrame:
    """Missing targets become the mean target of the k nearest rows that have one; equal distances are
    told apart by the smaller target. A row sharing no feature with any donor gets the overall mean."""
    y = as_double(df, target)
    parts = [F.coalesce(as_double(df, f), F.lit(float("nan"))) for f in features]
    marked = df.withColumn("__vec", F.array(*parts)).withColumn("__y", y)
    lowest = W.partitionBy("__vec").orderBy("__y")
    donors = settle(marked.where("__y is not null").groupBy("__vec", "__y").agg(F.count("*").alias("n"))
                    .withColumn("__rn", F.row_number().over(lowest)).where(F.col("__rn") <= k).drop("__rn"))
    receivers = settle(marked.where("__y is null").groupBy("__vec").agg(F.count("*").alias("n")))
    nearest = settle(_nearest(donors, receivers, k, donor_block, receiver_block, cell_rows))
    answers = receivers.join(nearest, "__vec", "left")
    mean = df.agg(F.avg(y)).first()[0]
    filled = lookup(marked.where("__y is null"), "__vec", answers, ["__fill"])
    value = F.coalesce(F.col("__fill"), F.lit(mean))
    whole = marked.where("__y is not null").withColumn("__fill", F.col("__y")).unionByName(
        filled.withColumn("__fill", value))
    return whole.select(*[F.col("__fill").alias(target) if c == target else F.col(f"`{c}`") for c in df.columns])


def _distance():
    """The distance function; made here so that it travels to the executors with the tasks that call it."""

    def root_mean_square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # over the features both have; NaN where two vectors share none
        total = np.zeros((len(a), len(b)))
        shared = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            gap = a[:, j, None] - b[None, :, j]
            known = ~np.isnan(gap)
            total += np.where(known, gap * gap, 0.0)
            shared += known
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.sqrt(total / shared)

    return root_mean_square


def _pattern() -> Column:
    """A digit for each feature, 1 where the row has it; null with an infinite feature, which has no place among pivots."""
    finite = ~F.exists("__vec", lambda x: F.abs(x) == float("inf"))
    return F.when(finite, F.array_join(F.transform("__vec", lambda x: F.when(F.isnan(x), "0").otherwise("1")), ""))


def _shared(a: str, b: str) -> str:
    return "".join("1" if x == y == "1" else "0" for x, y in zip(a, b))


def _common_patterns(rows: DataFrame) -> dict[str, int]:
    counts = rows.groupBy(_pattern().alias("p")).agg(F.count("*").alias("n")).where("instr(p, '1') > 0")
    return {r["p"]: r["n"] for r in counts.orderBy(F.desc("n"), "p").limit(MAX_PATTERNS).collect()}


def _indexes(donors: DataFrame, have: dict[str, int], asked: dict[str, int], cell_rows: int) -> dict[tuple[str, str], np.ndarray]:
    """Pivots for (donor pattern, features compared), NaN where the projection has nothing; at least two pivots each."""
    weight: dict[tuple[str, str], int] = {}
    for p, n in have.items():
        for q, m in asked.items():
            if "1" in _shared(p, q):
                weight[p, _shared(p, q)] = weight.get((p, _shared(p, q)), 0) + n * m
    chosen = sorted((w for w in weight if have[w[0]] >= 2 * cell_rows), key=lambda w: (-weight[w], w))[:MAX_INDEXES]
    total = sum(have[p] for p, _ in chosen)
    room = {p: max(2, min(have[p] // cell_rows, MAX_PIVOTS * have[p] // max(total, 1))) for p, _ in chosen}
    if not room:
        return {}
    # about twice as many vectors as wanted, by the least hashes: found in the tasks, at most some thousands of them
    scale = 1 << 40
    part = F.create_map(*[F.lit(x) for p in room for x in (p, 2 * room[p] * scale // have[p] + 1)])
    place = F.pmod(F.xxhash64(F.lit(7), "__vec"), F.lit(scale))
    near_zero = donors.withColumn("p", _pattern()).withColumn("at", place).where(F.col("at") < F.try_element_at(part, F.col("p")))
    found: dict[str, list] = {p: [] for p in room}
    for r in near_zero.select("p", "at", "__vec").distinct().orderBy("at", "__vec").limit(4 * (MAX_PIVOTS + 2 * MAX_INDEXES)).collect():
        found[r["p"]].append(r["__vec"])
    out = {}
    for p, features in chosen:
        pivots = np.array(found[p][:room[p]], dtype=float)
        if len(pivots) > 1:
            pivots[:, [f == "0" for f in features]] = np.nan
            out[p, features] = pivots
    return out


def _visits(donors: DataFrame, receivers: DataFrame, k: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """(__vec, __y, n, cell) of donors, once for each index they are in, and (__vec, cell) of receivers."""
    distance, rest = _distance(), REST_CELL
    have, asked = _common_patterns(donors), _common_patterns(receivers)
    indexes = _indexes(donors, have, asked, cell_rows)
    pivots, first, of_pattern = [], {}, {}
    for (p, features), found in indexes.items():
        first[p, features] = len(pivots)
        of_pattern.setdefault(p, []).append(features)
        pivots += list(found)
    all_pivots = np.array(pivots)
    whole = {p: -2 - i for i, p in enumerate(have)}   # cells of all donors of a pattern

    @F.pandas_udf("array<struct<cell int, away double>>")
    def place(vectors: pd.Series, patterns: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        groups = patterns.fillna("").to_numpy()
        for p in set(groups):
            at = np.flatnonzero(groups == p)
            v = np.stack(vectors.to_numpy()[at]).astype(float)
            cells = [(np.full(len(at), whole.get(p, rest)), np.zeros(len(at)))]
            for features in of_pattern.get(p, []):
                start = first[p, features]
                d = distance(v, all_pivots[start:start + len(indexes[p, features])])
                best = d.argmin(axis=1)
                cells.append((best + start, d[np.arange(len(at)), best]))
            for j, i in enumerate(at):
                out[i] = [{"cell": int(c[j]), "away": float(a[j])} for c, a in cells]
        return pd.Series(out)

    placed = donors.withColumn("at", F.explode(place("__vec", _pattern()))).select("__vec", "__y", "n", "at.cell", "at.away")
    held = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("away").alias("radius")).collect()}
    # how far from its pivot a cell has k donors; the rank is cut to k before the shuffle
    ranked = placed.where("cell >= 0").withColumn("rn", F.row_number().over(W.partitionBy("cell").orderBy("away"))).where(F.col("rn") <= k)
    core = {r["cell"]: r["away"] for r in ranked.where(F.col("rn") == k).select("cell", "away").collect()}
    apart = {key: distance(found, found) for key, found in indexes.items()}   # of the pivots of an index

    @F.pandas_udf("array<int>")
    def visits(vectors: pd.Series, patterns: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        groups = patterns.fillna("").to_numpy()
        for q in set(groups):
            at = np.flatnonzero(groups == q)
            v = np.stack(vectors.to_numpy()[at]).astype(float)
            always, ids, used = ([rest] if rest in held else []), [], []
            for p, cell in whole.items():
                features = _shared(p, q) if q else ""
                if (p, features) in first:
                    start = first[p, features]
                    ids += range(start, start + len(indexes[p, features]))
                    used.append((p, features))
                elif "1" in features or not q:
                    always.append(cell)
            ids = np.array(ids, dtype=int)
            there = np.array([c in held for c in ids], dtype=bool)
            radius = np.array([held[c]["radius"] if c in held else 0.0 for c in ids])
            near_by = np.array([core.get(c, np.inf) for c in ids])
            rows_in = np.array([held[c]["rows"] if c in held else 0 for c in ids])
            d = distance(v, all_pivots[ids]) if len(ids) else np.zeros((len(v), 0))
            least = d * (1 - 1e-12) - radius   # less than rounding could have added, here and below
            at_index = 0
            for key in used:
                # a donor of cell c is nearer to pivot c than to the receiver's nearest pivot n: it lies beyond the plane between them
                part = slice(at_index, at_index + len(indexes[key]))
                away, gaps = d[:, part], apart[key]
                n = away.argmin(axis=1)
                nearest = away[np.arange(len(v)), n][:, None]
                with np.errstate(invalid="ignore", divide="ignore"):
                    plane = (away ** 2 * (1 - 1e-12) - nearest ** 2) / (2 * gaps[n])
                least[:, part] = np.fmax(least[:, part], np.where(gaps[n] > 0, plane, -np.inf))
                at_index = part.stop
            for j, i in enumerate(at):
                keep = ids
                if len(ids):
                    far = d[j] + radius
                    order = np.argsort(far)
                    enough = np.searchsorted(np.cumsum(rows_in[order]), k)
                    limit = min(far[order[enough]] if enough < len(order) else np.inf, (d[j] + near_by).min())
                    keep = ids[there & (least[j] <= limit * (1 + 1e-9) + 1e-9)]
                out[i] = [*map(int, keep), *always]
        return pd.Series(out)

    return placed, receivers.select("__vec", F.explode(visits("__vec", _pattern())).alias("cell"))


def _nearest(donors: DataFrame, receivers: DataFrame, k: int, donor_block: int, receiver_block: int, cell_rows: int) -> DataFrame:
    """Rows (__vec, __fill) for every receiver that shares a feature with a donor."""
    spark, distance = donors.sparkSession, _distance()
    if donors.isEmpty():
        return spark.createDataFrame([], "__vec array<double>, __fill double")
    placed, calls = _visits(donors, receivers, k, cell_rows)
    calls = settle(calls)
    load = calls.groupBy("cell").agg(F.count("*").alias("calls"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows")).join(load, "cell")   # cells that no receiver visits go
    plan = [(r["cell"], max(1, -(-r["rows"] // donor_block)), max(1, -(-r["calls"] // receiver_block))) for r in sizes.collect()]
    if not plan:
        return spark.createDataFrame([], "__vec array<double>, __fill double")
    grid = F.broadcast(spark.createDataFrame(plan, "cell int, d_blocks int, r_blocks int"))   # a row per cell
    pick = F.xxhash64("__vec", "__y")
    left = placed.join(grid, "cell").select(
        "__vec", "__y", "n", "cell", F.pmod(pick, F.col("d_blocks")).cast("int").alias("d"),
        F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)).alias("r"))
    right = calls.join(grid, "cell").select(
        F.col("__vec").alias("query"), F.col("cell").alias("q_cell"),
        F.explode(F.sequence(F.lit(0), F.col("d_blocks") - 1)).alias("q_d"),
        F.pmod(F.xxhash64("__vec"), F.col("r_blocks")).cast("int").alias("q_r"))

    def compare(donor: pd.DataFrame, receiver: pd.DataFrame) -> pd.DataFrame:
        out = {"__vec": [], "away": [], "__y": [], "n": []}
        if len(donor) and len(receiver):
            donor = donor.sort_values("__y", kind="stable")
            dv, dy, dn = np.stack(donor["__vec"].to_numpy()), donor["__y"].to_numpy(), donor["n"].to_numpy()
            rv = np.stack(receiver["query"].to_numpy())
            step = max(1, 4_000_000 // len(dv))
            for start in range(0, len(rv), step):
                d = distance(rv[start:start + step], dv)
                for i, line in enumerate(d):
                    line = np.where(np.isnan(line), np.inf, line)
                    edge = np.partition(line, min(k, len(line)) - 1)[min(k, len(line)) - 1]
                    near = np.flatnonzero((line <= edge) & np.isfinite(line))
                    near = near[np.argsort(line[near], kind="stable")][:k]
                    out["__vec"] += [rv[start + i].tolist()] * len(near)
                    out["away"] += line[near].tolist()
                    out["__y"] += dy[near].tolist()
                    out["n"] += dn[near].tolist()
        return pd.DataFrame({c: pd.Series(v, dtype="object" if c == "__vec" else None) for c, v in out.items()})

    near = left.groupBy("cell", "d", "r").cogroup(right.groupBy("q_cell", "q_d", "q_r")).applyInPandas(
        compare, "__vec array<double>, away double, __y double, n bigint")
    # Arrow hands NaN inside arrays back as null.
    near = near.withColumn("__vec", F.transform("__vec", lambda x: F.coalesce(x, F.lit(float("nan")))))
    order = W.partitionBy("__vec").orderBy("away", "__y")
    ranked = near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = ranked.withColumn("take", F.least(F.col("n"), F.lit(k) - before)).where("take > 0")
    return taken.groupBy("__vec").agg((F.sum(F.col("__y") * F.col("take")) / F.sum("take")).alias("__fill"))
