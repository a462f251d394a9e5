"""Hard negatives against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score int"


def usable(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def plain(rows, n=5):
    kept = []
    for vec_id, e, label in rows:
        if label is not None and usable(e):
            if vec_id is not None and vec_id % 7 == 0:
                label = (label + 1) % 10
            kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in e], label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    place = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        others = [(j, score(v, w), other == label) for m, (j, w, other) in enumerate(kept) if m != k]
        for j, s, _ in sorted([o for o in others if o[2]], key=place)[:n]:
            inside = [o for o in others if not o[2] and 80 * s <= 100 * o[1] <= 100 * s]
            out += [(i, j, rank, o[0], s, o[1]) for rank, o in enumerate(sorted(inside, key=place)[:n], 1)]
    return sorted(out, key=str)


def mined(spark, rows):
    return sorted([tuple(r) for r in negatives.mine(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()], key=str)


def vectors(n, width=12, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(10, width))
    return [(k, (0.4 * centres[k % 4] + draw.normal(size=width) * 0.3).tolist(), int(k % 4 if k % 5 else draw.integers(0, 10))) for k in range(n)]


@pytest.mark.parametrize("shelf", [64, 65_536])
def test_against_all_pairs(spark, monkeypatch, shelf):
    monkeypatch.setattr(negatives, "SHELF", shelf)
    monkeypatch.setattr(negatives, "LEAST_SHELF", shelf)
    rows = vectors(900)
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 100


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, [1.0, 0.5], None), (200, None, 1), (300, [1.0, None], 1), (400, [nan, 1.0], 1), (500, [inf, 1.0], 1), (600, [], 1), (None, [0.5, 0.5], 1), (None, [0.5, 0.5], 2),
           (700, [0.0, 0.0], 3), (800, [1.0], 1), (900, [1.0, 0.25, 4.0], 2), (1000, [-1.0, -1.0], 2), (1001, [1.0, 1.0], 3), (1100, [1.0, 0.5], 9), (7, [1.0, 0.5], 9)]
    rows = odd + [(1200, [1.0, 0.5], 4)] * 3 + [(k, [1.0, 0.5], 4 + k % 2) for k in range(1300, 1340)] + [(1400, [3e4, 4e4], 5), (1401, [3e4, 4e4], 6)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == [] and mined(spark, odd[:5]) == []


def test_large_integers_are_exact(spark):
    rows = [(k, [float(2 ** 20 + k), 1.0, -float(2 ** 19)], k % 2) for k in range(100, 160)]
    assert mined(spark, rows) == plain(rows)


def test_bounds_hold():
    draw = np.random.default_rng(3)
    x = draw.integers(-300, 300, (400, 8))
    centres = np.linalg.qr(draw.normal(size=(8, 5)))[0].T
    norm = np.linalg.norm(x, axis=1)
    cosine = np.clip(x / norm[:, None] @ centres.T, -1, 1)
    shelf = negatives.Shelf(*zip(*[(k, k, 0, x[k].tobytes(), norm[k], np.arccos(cosine[k]).tobytes(), int(cosine[k].argmax())) for k in range(400)]))
    for k in range(0, 400, 7):
        angles, true = np.arccos(cosine[k]), shelf.x @ x[k]
        low, high = shelf.bounds(np.arange(400), angles, norm[k])
        assert (low <= true).all() and (true <= high).all()
        for least in (1, 5_000, int(true.max())):
            assert set(np.flatnonzero(true >= least)) <= set(shelf.windows(angles, norm[k], least).tolist())
