"""Exact order statistics and quantiles that never hold a column in one task.

Spark's `percentile` and `median` keep every distinct value of a column in one aggregation buffer.
Here each wanted rank is closed in by scans instead: an approximate sketch (bounded size) gives two
values around the rank, a count says exactly how many rows lie below, on and between them, and the
search goes on between them until few enough rows are left to sort. Each round shrinks the interval
by a factor of over a thousand, so 10^12 rows take three or four scans, none of which shuffles rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000      # of the sketch: rank error at most rows / ACCURACY
SORT_LIMIT = 20_000    # rows of an interval that are sorted in one aggregation buffer
BUFFERED = 1_000_000   # rows of all intervals sorted by one job
COLUMNS = 100          # columns whose sketches one job holds


@dataclass
class _Interval:
    """Wanted ranks of one column whose values lie strictly between `low` and `high`."""

    column: str
    ranks: list[int]
    below: int                 # rows at or under `low`
    inside: int                # rows strictly between
    low: object = None
    high: object = None

    def values(self, c: Column) -> Column:
        keep = c.isNotNull()
        if self.low is not None:
            keep = keep & (c > F.lit(self.low))
        if self.high is not None:
            keep = keep & (c < F.lit(self.high))
        return F.when(keep, c)


def _clusters(ranks: list[int]) -> list[list[int]]:
    """Neighbouring ranks are searched for together."""
    out: list[list[int]] = []
    for r in sorted(set(ranks)):
        if out and r - out[-1][-1] <= 1:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def _brackets(df: DataFrame, columns: dict[str, Column], wide: list[_Interval]) -> list[tuple]:
    """(interval, ranks, a, b): values a <= b that a sketch puts around each cluster of ranks. One sketch
    serves all clusters of an interval.

    The sketch works on doubles. Whole numbers in a narrow interval are counted from its lower end, which
    is exact; in a wide one the bracket is widened by what a double may be off, so it always closes in.
    """
    slack = 2.0 / ACCURACY
    sketches, slots = [], []
    for i, t in enumerate(wide):
        probs = []
        for ranks in _clusters(t.ranks):
            slots.append((i, len(probs), ranks))
            probs += [max(0.0, (ranks[0] - t.below) / t.inside - slack),
                      min(1.0, (ranks[-1] - t.below + 1) / t.inside + slack)]
        v = t.values(columns[t.column])
        sketches.append(F.percentile_approx(v - F.lit(t.low) if _narrow(t) else v, probs, ACCURACY).alias(f"s{i}"))
    row = df.agg(*sketches).first()
    out = []
    for i, at, ranks in slots:
        t, (a, b) = wide[i], row[f"s{i}"][at:at + 2]
        if _narrow(t):
            a, b = a + t.low, b + t.low
        elif isinstance(a, int):
            a, b = a - int(2 * math.ulp(float(a))), b + int(2 * math.ulp(float(b)))
            a, b = max(a, -2**63), min(b, 2**63 - 1)
        out.append((t, ranks, a, b))
    return out


def _narrow(t: _Interval) -> bool:
    return isinstance(t.low, int) and isinstance(t.high, int) and t.high - t.low < 2**53


def order_statistics(df: DataFrame, columns: dict[str, Column], ranks: dict[str, list[int]],
                     counts: dict[str, int], sort_limit: int = SORT_LIMIT) -> dict[str, dict[int, object]]:
    """Values at 0-based ranks among the non-null values of each column expression.

    `counts` gives the number of non-null values. Columns must hold no NaN. COLUMNS columns share their scans; more take
    more scans, so that buffers do not grow with the number of columns.
    """
    if len(ranks) > COLUMNS:
        names = list(ranks)
        return {name: found for k in range(0, len(names), COLUMNS) for name, found in order_statistics(
            df, columns, {n: ranks[n] for n in names[k:k + COLUMNS]}, counts, sort_limit).items()}
    found: dict[str, dict[int, object]] = {name: {} for name in ranks}
    todo = [_Interval(name, sorted(set(rs)), 0, counts[name]) for name, rs in ranks.items() if rs]

    while any(t.inside > sort_limit for t in todo):
        wide, todo = ([t for t in todo if t.inside > sort_limit],
                      [t for t in todo if t.inside <= sort_limit])
        brackets = _brackets(df, columns, wide)
        exprs = []
        for i, (t, _, a, b) in enumerate(brackets):
            c = columns[t.column]
            exprs += [F.count_if(c < F.lit(a)).alias(f"la{i}"), F.count_if(c == F.lit(a)).alias(f"ea{i}"),
                      F.count_if(c < F.lit(b)).alias(f"lb{i}"), F.count_if(c == F.lit(b)).alias(f"eb{i}")]
        row = df.agg(*exprs).first()
        for i, (t, ranks, a, b) in enumerate(brackets):
            from_a, from_b = row[f"la{i}"], row[f"lb{i}"]
            past_a, past_b = from_a + row[f"ea{i}"], from_b + row[f"eb{i}"]
            under, between, over = [], [], []
            for r in ranks:
                if r < from_a:
                    under.append(r)
                elif r < past_a:
                    found[t.column][r] = a
                elif r < from_b:
                    between.append(r)
                elif r < past_b:
                    found[t.column][r] = b
                else:
                    over.append(r)
            if under:
                todo.append(_Interval(t.column, under, t.below, from_a - t.below, t.low, a))
            if between:
                todo.append(_Interval(t.column, between, past_a, from_b - past_a, a, b))
            if over:
                todo.append(_Interval(t.column, over, past_b, t.below + t.inside - past_b, b, t.high))

    while todo:
        # at least one interval a job, and no more than BUFFERED rows in the buffers of all
        size, now = 0, []
        while todo and (not now or size + todo[0].inside <= BUFFERED):
            size += todo[0].inside
            now.append(todo.pop(0))
        picks, names = [], []
        for t in now:
            ordered = F.sort_array(F.collect_list(t.values(columns[t.column])))
            for r in t.ranks:
                picks.append(F.get(ordered, F.lit(r - t.below)).alias(f"p{len(picks)}"))
                names.append((t.column, r))
        row = df.agg(*picks).first()
        for i, (name, r) in enumerate(names):
            found[name][r] = row[i]
    return found


def _position(p: float, n: int) -> tuple[int, int, float]:
    at = p * (n - 1)
    low = int(at)
    return low, min(low + 1, n - 1), at - low


def quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float],
              counts: dict[str, int] | None = None,
              sort_limit: int = SORT_LIMIT) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column expression; None for a column with no values."""
    if not columns:
        return {}
    if counts is None:
        names = list(columns)
        row = df.agg(*[F.count(columns[n]).alias(f"c{i}") for i, n in enumerate(names)]).first()
        counts = {n: row[i] for i, n in enumerate(names)}
    ranks = {}
    for name in columns:
        n = counts[name]
        ranks[name] = sorted({r for p in probs for r in _position(p, n)[:2]}) if n else []
    stats = order_statistics(df, columns, ranks, counts, sort_limit)
    out: dict[str, list[float | None]] = {}
    for name in columns:
        n = counts[name]
        if not n:
            out[name] = [None] * len(probs)
            continue
        values = []
        for p in probs:
            low, high, part = _position(p, n)
            a, b = float(stats[name][low]), float(stats[name][high])
            values.append(a + (b - a) * part)
        out[name] = values
    return out
