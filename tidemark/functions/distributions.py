"""Tail probabilities for one test statistic at a time; they run on the driver on a handful of numbers."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction for the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_regularized(dof / 2, 0.5, dof / (dof + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    return beta_regularized(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, dof: float) -> float:
    """Upper tail by the series below the mean and the continued fraction above it."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


#: Up to so many values the Kolmogorov tail is exact; beyond, the corrected limit is used (its error is under 3e-7 there).
EXACT_KOLMOGOROV = 5_000


def kolmogorov_upper(d: float, n: int) -> float:
    """Chance that the empirical distribution of n values strays by at least `d` from its continuous distribution.

    Exact up to `EXACT_KOLMOGOROV` values. Beyond, the limit law at a shifted point, which leaves an error of order n^-1.5."""
    if n * d <= 0.5:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d > 18:
        return min(1.0, 2 * math.exp(-2 * n * d * d))   # below 5e-16, where the cumulative form has no digits left
    if n <= EXACT_KOLMOGOROV:
        return min(1.0, max(0.0, 1.0 - _kolmogorov_exact(d, n)))
    return min(1.0, max(0.0, 1.0 - _kolmogorov_series(math.sqrt(n) * d, n)))


def _kolmogorov_series(x: float, n: int) -> float:
    """P(D < x / sqrt(n)): the limit law and its terms of order n^-1/2 and n^-1 (Pelz and Good 1976)."""
    odd = [((math.pi * (2 * k - 1) / 2) ** 2, math.exp(-(math.pi * (2 * k - 1) / x) ** 2 / 8)) for k in range(1, 30)]
    even = [((math.pi * k) ** 2, math.exp(-(math.pi * k / x) ** 2 / 2)) for k in range(1, 30)]
    scale = math.sqrt(2 * math.pi)
    limit = scale / x * sum(w for _, w in odd)
    first = scale / (6 * x ** 4) * sum((a - x * x) * w for a, w in odd)
    second = scale / (72 * x ** 7) * sum((6 * x ** 6 + 2 * x ** 4 + a * (2 * x ** 4 - 5 * x * x) + a * a * (1 - 2 * x * x)) * w
                                         for a, w in odd) - scale / (36 * x ** 3) * sum(a * w for a, w in even)
    return limit + first / math.sqrt(n) + second / n


def _kolmogorov_exact(d: float, n: int) -> float:
    """P(D < d) as an entry of the n-th power of a band matrix (Marsaglia, Tsang and Wang 2003). The matrix has 2k - 1 rows for
    k - 1 < n d <= k; powers are scaled by powers of two so that they neither overflow nor vanish."""
    k = math.floor(n * d) + 1
    size, h = 2 * k - 1, math.floor(n * d) + 1 - n * d
    steps = np.arange(size)[:, None] - np.arange(size)[None, :] + 1
    inverse = np.exp(-np.array([math.lgamma(i + 1) for i in range(size + 1)]))   # 1 / i!
    matrix = np.where(steps >= 0, inverse[np.maximum(steps, 0)], 0.0)
    edge = h ** np.arange(1, size + 1) * inverse[1:]
    matrix[:, 0] -= edge
    matrix[-1, :] -= edge[::-1]
    if h > 0.5:
        matrix[-1, 0] += (2 * h - 1) ** size * inverse[size]
    power, shift, base, base_shift, left = np.eye(size), 0, matrix, 0, n
    while left:
        if left & 1:
            power, shift = power @ base, shift + base_shift
            power, shift = _scaled(power, shift)
        base, base_shift = _scaled(base @ base, 2 * base_shift)
        left >>= 1
    entry = power[k - 1, k - 1]
    if entry <= 0:
        return 0.0
    return min(1.0, math.exp(math.log(entry) + shift * math.log(2) + math.lgamma(n + 1) - n * math.log(n)))


def _scaled(matrix: np.ndarray, shift: int) -> tuple[np.ndarray, int]:
    by = math.frexp(float(np.abs(matrix).max()))[1]
    return np.ldexp(matrix, -by), shift + by


def rank_sum_upper(n1: int, n2: int, u: int) -> float:
    """Chance of a U of at least `u` for two samples without ties; exact, for any size of the larger sample.

    Ways to get a U are partitions into at most `small` parts of at most `large`. Those of U up to t have the generating function
    prod (1 - q^(large + i)) / ((1 - q) prod (1 - q^i)), i up to `small`. The product above the line has 2^small terms (fewer
    once equal powers meet); what is below counts partitions into parts of a few sizes, a polynomial in t for each remainder of t
    by the parts' least common multiple. So the work does not depend on `large` or `u`."""
    small, large = sorted((n1, n2))
    upto = n1 * n2 - u   # as many ways above u as below n1 n2 - u
    if upto < 0:
        return 0.0
    above = {0: 1}
    for i in range(1, small + 1):
        for power, times in list(above.items()):
            above[power + large + i] = above.get(power + large + i, 0) - times
    cycle = math.lcm(*range(1, small + 1))
    parts = [1, *range(1, small + 1)]
    first = [1]   # prod (1 - q^cycle) / (1 - q^part) = prod (1 + q^part + q^2part + ...), a polynomial
    for part in parts:
        sums = [0] * (len(first) + cycle - part)
        for at in range(len(sums)):
            sums[at] = (first[at] if at < len(first) else 0) + (sums[at - part] if at >= part else 0) \
                - (first[at - cycle] if cycle <= at < len(first) + cycle else 0)
        first = sums

    def ways(t: int) -> int:
        return sum(first[at] * math.comb((t - at) // cycle + small, small) for at in range(t % cycle, min(t, len(first) - 1) + 1, cycle))

    return sum(times * ways(upto - power) for power, times in above.items() if power <= upto) / math.comb(n1 + n2, n1)
