"""Distribution functions of test statistics, on plain numbers; a row is a cell, so calls are few."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution: a series below the mean, a continued fraction above it."""
    if not (x == x and df > 0):
        return math.nan
    a, z = df / 2, max(x, 0.0) / 2
    if z == 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= z / k
            total += term
        return 1 - front * total
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 10_000):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / d
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Probability of a t at least this far from 0."""
    return math.nan if not (t == t and df > 0) else beta_share(df / 2, 0.5, df / (df + t * t))


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of U.  Exact where no value is tied and a group has at most 8, else normal with corrections for ties (sum of t**3 - t) and continuity."""
    if min(n1, n2) < 1 or u != u:
        return math.nan
    top = max(u, n1 * n2 - u)
    if not ties and min(n1, n2) <= 8:
        ways = rank_sum_ways(n1, n2)
        return min(1.0, 2 * sum(ways[int(top) :]) / sum(ways))
    n = n1 + n2
    spread = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    return math.nan if not spread else min(1.0, 2 * normal_sf((top - n1 * n2 / 2 - 0.5) / spread))


def rank_sum_ways(n1: int, n2: int) -> list[int]:
    """Number of arrangements of two groups for each value of U."""
    ways = [[0] * (n1 * n2 + 1) for _ in range(min(n1, n2) + 1)]
    few, many = sorted((n1, n2))
    ways[0][0] = 1
    for rank in range(few + many):
        for taken in range(min(few, rank + 1), 0, -1):
            # the taken-th member at this place has rank - taken + 1 of the others below it
            below = rank - taken + 1
            if below <= many:
                for u in range(n1 * n2, below - 1, -1):
                    ways[taken][u] += ways[taken - 1][u - below]
    return ways[few]


def bca(observed: float, boots: np.ndarray, jack: np.ndarray, alpha: float = 0.05, least: int = 20) -> tuple[float, float]:
    """Bias-corrected and accelerated interval; nan for too few finite replicates."""
    boots, jack = (np.asarray(v, float) for v in (boots, jack))
    boots, jack = boots[np.isfinite(boots)], jack[np.isfinite(jack)]
    if not math.isfinite(observed) or len(boots) < least:
        return math.nan, math.nan
    edge = 1 / (len(boots) + 1)
    z0 = NORMAL.inv_cdf(min(max(float((boots < observed).mean() + (boots == observed).mean() / 2), edge), 1 - edge))
    off = jack.mean() - jack if len(jack) >= 3 else np.zeros(1)
    size = float((off**2).sum())
    speed = min(0.99, max(-0.99, float((off**3).sum()) / (6 * size**1.5))) if size > 0 else 0.0

    def place(p: float) -> float:
        z = z0 + NORMAL.inv_cdf(p)
        low = 1 - speed * z
        return p if abs(low) < 1e-12 else NORMAL.cdf(z0 + z / low)

    return tuple(float(np.quantile(boots, place(p))) for p in (alpha / 2, 1 - alpha / 2))
