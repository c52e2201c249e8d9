"""Rank correlations of many replicates without sorting them: ranks follow from how often each value is drawn.

Values are sorted once; a replicate is a count for each item (draws, or membership of a half), its ranks are cumulated
counts.  Twice the centred ranks are whole numbers, so what has no variance gives exactly 0.
"""

from __future__ import annotations

import numpy as np

#: Numbers of a block of replicates that are worked on together; replicates of more items than FEW are worked on one by one.
BLOCK = 1 << 18
FEW = 4096


class Values:
    """Sorted distinct values of an array, nan last, and the place of each item among them."""

    def __init__(self, x: np.ndarray):
        x = np.asarray(x, float)
        self.order = np.argsort(x, kind="stable")
        s = x[self.order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
        self.starts = np.flatnonzero(new)
        self.place = np.empty(len(s), np.int64)
        self.place[self.order] = np.cumsum(new) - 1
        self.tied = len(self.starts) < len(s)

    def centred(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice the centred average rank of each item in each row of counts, and the sum of their squares over what was drawn."""
        drawn = np.take(counts, self.order, axis=-1)
        if self.tied:
            drawn = np.add.reduceat(drawn, self.starts, axis=-1)
        twice, squares = from_counts(drawn)
        return np.take(twice, self.place, axis=-1), squares


def from_counts(drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the centred average rank of each value, from the counts of values in order, and the sum of squares."""
    up = np.cumsum(drawn, axis=-1)
    twice = 2.0 * up
    twice -= drawn
    twice -= up[..., -1:]
    return twice, products(drawn, twice, twice)


def products(counts: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sums of count times one times two along the last axis."""
    return np.dot(counts * one, two) if counts.ndim == 1 else np.einsum("ij,ij,ij->i", counts, one, two)


def correlation(product: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((one > 0) & (two > 0), product / (np.sqrt(one) * np.sqrt(two)), np.nan)


def drawn(picks: np.ndarray, n: int) -> np.ndarray:
    """How often each of n items is picked, in each row."""
    if picks.ndim == 1:
        return np.bincount(picks, minlength=n)
    rows = len(picks)
    return np.bincount((picks + n * np.arange(rows)[:, None]).ravel(), minlength=rows * n).reshape(rows, n)


def spearman(x: Values, y: Values, counts: np.ndarray) -> np.ndarray:
    """Rank correlation of x and y in each row of counts."""
    (a, va), (b, vb) = x.centred(counts), y.centred(counts)
    return correlation(products(counts, a, b), va, vb)


def members(values: Values, at: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Twice the centred ranks of the items at the places `at` among themselves, and the sum of squares."""
    own, k = (values.place if place is None else place)[at], len(at)
    if not values.tied:
        held = np.zeros(len(values.starts), np.uint8)
        held[own] = 1
        return np.cumsum(held, dtype=np.int32)[own] * 2.0 - (k + 1), k * (k * k - 1) / 3
    twice, squares = from_counts(np.bincount(own, minlength=len(values.starts)))
    return twice[own], float(squares)


def halves(x: Values, y: Values, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank correlations inside the first and the second half of each row of orders, an odd last item left out."""
    rows, n = orders.shape
    k, out = n // 2, []
    for a in (0, k):
        own = orders[:, a : a + k]
        if n <= FEW:
            counts = np.zeros((rows, n), np.int64)
            np.put_along_axis(counts, own, 1, axis=1)
            out.append(spearman(x, y, counts))
        else:
            got = [(members(x, at), members(y, at)) for at in own]
            out.append(correlation(np.array([tx @ ty for (tx, _), (ty, _) in got]), np.array([v for (_, v), _ in got]), np.array([v for _, (_, v) in got])))
    return out[0], out[1]


def greater_before(keys: np.ndarray) -> np.ndarray:
    """For each element of a permutation of 0..n-1, the number of greater ones before it: bit by bit, n log n in all."""
    n = len(keys)
    arr, owner, out = keys.astype(np.int64), np.arange(n), np.zeros(n, np.int64)
    for bit in range(max(0, n - 1).bit_length() - 1, -1, -1):
        one = (arr >> bit) & 1
        start = (arr >> (bit + 1)) << (bit + 1)  # a group shares its higher bits and stands where its least key belongs
        ahead = np.cumsum(one) - one
        ahead -= ahead[start]
        low = one == 0
        out[owner[low]] += ahead[low]
        to = np.where(low, np.arange(n) - ahead, start + (1 << bit) + ahead)
        moved, owned = np.empty_like(arr), np.empty_like(owner)
        moved[to], owned[to] = arr, owner
        arr, owner = moved, owned
    return out


def _dominated(x: np.ndarray, y: np.ndarray, x_equal: bool, y_equal: bool) -> np.ndarray:
    """For each item, how many items have greater x and greater y, places among distinct values; equal ones count where told (itself too)."""
    n = len(x)
    # unique keys of y: of equal y, that of greater x is greater if equal ones count, else smaller; equal points follow x_equal
    both = x_equal and y_equal
    key = np.empty(n, np.int64)
    key[np.lexsort((np.arange(n), x if y_equal else -x, y))] = np.arange(n)
    # from great to small x; of equal x, a greater y comes before if equal ones count, else after
    order = np.lexsort((-key if x_equal else key, -x))
    out = np.empty(n, np.int64)
    out[order] = greater_before(key[order])
    if both or (x_equal != y_equal):
        # equal points: they count in full where both sides take equals, not at all elsewhere; the keys above count some of them
        pair = x * (int(y.max()) + 1 if n else 1) + y
        _, back, size = np.unique(pair, return_inverse=True, return_counts=True)
        seen = np.zeros(n, np.int64)
        by = np.lexsort((-key if x_equal else key, pair))
        first = np.concatenate([[True], pair[by][1:] != pair[by][:-1]]) if n else np.zeros(0, bool)
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        seen[by] = place if x_equal else 0  # equal points that come earlier have greater keys only if x_equal put them so
        out += (size[back] if both else 0) - seen
    return out


def leave_one_out(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank correlation of the others for each item, in n log n: leaving one out lowers the ranks above by one and those of its equals by a half."""
    n = len(x)
    if n < 2:
        return np.full(n, np.nan)
    xs, ys = Values(x), Values(y)
    sides = []
    for v in (xs, ys):
        size = np.bincount(v.place)
        up = np.cumsum(size)
        sides.append((size[v.place], n - up[v.place], (2 * up - size + 1)[v.place]))
    (ex, gx, a), (ey, gy, b) = sides

    def lowered(v: Values, equal: np.ndarray, what: np.ndarray) -> np.ndarray:
        """Sum over the others of `what` times the lowering of its doubled rank: 2 above, 1 for an equal."""
        sums = np.add.reduceat(what[v.order], v.starts)
        above = sums.sum() - np.cumsum(sums)
        return 2 * above[v.place] + sums[v.place] - what

    if xs.tied or ys.tied:
        both = sum(_dominated(xs.place, ys.place, p, q) for p in (False, True) for q in (False, True)) - 1
    else:
        both = 4 * _dominated(xs.place, ys.place, False, False)
    m, half = n - 1, n * (n - 1)  # the doubled ranks of the others add up to n (n - 1)
    if n > 1 << 20:
        a, b = a.astype(float), b.astype(float)
    qx = (a * a).sum() - a * a - 2 * lowered(xs, ex, a) + 4 * gx + ex - 1
    qy = (b * b).sum() - b * b - 2 * lowered(ys, ey, b) + 4 * gy + ey - 1
    p = (a * b).sum() - a * b - lowered(xs, ex, b) - lowered(ys, ey, a) + both
    less = half * n  # square of the sum over m
    return correlation((p - less).astype(float), (qx - less).astype(float), (qy - less).astype(float)) if m >= 3 else np.full(n, np.nan)
