"""Rank statistics of many replicates at once, on the arrays of one cell.

A cell holds one number a participant, so its arrays are bounded by the cohort.  Replicates are drawn in blocks, so memory
does not grow with their number; seeds are those of the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tandemetry.functions import counted, special
from tandemetry.functions.counted import BLOCK

CLIP = 0.999999


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis; nan stays nan and counts for nobody."""
    x = np.asarray(x, float)
    order = np.argsort(x, axis=-1, kind="stable")
    s = np.take_along_axis(x, order, -1)
    n = x.shape[-1]
    new = np.ones(s.shape, bool)
    new[..., 1:] = s[..., 1:] != s[..., :-1]
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(new, place, 0), axis=-1)
    end = np.concatenate([new[..., 1:], np.ones((*new.shape[:-1], 1), bool)], axis=-1)
    last = np.minimum.accumulate(np.where(end, place, n)[..., ::-1], axis=-1)[..., ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, -1)
    out[np.isnan(x)] = np.nan
    return out


def pearson(a: np.ndarray, b: np.ndarray, least: int = 3) -> np.ndarray:
    """Correlations along the last axis; nan without variance or with fewer than `least` numbers."""
    a, b = a - a.mean(-1, keepdims=True), b - b.mean(-1, keepdims=True)
    size = np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((size > 0) & (a.shape[-1] >= least), (a * b).sum(-1) / size, np.nan)


def spearman(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of complete rows."""
    return pearson(ranks(x), ranks(y))


def spearman_masked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's complete pairs, and their number."""
    ok = np.isfinite(x) & np.isfinite(y)
    n = ok.sum(-1)
    rx, ry = ranks(np.where(ok, x, np.nan)), ranks(np.where(ok, y, np.nan))
    some = np.maximum(n, 1)[..., None]
    a = np.where(ok, rx - np.nansum(rx, -1, keepdims=True) / some, 0.0)
    b = np.where(ok, ry - np.nansum(ry, -1, keepdims=True) / some, 0.0)
    size = np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((size > 0) & (n >= 3), (a * b).sum(-1) / size, np.nan), n


def fisher(r: np.ndarray) -> np.ndarray:
    return np.arctanh(np.clip(r, -CLIP, CLIP))


def draws(rng: np.random.Generator, n: int, times: int, part: tuple[int, int] | None = None) -> Iterator[np.ndarray]:
    """Bootstrap indices, in blocks of rows.  Of a part of the replicates, these are the ones that all of them would have there."""
    step = max(1, BLOCK // max(n, 1))
    first, end = part or (0, times)
    for a in range(0, first, step):
        rng.integers(0, n, size=(min(step, first - a), n))
    for a in range(first, min(end, times), step):
        yield rng.integers(0, n, size=(min(step, min(end, times) - a), n))


def one_by_one(blocks: Iterator[np.ndarray], n: int) -> Iterator[np.ndarray]:
    """Blocks as they are, or, of many items, their rows: arrays of one row stay in the cache."""
    for block in blocks:
        if n > counted.FEW:
            yield from block
        else:
            yield block


def shuffles(rng: np.random.Generator, n: int, times: int) -> Iterator[np.ndarray]:
    """Permutations, in blocks of rows."""
    step = max(1, BLOCK // max(n, 1))
    for a in range(0, times, step):
        yield np.stack([rng.permutation(n) for _ in range(min(step, times - a))])


def together(blocks: Iterator[np.ndarray]) -> np.ndarray:
    parts = list(blocks)
    return np.concatenate(parts, axis=-1) if parts else np.zeros(0)


def half_stability(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int = 200, least: float = 0.20, positive: bool = False) -> float:
    """Share of random splits into two disjoint halves whose correlations both reach `least` with one sign; nan for halves of fewer than 5."""
    n, k = len(x), len(x) // 2
    if k < 5:
        return float("nan")
    hits, xs, ys = 0, counted.Values(x), counted.Values(y)
    for order in shuffles(rng, n, times):
        one, two = counted.halves(xs, ys, order)
        low, high = np.fmin(one, two), np.fmax(one, two)
        known = np.isfinite(one) & np.isfinite(two)
        hits += int((known & ((low >= least) | ((high <= -least) & (not positive)))).sum())
    return hits / times


def permutation_p(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int = 1000, side: str = "two") -> dict[str, float]:
    """Observed correlation, its permutation p (`two`, `right` or `left`), and the null's median and 95 % point."""
    rho = float(spearman(x, y))
    rx, ry = ranks(x), ranks(y)
    null = together(pearson(np.broadcast_to(rx, o.shape), ry[o]) for o in shuffles(rng, len(x), times))
    null = null[np.isfinite(null)]
    far = {"two": lambda: np.abs(null) >= abs(rho), "right": lambda: null >= rho, "left": lambda: null <= rho}[side]
    p = (1 + int(far().sum())) / (1 + len(null)) if np.isfinite(rho) and len(null) else float("nan")
    return {"rho": rho, "p": p, "null_med": float(np.median(null)) if len(null) else float("nan"), "null_p95": float(np.percentile(null, 95)) if len(null) else float("nan")}


def interval(v: np.ndarray, least: int = 20) -> tuple[float, float]:
    """2.5 % and 97.5 % points of the finite replicates."""
    v = v[np.isfinite(v)]
    return tuple(map(float, np.quantile(v, [0.025, 0.975]))) if len(v) >= least else (float("nan"), float("nan"))


def excludes_zero(lo: float, hi: float) -> bool:
    return bool(hi < 0 or lo > 0)


def covers_zero(lo: float, hi: float) -> bool:
    return bool(lo <= 0 <= hi)


def williams(ra: float, rb: float, rab: float, n: int) -> dict[str, float]:
    """Williams's t of two dependent correlations with one variable, and its two-sided p on n - 3 degrees."""
    out = {"t": float("nan"), "p": float("nan")}
    if n < 5 or not np.isfinite([ra, rb, rab]).all():
        return out
    det = 1 - ra * ra - rb * rb - rab * rab + 2 * ra * rb * rab
    size = 2 * (n - 1) / (n - 3) * det + ((ra + rb) / 2) ** 2 * (1 - rab) ** 3
    if size <= 0 or 1 + rab < 0:
        return out
    t = (ra - rb) * np.sqrt((n - 1) * (1 + rab) / size)
    return {"t": float(t), "p": min(1.0, special.t_two_sided(abs(t), n - 3))}


def left_out(f, *columns: np.ndarray) -> np.ndarray:
    """f of the columns without each row in turn."""
    n = len(columns[0])
    keep = ~np.eye(n, dtype=bool)
    return f(*(np.broadcast_to(c, (n, n))[keep].reshape(n, n - 1) for c in columns))


def pair_contrast(xa: np.ndarray, xb: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int = 4999, least: int = 8) -> dict[str, float]:
    """Difference of two dependent correlations: raw and by Fisher's z, with intervals, a shifted-bootstrap p and Williams's test."""
    ok = np.isfinite(xa) & np.isfinite(xb) & np.isfinite(y)
    xa, xb, y = xa[ok], xb[ok], y[ok]
    n = len(y)
    if n < least:
        return {"n_cap": float(n)}
    ra, rb, rab = float(spearman(xa, y)), float(spearman(xb, y)), float(spearman(xa, xb))
    ba, bb, _, _ = redrawn_pools(xa, xb, y, rng, times)
    known = np.isfinite(ba) & np.isfinite(bb)
    dz, raw = fisher(ba[known]) - fisher(bb[known]), ba[known] - bb[known]
    delta = float(fisher(ra) - fisher(rb))
    ja, jb = (counted.leave_one_out(v, y) for v in (xa, xb)) if times else (np.zeros(0), np.zeros(0))
    jz, jr = fisher(ja) - fisher(jb), ja - jb
    z, r, w = special.bca(delta, dz, jz), special.bca(ra - rb, raw, jr), williams(ra, rb, rab, n)
    p = (1 + int((np.abs(dz - delta) >= abs(delta)).sum())) / (1 + len(dz)) if len(dz) and np.isfinite(delta) else float("nan")
    return {"n_cap": float(n), "rho_a": ra, "rho_b": rb, "r_spear": rab, "r_pear": float(pearson(xa, xb)), "delta_rho": ra - rb, "delta_z": delta, "p_boot": p, "t_hw": w["t"], "p_hw": w["p"], "ci_z_lo": z[0], "ci_z_hi": z[1], "ci_rho_lo": r[0], "ci_rho_hi": r[1], "n_boot_valid": float(len(dz))}


def pooled(xa: np.ndarray, xb: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Correlations of a, of b, of a with b, and of their mean rank, with y."""
    ra, rb, ry = ranks(xa), ranks(xb), ranks(y)
    return pearson(ra, ry), pearson(rb, ry), pearson(ra, rb), pearson((ra + rb) / 2, ry)


def redrawn_pools(xa: np.ndarray, xb: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int) -> np.ndarray:
    """pooled of each bootstrap replicate, a row a correlation."""
    n, (a, b, c) = len(y), map(counted.Values, (xa, xb, y))
    out = [np.zeros((4, 0))]
    for i in one_by_one(draws(rng, n, times), n):
        k = counted.drawn(i, n)
        (ra, va), (rb, vb), (ry, vy) = a.centred(k), b.centred(k), c.centred(k)
        ay, by, ab = (counted.products(k, p, q) for p, q in ((ra, ry), (rb, ry), (ra, rb)))
        out.append(np.vstack([counted.correlation(ay, va, vy), counted.correlation(by, vb, vy), counted.correlation(ab, va, vb), counted.correlation(ay + by, va + vb + 2 * ab, vy)]))
    return np.concatenate(out, axis=1)


def pool_check(xa: np.ndarray, xb: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int = 2000, least: int = 8) -> dict[str, float]:
    """Correlation of the pooled ranks against what the identity predicts, with percentile intervals; ranks are made anew in each replicate."""
    ok = np.isfinite(xa) & np.isfinite(xb) & np.isfinite(y)
    xa, xb, y = xa[ok], xb[ok], y[ok]
    n = len(y)
    if n < least:
        return {"n_cap": float(n)}
    a, b, r, z = map(float, pooled(xa, xb, y))
    ba, bb, _, bz = redrawn_pools(xa, xb, y, rng, times)
    predicted = (a + b) / np.sqrt(2 * (1 + r)) if r > -1 else float("nan")
    ia, ib, iz = interval(ba), interval(bb), interval(bz)
    return {
        "n_cap": float(n), "rho_a": a, "rho_b": b, "r_spear": r, "rho_z_obs": z, "rho_z_pred": float(predicted), "abs_err": abs(z - float(predicted)), "rho_a_lo": ia[0], "rho_a_hi": ia[1], "rho_b_lo": ib[0], "rho_b_hi": ib[1], "rho_z_lo": iz[0], "rho_z_hi": iz[1],
        "rho_a_excludes_0": float(excludes_zero(*ia)), "rho_b_excludes_0": float(excludes_zero(*ib)), "rho_z_covers_0": float(covers_zero(*iz)), "n_boot_valid": float(np.isfinite(bz).sum()),
    }


def cochran(z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and Q along the last axis."""
    mean = (z * w).sum(-1) / w.sum()
    return mean, (w * (z - mean[..., None]) ** 2).sum(-1)


class Redrawn:
    """Rank correlations of tasks (rows of x, nan where a task was not taken) with y, in bootstrap replicates of participants."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.n, known = len(y), [np.flatnonzero(np.isfinite(row) & np.isfinite(y)) for row in x]
        whole = counted.Values(y)
        self.tasks = [(at, counted.Values(row[at]), whole if len(at) == len(y) else counted.Values(y[at])) for at, row in zip(known, x, strict=True)]

    def __call__(self, picks: np.ndarray, least: int) -> np.ndarray:
        """Fisher's z, a row a replicate and a column a task; nan for fewer than `least` pairs."""
        return np.concatenate([np.stack(self._one(i, least), axis=-1).reshape(-1, len(self.tasks)) for i in one_by_one([picks], self.n)])

    def _one(self, picks: np.ndarray, least: int) -> list[np.ndarray]:
        counts, out, shared = counted.drawn(picks, self.n), [], None
        for at, x, y in self.tasks:
            if not len(at):
                out.append(np.full(counts.shape[:-1], np.nan))
                continue
            if len(at) == self.n:
                own, (b, vb) = counts, (shared := shared or y.centred(counts))
            else:
                own = np.take(counts, at, axis=-1)
                b, vb = y.centred(own)
            a, va = x.centred(own)
            r = counted.correlation(counted.products(own, a, b), va, vb)
            out.append(np.where((own.sum(-1) >= max(least, 3)) & np.isfinite(r), fisher(r), np.nan))
        return out


def heterogeneity(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int = 9999, least: int = 8) -> dict[str, float]:
    """Q of the tasks' correlations with y, its chi-square p, and p under a recentred bootstrap of participants.  x: a row a task, nan where a task was not taken."""
    return heterogeneity_p(*heterogeneity_part(x, y, rng, times, least))


def heterogeneity_part(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int = 9999, least: int = 8, part: tuple[int, int] | None = None) -> tuple[dict[str, float], np.ndarray]:
    """What is seen, and Q of the replicates (of a part of them, if told so)."""
    rho, n = spearman_masked(x, np.broadcast_to(y, x.shape))
    used = np.isfinite(rho) & (n >= least)
    x, rho, n = x[used], rho[used], n[used]
    if len(rho) < 2:
        return {"n_tasks": float(len(rho))}, np.zeros(0)
    w, z = n - 3.0, fisher(rho)
    mean, q = (float(v) for v in cochran(z, w))
    redrawn, null = Redrawn(x, y), []
    for i in draws(rng, len(y), times, part):
        zb = redrawn(i, least)
        zb = zb[np.isfinite(zb).all(axis=1)]
        null.append(cochran(zb - z + mean, w)[1])
    df = len(rho) - 1
    seen = {"n_tasks": float(len(rho)), "q": q, "i2": max(0.0, (q - df) / q) if q > 0 else 0.0, "zbar": mean, "rho_min": float(rho.min()), "rho_max": float(rho.max()), "p_chi2": special.chi2_sf(q, df)}
    return seen, np.concatenate(null) if null else np.zeros(0)


def heterogeneity_p(seen: dict[str, float], null: np.ndarray) -> dict[str, float]:
    """What is seen with its p and the null's median and 95 % point."""
    if "q" not in seen:
        return seen
    p = (1 + int((null >= seen["q"]).sum())) / (1 + len(null)) if len(null) else float("nan")
    return seen | {"p": p, "n_boot_valid": float(len(null)), "q_null_med": float(np.median(null)) if len(null) else float("nan"), "q_null_p95": float(np.percentile(null, 95)) if len(null) else float("nan")}


def largest_contrast(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int = 4999, least: int = 8) -> dict[str, float]:
    """p of the largest difference of z over all pairs of tasks, against the largest centred difference of each replicate."""
    return largest_p(*largest_part(x, y, rng, times, least))


def largest_part(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, times: int = 4999, least: int = 8, part: tuple[int, int] | None = None) -> tuple[dict[str, float], np.ndarray]:
    """What is seen, and the largest difference of the replicates (of a part of them, if told so)."""
    pairs = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x))]
    used, seen = [], []
    for a, b in pairs:
        ok = np.isfinite(x[a]) & np.isfinite(x[b]) & np.isfinite(y)
        if ok.sum() >= least:
            d = float(fisher(spearman(x[a][ok], y[ok])) - fisher(spearman(x[b][ok], y[ok])))
            if np.isfinite(d):
                used.append((a, b))
                seen.append(d)
    got = {"n_tasks": float(len(x)), "n_pairs": float(len(pairs))}
    if not used:
        return got, np.zeros(0)
    redrawn, peaks = Redrawn(x, y), []
    for i in draws(rng, len(y), times, part):
        z = redrawn(i, least)
        far = np.full(len(i), np.nan)
        for (a, b), d in zip(used, seen, strict=True):
            far = np.fmax(far, np.abs(z[:, a] - z[:, b] - d))
        peaks.append(far[np.isfinite(far)])
    return got | {"n_used": float(len(used)), "max_abs_dz": max(map(abs, seen))}, np.concatenate(peaks) if peaks else np.zeros(0)


def largest_p(seen: dict[str, float], far: np.ndarray) -> dict[str, float]:
    if "max_abs_dz" not in seen:
        return seen
    return seen | {"p_max": (1 + int((far >= seen["max_abs_dz"]).sum())) / (1 + len(far)) if len(far) else float("nan"), "n_boot_valid": float(len(far))}
