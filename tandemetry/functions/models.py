"""Selection and ridge regression validated on left-out participants, on the arrays of one cell."""

from __future__ import annotations

from collections import Counter

import numpy as np

from tandemetry.functions.resampling import half_stability, pearson, ranks, spearman

#: The penalties tried, and folds and repeats by the number of participants.
ALPHAS = np.logspace(-1, 4, 30)
SCHEDULE = ((40, 5, 10), (28, 4, 10), (18, 3, 15), (12, 2, 20))


def schedule(n: int) -> tuple[int, int] | None:
    return next(((folds, repeats) for least, folds, repeats in SCHEDULE if n >= least), None)


def strata(y: np.ndarray, group: np.ndarray, folds: int) -> np.ndarray:
    """Quartile of y by group, the coarsest split down to none that gives each stratum as many members as folds."""
    edges = np.unique(np.quantile(y, [0.25, 0.5, 0.75]))
    quarter = np.searchsorted(edges, y, side="right")
    for s in (quarter * 2 + (group == "preterm"), quarter, (y >= np.median(y)).astype(int)):
        if np.unique(s, return_counts=True)[1].min() >= folds:
            return s
    return np.zeros(len(y), int)


def dealt(stratum: np.ndarray, folds: int, rng: np.random.Generator) -> np.ndarray:
    """A fold for each row: strata shuffled and dealt in turn, so folds and strata are as even as can be."""
    out, start = np.empty(len(stratum), int), 0
    for s in np.unique(stratum):
        at = rng.permutation(np.flatnonzero(stratum == s))
        out[at] = (start + np.arange(len(at))) % folds
        start += len(at)
    return out


def ridge(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Coefficients, intercept and the penalty with the least mean squared leave-one-out error; x is standardised."""
    xc, yc = x - x.mean(0), y - y.mean()
    u, s, v = np.linalg.svd(xc, full_matrices=False)
    uy = u.T @ yc
    best = None
    for alpha in ALPHAS:
        shrink = s**2 / (s**2 + alpha)
        rest = (yc - u @ (shrink * uy)) / (1 - 1 / len(y) - (u**2 * shrink).sum(1))
        error = float((rest**2).mean())
        if best is None or error < best[0]:
            best = error, alpha, v.T @ (s / (s**2 + alpha) * uy)
    _, alpha, w = best
    return w, float(y.mean() - x.mean(0) @ w), float(alpha)


def ridge_scores(x: np.ndarray, y: np.ndarray, group: np.ndarray, folds: int, repeats: int, rng: np.random.Generator) -> list[float]:
    """Rank correlation of prediction and truth in each left-out fold; 0 where either hardly varies."""
    s, out = strata(y, group, folds), []
    for _ in range(repeats):
        fold = dealt(s, folds, rng)
        for k in range(folds):
            train, test = fold != k, fold == k
            mean, spread = x[train].mean(0), x[train].std(0)
            z = (x - mean) / np.where(spread > 0, spread, 1.0)
            w, base, _ = ridge(z[train], y[train])
            guess = z[test] @ w + base
            out.append(0.0 if guess.std() <= 1e-12 or y[test].std() <= 1e-12 else float(spearman(y[test], guess)))
    return out


def summary(scores: list[float]) -> dict[str, float]:
    v = np.asarray(scores, float)
    v = v[np.isfinite(v)]
    if not len(v):
        return {}
    lo, hi = np.quantile(v, [0.025, 0.975])
    return {"rho": float(v.mean()), "rho_sd": float(v.std(ddof=1)) if len(v) > 1 else 0.0, "rho_pos_frac": float((v > 0).mean()), "rho_p025": float(lo), "rho_p975": float(hi), "n_folds": float(len(scores))}


def ridge_cell(x: np.ndarray, y: np.ndarray, group: np.ndarray, seed: int, permutations: int = 1000) -> dict[str, float]:
    """Validated ridge of a cell, and its right-sided p over shuffles of y; empty for fewer than 12 complete rows."""
    ok = np.isfinite(x).all(1) & np.isfinite(y)
    x, y, group = x[ok], y[ok], group[ok]
    plan = schedule(len(y))
    if plan is None:
        return {"n": float(len(y))}
    got = summary(ridge_scores(x, y, group, *plan, np.random.default_rng(seed)))
    rng, null = np.random.default_rng(seed + 52001), []
    for k in range(permutations):
        null.append(summary(ridge_scores(x, rng.permutation(y), group, *plan, np.random.default_rng(seed + 52002 + k)))["rho"])
    p = (1 + sum(v >= got["rho"] for v in null)) / (1 + len(null)) if null else float("nan")
    return {"n": float(len(y)), "n_splits": float(plan[0]), "n_repeats": float(plan[1]), **got, "p": p}


def correlations(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Rank correlation of each column with y over its known rows; nan for fewer than `least`."""
    out = np.full(x.shape[1], np.nan)
    full = np.isfinite(x).all(0)
    if full.any() and len(y) >= least:
        out[full] = pearson(ranks(x[:, full].T), np.broadcast_to(ranks(y), (int(full.sum()), len(y))))
    for j in np.flatnonzero(~full):
        ok = np.isfinite(x[:, j])
        if ok.sum() >= least:
            out[j] = spearman(x[ok, j], y[ok])
    return out


def selected(x: np.ndarray, y: np.ndarray, tau: float, seed: int, splits: int = 40, least: int = 12) -> tuple[int | None, float, int]:
    """The column of largest correlation among those as stable as tau, else among all; its correlation, and how many were stable."""
    rho = correlations(x, y, least)
    known = np.flatnonzero(np.isfinite(rho))
    if not len(known):
        return None, float("nan"), 0
    stable = []
    for j in known:
        ok = np.isfinite(x[:, j])
        if half_stability(x[ok, j], y[ok], np.random.default_rng(seed + 17 * int(j) + 3), splits) >= tau:
            stable.append(j)
    pool = stable or list(known)
    j = max(pool, key=lambda k: (abs(rho[k]), -k))
    return int(j), float(rho[j]), len(stable)


def left_out_part(x: np.ndarray, y: np.ndarray, tau: float, seed: int, first: int, end: int, splits: int = 40, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the participants from first to end: the prediction by the signed column that the others select, that column (-1: none), and how many were stable."""
    n = len(y)
    guess, picks, passed = np.full(end - first, np.nan), np.full(end - first, -1), np.zeros(end - first, int)
    for i in range(first, end):
        train = np.arange(n) != i
        j, rho, stable = selected(x[train], y[train], tau, seed + 131 * i, splits, least)
        passed[i - first] = stable
        if j is not None:
            picks[i - first] = j
            guess[i - first] = np.sign(rho) * x[i, j] if np.isfinite(x[i, j]) else np.nan
    return guess, picks, passed


def left_out_summary(y: np.ndarray, guess: np.ndarray, picks: np.ndarray, passed: np.ndarray) -> dict:
    """Rank correlation of truth and prediction, and how steady the selection was."""
    ok = np.isfinite(guess)
    rho = float(spearman(y[ok], guess[ok])) if ok.sum() >= 8 else float("nan")
    counted = Counter(int(j) for j in picks if j >= 0)
    top = [j for j, _ in counted.most_common(2)]
    share = counted[top[0]] / len(y) if top else 0.0
    return {"rho": rho, "n": len(y), "top": top, "top1_frac": share, "npass_mean": float(np.mean(passed)) if len(passed) else 0.0, "stage_frac": float(np.mean(passed > 0)) if len(passed) else 0.0}


def left_out_selection(x: np.ndarray, y: np.ndarray, tau: float, seed: int, splits: int = 40, least: int = 12) -> dict:
    """Each participant is predicted by the signed column that the others select; rho is that of truth and prediction."""
    return left_out_summary(y, *left_out_part(x, y, tau, seed, 0, len(y), splits, least))


def shuffled(y: np.ndarray, seed: int, k: int) -> tuple[np.ndarray, int]:
    """y and the seed of a selection: as they are for k = 0, else those of shuffle k."""
    if not k:
        return y, seed
    rng = np.random.default_rng(52001 + seed)
    for _ in range(k):
        new = rng.permutation(y)
    return new, seed + 10_000 + 3 * (k - 1)


def selection_p(rho: float, null: np.ndarray) -> dict[str, float]:
    null = null[np.isfinite(null)]
    if not (len(null) and np.isfinite(rho)):
        return {}
    return {"p": (1 + int((null >= rho - 1e-15).sum())) / (1 + len(null)), "null_med": float(np.median(null)), "null_p95": float(np.quantile(null, 0.95))}


def selection_cell(x: np.ndarray, y: np.ndarray, tau: float, seed: int, permutations: int = 200, splits: int = 40, least: int = 12) -> dict:
    """left_out_selection and its right-sided p: every shuffle of y repeats the whole selection."""
    ok = np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(y) < least:
        return {"n": len(y)}
    got = left_out_selection(x, y, tau, seed, splits, least)
    times = permutations if np.isfinite(got["rho"]) else 0
    null = [left_out_selection(x, *((new := shuffled(y, seed, k))[0], tau, new[1]), splits, least)["rho"] for k in range(1, times + 1)]
    return got | selection_p(got["rho"], np.array(null, float))
