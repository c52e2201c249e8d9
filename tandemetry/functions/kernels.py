"""Numerical kernels on whole arrays that no built-in expression has: entropy, spectra, synchrony and recurrence.

Each works on the contiguous runs of one cell, bounded by a recording; they are called through Arrow.
"""

from __future__ import annotations

import numpy as np

WINDOW, STEP, LAG, SURROGATES = 60, 20, 12, 20
RADIUS, EMBED, DELAY = 0.05, 3, 4


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2, least: int = 20) -> float:
    """-ln of the share of pairs of m-templates within r standard deviations that stay so for one more step; nan where undefined."""
    x = np.asarray(x, float)
    spread = x.std() if len(x) else 0.0
    if len(x) < m + least or not spread > 0:
        return float("nan")

    def near(size: int) -> int:
        """Pairs of templates whose numbers are all near."""
        k, total = len(x) - size + 1, 0
        for i in range(0, k, 256):
            rows = min(256, k - i)
            close = np.abs(x[i : i + rows + size - 1, None] - x[None, i:]) <= r * spread
            both = close[:rows, : k - i]
            for step in range(1, size):
                both = both & close[step : step + rows, step : step + k - i]
            total += int(np.count_nonzero(both[:, rows:])) + int(np.count_nonzero(np.triu(both[:, :rows], 1)))
        return total

    a, b = near(m + 1), near(m)
    return float(np.log(b / a)) if a and b else float("nan")


def coarse(x: np.ndarray, scale: int) -> np.ndarray:
    """Means of consecutive blocks."""
    k = len(x) // scale
    return x[: k * scale].reshape(k, scale).mean(axis=1)


def multiscale_entropy(runs: list[np.ndarray], scales: tuple[int, ...] = (1, 2, 3), least: int = 48, most: int = 2000) -> list[float]:
    """Mean sample entropy of the runs at each scale."""
    out = []
    for scale in scales:
        got = [sample_entropy(coarse(np.asarray(x, float), scale)[:most]) for x in runs if len(x) // scale >= least]
        got = [v for v in got if np.isfinite(v)]
        out.append(float(np.mean(got)) if got else float("nan"))
    return out


def welch(y: np.ndarray, rate: float = 4.0, size: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean power of half-overlapping Hann segments, each about its own mean."""
    size = min(size, len(y))
    parts = np.lib.stride_tricks.sliding_window_view(y, size)[:: max(1, size // 2)]
    spectra = np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * np.hanning(size), axis=1)
    return np.fft.rfftfreq(size, 1 / rate), (np.abs(spectra) ** 2).mean(axis=0)


def spectrum(y: np.ndarray) -> dict[str, float]:
    """Shares of power in three bands, the strongest frequency from 0.2 Hz on, and normalised spectral entropy."""
    y = np.asarray(y, float)
    f, p = welch(y - y.mean())
    if not p.sum() > 0:
        return {}
    q = p / p.sum()
    band = f >= 0.2
    full = q[q > 0]
    return {
        "pow_lo": float(q[(f >= 0.1) & (f < 0.5)].sum()), "pow_mid": float(q[(f >= 0.5) & (f < 1)].sum()), "pow_hi": float(q[(f >= 1) & (f <= 2)].sum()),
        "dom_freq": float(f[band][np.argmax(p[band])]), "spec_entropy": float(-(full * np.log(full)).sum() / np.log(len(full))),
    }


def peak(a: np.ndarray, b: np.ndarray, most: int = LAG, least: int = 16) -> tuple[float, int]:
    """The correlation of a[i] with b[i + lag] that is largest in size, and its lag, the first of equals; (0, 0) where there is none."""
    best = (0.0, 0)
    for lag in range(-most, most + 1):
        x, y = a[max(0, -lag) : len(a) - max(0, lag)], b[max(0, lag) : len(b) + min(0, lag)]
        if len(x) >= least:
            x, y = x - x.mean(), y - y.mean()
            size = np.sqrt((x * x).mean()) * np.sqrt((y * y).mean())
            if size > 0:
                r = float((x * y).mean() / size)
                if abs(r) > abs(best[0]):
                    best = r, lag
    return best


def windowed_sync(runs: list[tuple[np.ndarray, np.ndarray]], seconds: float = 0.25, surrogates: int = SURROGATES) -> dict[str, float]:
    """Peaks of lagged correlation in sliding windows inside runs, against windows paired at random."""
    wins = [(a[i : i + WINDOW], b[i : i + WINDOW]) for a, b in runs for i in range(0, len(a) - WINDOW + 1, STEP)]
    if len(wins) < 3:
        return {}
    got = [peak(a, b) for a, b in wins]
    r, lag = np.abs([x for x, _ in got]), np.array([k for _, k in got])
    rng = np.random.default_rng(0)
    pairs = [(k, j) for _ in range(surrogates) for k, j in enumerate(rng.permutation(len(wins))) if k != j]
    known = {pair: abs(peak(wins[pair[0]][0], wins[pair[1]][1])[0]) for pair in set(pairs)}
    base = float(np.mean([known[pair] for pair in pairs])) if pairs else float("nan")
    return {
        "sync_peak": float(r.mean()), "sync_peak_sd": float(r.std()), "sync_surrogate": base, "sync_excess": float(r.mean() - base), "sync_strong_frac": float((r > base + 0.1).mean()),
        "sync_lag_abs": float(np.abs(lag).mean() * seconds), "sync_lead": float(np.sign(lag).mean()), "sync_n_windows": float(len(wins)),
    }


def lengths(hits: np.ndarray) -> np.ndarray:
    """Lengths of the runs of true values along the rows of a matrix."""
    padded = np.zeros((hits.shape[0], hits.shape[1] + 2), np.int8)
    padded[:, 1:-1] = hits
    turn = np.diff(padded, axis=1).ravel()
    return np.flatnonzero(turn == -1) - np.flatnonzero(turn == 1)


def recurrence(x: np.ndarray, y: np.ndarray, least: int = 100, radius: float = RADIUS) -> dict[str, float] | None:
    """Cross-recurrence of one run: rate, and diagonal and vertical lines of at least two points."""

    def embedded(v: np.ndarray) -> np.ndarray:
        v = (v - v.mean()) / (v.std() or 1.0)
        n = len(v) - (EMBED - 1) * DELAY
        return np.stack([v[k * DELAY : k * DELAY + n] for k in range(EMBED)], axis=1) if n > 0 else np.empty((0, EMBED))

    p, q = embedded(np.asarray(x, float)), embedded(np.asarray(y, float))
    if len(p) < least:
        return None
    d = np.sqrt(sum((p[:, None, k] - q[None, :, k]) ** 2 for k in range(EMBED)))
    hit = d <= np.quantile(d, radius)
    points = int(hit.sum())
    if not points:
        return None
    n, m = hit.shape
    # diagonals as rows: row i shifted right by n - 1 - i
    sheared = np.zeros((n, n + m - 1), bool)
    rows, columns = np.nonzero(hit)
    sheared[rows, columns - rows + n - 1] = True
    diagonal, vertical = lengths(sheared.T), lengths(hit.T)
    out = {"rr": points / hit.size}
    if (long := diagonal[diagonal >= 2]).size:
        share = np.unique(long, return_counts=True)[1] / long.size
        out |= {"det": float(long.sum() / points), "maxline": float(long.max()), "meanline": float(long.mean()), "entropy": float(-(share * np.log(share)).sum())}
    if (long := vertical[vertical >= 2]).size:
        out |= {"lam": float(long.sum() / points), "tt": float(long.mean())}
    return out


def pooled_recurrence(runs: list[tuple[np.ndarray, np.ndarray]], most: int = 1500, least: int = 100) -> dict[str, float]:
    """Recurrence measures of runs, weighted by the length of those that have each."""
    got = [(min(len(a), most), r) for a, b in runs if (r := recurrence(a[:most], b[:most], least))]
    keys = dict.fromkeys(k for _, r in got for k in r)
    out = {f"crqa_{k}": sum(n * r[k] for n, r in got if k in r) / sum(n for n, r in got if k in r) for k in keys}
    return out | ({"crqa_n_runs": float(len(got))} if got else {})
