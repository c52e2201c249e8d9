"""Replicates by counts against sorted ranks, and kernels that stay small for a large cohort."""

import tracemalloc

import numpy as np

from tandemetry.functions import counted, resampling


def three(n, digits, seed=3):
    rng = np.random.default_rng(seed)
    y = np.round(rng.normal(size=n), digits)
    return np.round(y + rng.normal(size=n), digits), np.round(rng.normal(size=n), digits), y


def test_contrast_of_a_large_cohort_needs_no_square_of_it():
    xa, xb, y = three(3000, 6)
    tracemalloc.start()
    got = resampling.pair_contrast(xa, xb, y, np.random.default_rng(1), 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and got["ci_z_lo"] < got["delta_z"] < got["ci_z_hi"]


def test_leave_one_out_by_sums():
    for n, digits in ((9, 0), (40, 0), (40, 1), (41, 6)):
        xa, _, y = three(n, digits)
        assert np.allclose(counted.leave_one_out(xa, y), resampling.left_out(resampling.spearman, xa, y), equal_nan=True, atol=1e-12)
    assert np.isnan(counted.leave_one_out(np.ones(9), np.arange(9.0))).all()


def test_williams_test_alone_leaves_nobody_out(monkeypatch):
    xa, xb, y = three(50, 6)
    monkeypatch.setattr(counted, "leave_one_out", None)
    assert resampling.pair_contrast(xa, xb, y, np.random.default_rng(1), 0)["p_hw"] == resampling.williams(*(float(resampling.spearman(*p)) for p in ((xa, y), (xb, y), (xa, xb))), 50)["p"]


def test_heterogeneity_of_parts_is_that_of_the_whole():
    for n in (60, counted.FEW + 5):
        xa, xb, y = three(n, 1)
        x = np.stack([xa, xb, xa - xb])
        x[0, ::5] = np.nan
        whole = resampling.heterogeneity(x, y, np.random.default_rng(2), 30)
        got = [resampling.heterogeneity_part(x, y, np.random.default_rng(2), 30, part=p) for p in ((0, 11), (11, 12), (12, 30))]
        assert resampling.heterogeneity_p(got[0][0], np.concatenate([null for _, null in got])) == whole
        i = np.random.default_rng(2).integers(0, n, size=(30, n))
        z = np.stack([np.where(m >= 8, resampling.fisher(r), np.nan) for r, m in (resampling.spearman_masked(row[i], y[i]) for row in x)], axis=1)
        assert np.allclose(resampling.Redrawn(x, y)(i, 8), z, atol=1e-12)


def test_largest_contrast_of_parts_is_that_of_the_whole():
    xa, xb, y = three(70, 1)
    x = np.stack([xa, xb, xa - xb])
    whole = resampling.largest_contrast(x, y, np.random.default_rng(2), 30)
    got = [resampling.largest_part(x, y, np.random.default_rng(2), 30, part=p) for p in ((0, 7), (7, 30))]
    assert resampling.largest_p(got[0][0], np.concatenate([far for _, far in got])) == whole and whole["n_boot_valid"] == 30


def test_pooled_replicates_by_counts():
    for n, digits in ((50, 0), (counted.FEW + 3, 2)):
        xa, xb, y = three(n, digits)
        i = np.random.default_rng(4).integers(0, n, size=(20, n))
        got = resampling.redrawn_pools(xa, xb, y, np.random.default_rng(4), 20)
        assert np.allclose(got, np.stack(resampling.pooled(xa[i], xb[i], y[i])), atol=1e-12)
