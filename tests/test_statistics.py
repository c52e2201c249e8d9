"""Distribution functions, replicated rank statistics, models and screens against plain versions and known toys."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from tandemetry.functions import kernels, models, resampling, special
from tandemetry.functions.stats import average_ranks, avg_rank
from tandemetry.operators import screening


def plain_ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 if a == a else np.nan for a in v])


def integral(f, a, b, n=20_000):
    x = np.linspace(a, b, n + 1)
    return float(np.trapezoid([f(v) for v in x], x))


def test_tails_against_integrals():
    for df, x in ((1, 0.5), (4, 9.49), (7, 2.0), (30, 50.0)):
        density = lambda v, df=df: v ** (df / 2 - 1) * math.exp(-v / 2) / 2 ** (df / 2) / math.gamma(df / 2) if v else 0.0
        assert abs(special.chi2_sf(x, df) - integral(density, x, x + 200)) < 1e-5
    for df, t in ((3, 1.0), (47, 2.5), (148, 0.3)):
        density = lambda v, df=df: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + v * v / df) ** (-(df + 1) / 2)
        assert abs(special.t_two_sided(t, df) - (1 - 2 * integral(density, 0, t))) < 1e-6
    assert abs(special.normal_sf(1.96) - (1 - NormalDist().cdf(1.96))) < 1e-15


def test_mann_whitney_exact_and_normal():
    for n1, n2 in ((3, 4), (5, 3)):
        us = [sum(i > j for i in a for j in set(range(n1 + n2)) - set(a)) for a in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            want = min(1.0, 2 * sum(v >= max(u, n1 * n2 - u) for v in us) / len(us))
            assert abs(special.mann_whitney_p(u, n1, n2, 0) - want) < 1e-12
    p = special.mann_whitney_p(60.0, 12, 15, 30.0)
    spread = math.sqrt(12 * 15 / 12 * (28 - 30 / (27 * 26)))
    assert abs(p - 2 * (1 - NormalDist().cdf((120 - 90 - 0.5) / spread))) < 1e-12


def test_ranks_and_masked_correlations():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, (40, 25)).astype(float), rng.normal(size=(40, 25))
    x[rng.random(x.shape) < 0.2] = np.nan
    assert np.allclose(resampling.ranks(x), [plain_ranks(r) for r in x], equal_nan=True)
    got, n = resampling.spearman_masked(x, y)
    for a, b, r, k in zip(x, y, got, n, strict=True):
        ok = ~np.isnan(a)
        assert k == ok.sum() and abs(r - np.corrcoef(plain_ranks(a[ok]), plain_ranks(b[ok]))[0, 1]) < 1e-12
    assert np.isnan(resampling.spearman(np.ones(9), np.arange(9.0)))


def test_kernels_against_loops():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=90), 1)
    r = 0.2 * x.std()
    near = [sum(np.abs(x[i : i + m] - x[j : j + m]).max() <= r for i in range(90 - m + 1) for j in range(i + 1, 90 - m + 1)) for m in (2, 3)]
    assert abs(kernels.sample_entropy(x) + math.log(near[1] / near[0])) < 1e-12 and math.isnan(kernels.sample_entropy(x[:21]))
    a, b = rng.normal(size=130), rng.normal(size=130)
    za, zb = ((v - v.mean()) / v.std() for v in (a, b))
    d = np.array([[math.dist([za[i], za[i + 4], za[i + 8]], [zb[j], zb[j + 4], zb[j + 8]]) for j in range(122)] for i in range(122)])
    hit = d <= np.quantile(d, 0.05)

    def lines(seqs):
        return [len(list(g)) for s in seqs for on, g in itertools.groupby(s) if on]

    diagonal = [n for n in lines(np.diagonal(hit, k) for k in range(-121, 122))]
    vertical = lines(hit.T)
    got = kernels.recurrence(a, b)
    long = [n for n in diagonal if n >= 2]
    share = np.array([long.count(n) for n in set(long)]) / len(long)
    want = {"rr": hit.mean(), "det": sum(long) / hit.sum(), "maxline": max(long), "meanline": np.mean(long), "entropy": -(share * np.log(share)).sum(), "lam": sum(n for n in vertical if n > 1) / hit.sum(), "tt": np.mean([n for n in vertical if n > 1])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    f, p = kernels.welch(a)
    parts = [a[i : i + 128] for i in range(0, 3, 64)]
    direct = [[abs(sum((v - s.mean()) * w * np.exp(-2j * np.pi * k * i / 128) for i, (v, w) in enumerate(zip(s, np.hanning(128), strict=True)))) ** 2 for k in range(65)] for s in parts]
    assert np.allclose(p, np.mean(direct, axis=0)) and f[-1] == 2


def test_interval_of_a_skewed_statistic():
    rng = np.random.default_rng(2)
    v = rng.exponential(size=60)
    boots = np.array([v[rng.integers(0, 60, 60)].mean() for _ in range(4000)])
    jack = np.array([np.delete(v, i).mean() for i in range(60)])
    lo, hi = special.bca(v.mean(), boots, jack)
    plain = np.quantile(boots, [0.025, 0.975])
    assert plain[0] < lo < v.mean() and hi > plain[1]
    nd, below = NormalDist(), (boots < v.mean()).mean()
    off = jack.mean() - jack
    z0, a = nd.inv_cdf(below), (off**3).sum() / 6 / (off**2).sum() ** 1.5
    at = [nd.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (nd.inv_cdf(0.025), nd.inv_cdf(0.975))]
    assert np.allclose([lo, hi], np.quantile(boots, at)) and np.isnan(special.bca(1.0, boots[:5], jack)).all()


def test_toys():
    """Known constructions: the pooling identity, a flip that cancels, equal and opposite correlations, equal and unequal slopes."""
    rng = np.random.default_rng(20260801)
    y = rng.normal(size=60)
    a, b, r, z = resampling.pooled(xa := y + 0.4 * rng.normal(size=60), 0.5 * xa + 0.5 * rng.normal(size=60), y)
    assert abs(z - (a + b) / math.sqrt(2 * (1 + r))) <= 0.03
    flip = resampling.pool_check(y + 0.45 * rng.normal(size=60), -y + 0.45 * rng.normal(size=60), y, np.random.default_rng(3), 400)
    assert abs(flip["rho_z_pred"]) <= 0.18 and flip["rho_z_covers_0"] and flip["rho_a_excludes_0"]
    assert abs(resampling.williams(0.3, 0.3, 0.2, 60)["t"]) <= 1e-9 and resampling.williams(0.336, -0.25, 0.0, 51)["p"] < 0.05
    y = rng.normal(size=80)
    same = np.stack([0.35 * y + rng.normal(size=80) for _ in range(6)])
    apart = np.stack([(0.55 if t < 3 else -0.55) * y + 0.35 * rng.normal(size=80) for t in range(6)])
    p = [resampling.heterogeneity(x, y, np.random.default_rng(4), 400)["p"] for x in (same, apart)]
    assert p[1] < 0.05 and p[1] < p[0]


def test_jackknife_and_contrast():
    rng = np.random.default_rng(5)
    y = rng.normal(size=20)
    xa, xb = y + rng.normal(size=20), rng.normal(size=20)
    got = resampling.pair_contrast(xa, xb, y, np.random.default_rng(6), 300)
    ra, rb = (np.corrcoef(plain_ranks(x), plain_ranks(y))[0, 1] for x in (xa, xb))
    assert abs(got["delta_rho"] - (ra - rb)) < 1e-12 and got["ci_rho_lo"] < ra - rb < got["ci_rho_hi"] and got["n_boot_valid"] == 300
    left = resampling.left_out(resampling.spearman, xa, y)
    assert np.allclose(left, [np.corrcoef(plain_ranks(np.delete(xa, i)), plain_ranks(np.delete(y, i)))[0, 1] for i in range(20)])


def test_ridge_by_refitting():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(25, 2)), rng.normal(size=25)
    x = (x - x.mean(0)) / x.std(0)

    def solved(x, y, alpha):
        m = x.mean(0)
        w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(2), (x - m).T @ (y - y.mean()))
        return w, y.mean() - m @ w

    errors = []
    for alpha in models.ALPHAS:
        out = []
        for i in range(25):
            # the penalty's leave-one-out error keeps the centre of all rows, as the closed form does
            xc, yc = np.delete(x - x.mean(0), i, 0), np.delete(y - y.mean(), i)
            full = np.vstack([np.append(xc, np.ones((24, 1)), 1)])
            w = np.linalg.solve(full.T @ full + np.diag([alpha, alpha, 0]), full.T @ yc)
            out.append((y[i] - y.mean() - np.append((x - x.mean(0))[i], 1) @ w) ** 2)
        errors.append(np.mean(out))
    w, base, alpha = models.ridge(x, y)
    assert alpha == models.ALPHAS[int(np.argmin(errors))]
    assert np.allclose(np.append(w, base), np.append(*solved(x, y, alpha)))


def test_folds_and_selection():
    rng = np.random.default_rng(8)
    y, group = rng.normal(size=43), np.where(rng.random(43) < 0.4, "preterm", "other")
    fold = models.dealt(models.strata(y, group, 5), 5, rng)
    assert np.bincount(fold).max() - np.bincount(fold).min() <= 1 and [models.schedule(n) for n in (40, 28, 18, 12, 11)] == [(5, 10), (4, 10), (3, 15), (2, 20), None]
    x = np.column_stack([rng.normal(size=43), y + 0.3 * rng.normal(size=43), rng.normal(size=43)])
    got = models.selection_cell(x, y, 0.5, 1, 3, 10)
    assert got["top"][0] == 1 and got["rho"] > 0.8 and got["p"] == 0.25 and got["stage_frac"] == 1
    ridge = models.ridge_cell(x[:, 1:2], y, group, 1, 3)
    assert ridge["rho"] > 0.8 and ridge["p"] == 0.25 and ridge["n_folds"] == 50


@pytest.mark.parametrize("ranges", [1, 7])
def test_ranks_by_ranges(spark, ranges):
    rng = random.Random(0)
    rows = [(k, float(rng.choice([1, 1, rng.randrange(40)]))) for k in range(3) for _ in range(300)]
    df = spark.createDataFrame(rows, "k long, x double")
    got = average_ranks(df, ["k"], "x", "r", ranges).groupBy("k", "x", "r").count().collect()
    want = df.select("k", "x", avg_rank("x", "k").alias("r")).groupBy("k", "x", "r").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_screen_finds_what_was_planted(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=40)
    features = [(t, f"p{i:02d}", f, float(v)) for t in (1, 2) for f, shift in (("good", 2.0), ("flip", 2.0 if t == 1 else -2.0), ("noise_per_min", 0.0)) for i, v in enumerate(shift * y + rng.normal(size=40))]
    features += [(1, "p00", "flat", 1.0), (1, "p01", "flat", 1.0), (3, "p00", "good", None)]
    targets = [(f"p{i:02d}", "SA", float(v)) for i, v in enumerate(y)] + [("p99", "SA", None)]
    f, t = spark.createDataFrame(features, "task int, pid string, feature string, value double"), spark.createDataFrame(targets, "pid string, target string, y double")
    tables = screening.screen(f, t, splits=20, shuffles=4, permutations=99)
    a = {(r.task, r.feature): r for r in tables["stage_a"].collect()}
    assert len(a) == 6 and a[1, "good"].candidate and a[2, "flip"].rho < -0.8 and a[1, "good"].stability > 0.9
    b = tables["stage_b"].toPandas()
    assert set(zip(b.task, b.feature, strict=True)) >= {(1, "good"), (2, "good"), (1, "flip"), (2, "flip")} and (b[b.feature != "noise_per_min"].p == 0.01).all() and b[b.feature != "noise_per_min"].fdr_sig.all()
    assert tables["null_stability"].count() == 6 * 4
    rows = screening.observed(f, t)
    hits = spark.createDataFrame([(int(r.task), "child", "SA", r.feature, float(r.rho), float(r.q), float(r.stability), int(r.n)) for r in b.itertuples()], "task int, source string, target string, feature string, rho double, q double, stability double, n int")
    flips = screening.sign_flips(hits)
    assert [(r.feature, r.task_a, r.task_b) for r in flips.collect()] == [("flip", 1, 2)]
    c = screening.pair_contrasts(rows, flips, 200).collect()
    assert len(c) == 1 and c[0].p_boot < 0.02 and c[0].p_hw < 1e-6 and c[0].ci_z_lo > 0
    v = screening.pool_checks(rows, flips, 200, spark.createDataFrame([("flip", "SA", 1, 2, c[0].rho_a, c[0].rho_b, c[0].r_spear)], "feature string, target string, task_a int, task_b int, rho_a double, rho_b double, r_spear double")).collect()
    assert v[0].rho_a_excludes_0 and v[0].match and v[0].abs_err < 0.05
    fam = {r.feature: r for r in screening.families(rows, 200).collect()}
    assert fam["flip"].p < 0.02 and fam["flip"].cochran_q > 20 and fam["flip"].p_chi2 < 1e-4 and fam["flip"].q <= fam["good"].q
    assert {r.feature: r.p_max for r in screening.largest_contrasts(rows, times=200).collect()}["flip"] < 0.02
    sourced = rows.selectExpr("*", "'child' as source")
    taus = tables["thresholds"]
    sel = {(r.task): r for r in screening.selection_cells(sourced, taus, hits, 3, 10).collect()}
    assert sel[1].selected in ("good", "flip") and sel[1].rho > 0.7 and sel[1].p == 0.25 and sel[1].m == 1 and sel[1].n_pool == 3
    groups = spark.createDataFrame([(p, "preterm" if k % 2 else "other") for k, (p, *_) in enumerate(targets)], "pid string, grp string")
    ridge = {(r.task): r for r in screening.ridge_cells(sourced, hits, groups, 2).collect()}
    assert ridge[1].rho > 0.7 and ridge[1].selected.count("|") == 1 and ridge[1].n_folds == 50
    over = screening.target_overlap(hits, ["SA", "CSS"]).toPandas()
    assert over.on_SA.all() and not over.on_CSS.any() and over.rho_CSS.isna().all()
    assert screening.target_overlap(hits.limit(0), ["SA"]).columns == ["task", "source", "feature", "n_targets", "targets", "on_SA", "rho_SA", "n"]
    seconds = spark.createDataFrame([(p, k, float(len(p) + i % 7)) for k in (1, 2) for i, (p, *_) in enumerate(targets)], "pid string, task int, seconds double")
    part = {(r.task, r.feature): r for r in screening.with_duration(rows, seconds).collect()}
    assert part[1, "good"].sign_survives and part[1, "noise_per_min"].rate_normalised and abs(part[1, "good"].partial - part[1, "good"].rho) < 0.2
    report = screening.contrast_report(hits, hits.where("feature <> 'flip'").withColumn("rho", hits.rho + 0.1), ["task", "target", "feature"], "rho").first()
    assert report.n_both == report.n_new == report.n_moved and report.n_old == report.n_new + 2
