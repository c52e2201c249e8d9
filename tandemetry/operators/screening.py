"""Screens and contrasts of features against targets, per cell, with numpy kernels behind Arrow.

Inputs are long: features (task, pid, feature, value), targets (pid, target, y).  A cell's arrays hold a number a
participant (and a feature or task), so they are bounded by the cohort; cells are spread over all tasks by their keys.
Permutation and bootstrap counts are parameters whose defaults are those of the study.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemetry.functions import models, replicates, resampling, special
from tandemetry.functions.stats import avg_rank, benjamini_hochberg, partial_spearman, spearman

LEAST = 8
LEVEL = 0.05


def observed(features: DataFrame, targets: DataFrame, least: int = LEAST) -> DataFrame:
    """task, target, feature, pid, x, y of complete pairs, of features with enough of them and any variance."""
    joined = features.where("value is not null and not isnan(value)").join(targets.where("y is not null and not isnan(y)"), "pid")
    every = Window.partitionBy("task", "target", "feature")
    rows = joined.withColumn("__n", F.count("*").over(every)).withColumn("__s", F.stddev_pop("value").over(every))
    return rows.where((F.col("__n") >= least) & (F.col("__s") > 0)).select("task", "target", "feature", "pid", F.col("value").alias("x"), "y")


def cells(rows: DataFrame, keys: list[str], columns: list[str], item: str = "pid") -> DataFrame:
    """keys and `rows`, the cell's items in order."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(item, *columns))).alias("rows"))


def column(rows, name: str) -> np.ndarray:
    return np.asarray(rows.values(name), float)


def finite(values: dict) -> dict[str, float]:
    return {k: float(v) for k, v in values.items() if np.isfinite(v)}


def by_cell(df: DataFrame, kernel: Callable, *inputs: str) -> DataFrame:
    """Adds the map `values` of kernel(*inputs) for each row and leaves out its rows; numbers that are not finite are left out."""
    return replicates.mapped(replicates.dealt(df), lambda *args: {"values": finite(kernel(*args))}, inputs, "values map<string, double>")


def by_parts(df: DataFrame, keys: list[str], times: int, elements: Column, part: Callable, whole: Callable) -> DataFrame:
    """keys and the map `values` of whole(seen, null): part(rows, seed, first, end) gives what is seen and the null's numbers of a part of the replicates."""

    def kernel(own, seed, first, end):
        seen, null = part(own, seed, (first, end))
        return {"seen": finite(seen), "null": null}

    found = replicates.mapped(replicates.dealt(replicates.parts(df, times, elements)), kernel, ("rows", "seed", "first", "end"), "seen map<string, double>, null array<double>")
    null = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "null"))), lambda p: p["null"]))
    together = found.groupBy(*keys).agg(F.first("seen").alias("seen"), null.alias("null"))
    return replicates.mapped(together, lambda seen, null: {"values": finite(whole(dict(seen), null))}, ("seen", "null"), "values map<string, double>").drop("seen")


def spread(df: DataFrame, names: list[str]) -> DataFrame:
    """The named values as columns."""
    return df.select(*(c for c in df.columns if c not in ("values", "rows")), *(F.col("values")[n].alias(n) for n in names))


def stable_int(text: Column) -> Column:
    """Deterministic hash of a text below 1000003: each character's code added to 131 times what was before."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 131 + F.ascii(c)) % 1_000_003)


def seeded(df: DataFrame, base: int, *keys: str) -> DataFrame:
    """Adds `seed`, a function of the cell's names."""
    return df.withColumn("seed", base + 3 * stable_int(F.concat_ws(":", *(F.col(k).cast("string") for k in keys))))


def null_stabilities(rows: DataFrame, shuffles: int = 50, splits: int = 200, least: float = 0.20) -> DataFrame:
    """task, target, shuffle, feature, stability: half-split stability of every feature with the targets dealt anew to the task's participants.

    A shuffle gives one target to a participant for all features.
    """
    named = rows.groupBy("task", "target").agg(F.array_sort(F.collect_set(F.struct("pid", "y"))).alias("people"))
    places = rows.select("task", "target", "feature").distinct().withColumn("place", F.dense_rank().over(Window.partitionBy("task", "target").orderBy("feature")))
    each = cells(rows, ["task", "target", "feature"], ["x"]).join(places, ["task", "target", "feature"]).join(named, ["task", "target"])
    cut = replicates.parts(seeded(each, 42001, "task", "target"), shuffles, F.size("rows") * splits)

    def kernel(own, people, seed, place, first, end):
        # both are in the order of pid, so a participant's place among the people is found by merging
        ids, mine, y, x = people.values("pid"), own.values("pid"), column(people, "y"), column(own, "x")
        at, out = np.searchsorted(ids, mine), []
        for shuffle in range(first, end):
            new = np.random.default_rng(int(seed) + shuffle).permutation(y)[at]
            rng = np.random.default_rng(int(seed) + 10_000 + shuffle * 1000 + int(place))
            s = resampling.half_stability(x, new, rng, splits, least)
            out.append({"shuffle": shuffle, "stability": float(s) if np.isfinite(s) else None})
        return out

    return replicates.mapped(replicates.dealt(cut), kernel, ("rows", "people", "seed", "place", "first", "end"), "shuffle int, stability double").select("task", "target", "shuffle", "feature", "stability")


def thresholds(null: DataFrame, share: float = 0.95) -> DataFrame:
    """task, target, tau: the quantile of the null's stabilities."""
    return null.groupBy("task", "target").agg(F.percentile("stability", F.lit(share)).alias("tau"))


def stabilities(rows: DataFrame, splits: int = 200, least: float = 0.20) -> DataFrame:
    """task, target, feature, n, rho, stability of what was seen."""
    kernel = lambda own, seed: {"rho": float(resampling.spearman(column(own, "x"), column(own, "y"))), "stability": resampling.half_stability(column(own, "x"), column(own, "y"), np.random.default_rng(int(seed)), splits, least)}
    each = seeded(cells(rows, ["task", "target", "feature"], ["x", "y"]), 41001, "task", "target", "feature").withColumn("n", F.size("rows"))
    return spread(by_cell(each, kernel, "rows", "seed"), ["rho", "stability"]).drop("seed")


def candidates(seen: DataFrame, taus: DataFrame) -> DataFrame:
    """What was seen with tau and whether its stability reaches it."""
    return seen.join(taus, ["task", "target"], "left").withColumn("candidate", F.coalesce(F.col("stability") >= F.col("tau"), F.lit(False)))


def permutation_tests(rows: DataFrame, chosen: DataFrame, times: int = 1000, side: str = "two") -> DataFrame:
    """task, target, feature, p, null_med, null_p95 of the chosen features."""
    each = cells(rows.join(chosen.select("task", "target", "feature"), ["task", "target", "feature"], "left_semi"), ["task", "target", "feature"], ["x", "y"])
    kernel = lambda own, seed: resampling.permutation_p(column(own, "x"), column(own, "y"), np.random.default_rng(int(seed)), times, side)
    return spread(by_cell(seeded(each, 43001, "task", "target", "feature"), kernel, "rows", "seed"), ["p", "null_med", "null_p95"]).drop("seed")


def controlled(tested: DataFrame, family: list[str] | None = None) -> DataFrame:
    """Adds q, m and fdr_sig within each family (task and target, if not told otherwise; an empty list is the whole table)."""
    family = ["task", "target"] if family is None else family
    one = tested if family else tested.withColumn("__all", F.lit(1))
    out = benjamini_hochberg(one, family or ["__all"], "p", ["feature"] if "feature" in tested.columns else [c for c in tested.columns if c != "p"][:1])
    return out.drop("__all").withColumn("fdr_sig", F.coalesce(F.col("q") < LEVEL, F.lit(False)))


def screen(features: DataFrame, targets: DataFrame, splits: int = 200, shuffles: int = 50, permutations: int = 1000) -> dict[str, DataFrame]:
    """The whole screen: null_stability, thresholds, stage_a (all features), stage_b (candidates with p and q)."""
    rows = observed(features, targets)
    null = null_stabilities(rows, shuffles, splits)
    taus = thresholds(null)
    stage_a = candidates(stabilities(rows, splits), taus)
    tests = permutation_tests(rows, stage_a.where("candidate"), permutations)
    stage_b = controlled(stage_a.where("candidate").join(tests, ["task", "target", "feature"]))
    return {"null_stability": null, "thresholds": taus, "stage_a": stage_a, "stage_b": stage_b}


def paired(rows: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """feature, target, task_a, task_b and their participants' xa, xb, y: every pair of tasks, or those of `kept`."""
    a, b = (rows.select("feature", "target", "pid", F.col("task").alias(f"task_{s}"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}")) for s in "ab")
    both = a.join(b, ["feature", "target", "pid"]).withColumnRenamed("ya", "y")
    keys = ["feature", "target", "task_a", "task_b"]
    both = both.where("task_a < task_b") if kept is None else both.join(kept.select(*keys), keys, "left_semi")
    return cells(both, keys, ["xa", "xb", "y"])


PAIR = ["n_cap", "rho_a", "rho_b", "r_spear", "r_pear", "delta_rho", "delta_z", "p_boot", "t_hw", "p_hw", "ci_z_lo", "ci_z_hi", "ci_rho_lo", "ci_rho_hi", "n_boot_valid"]
CHECK = ["n_cap", "rho_a", "rho_b", "r_spear", "rho_z_obs", "rho_z_pred", "abs_err", "rho_a_lo", "rho_a_hi", "rho_b_lo", "rho_b_hi", "rho_z_lo", "rho_z_hi", "rho_a_excludes_0", "rho_b_excludes_0", "rho_z_covers_0", "n_boot_valid"]
FAMILY = ["n_tasks", "q", "i2", "zbar", "rho_min", "rho_max", "p_chi2", "p", "n_boot_valid", "q_null_med", "q_null_p95"]
LARGEST = ["n_tasks", "n_pairs", "n_used", "max_abs_dz", "p_max", "n_boot_valid"]


def _three(kernel: Callable, times: int) -> Callable:
    return lambda own, seed: kernel(column(own, "xa"), column(own, "xb"), column(own, "y"), np.random.default_rng(int(seed)), times)


def pair_contrasts(rows: DataFrame, kept: DataFrame | None = None, times: int = 4999) -> DataFrame:
    """Contrasts of task pairs: differences with BCa intervals, shifted-bootstrap p and Williams's test."""
    each = seeded(paired(rows, kept), 89001, "feature", "target", "task_a", "task_b")
    return spread(by_cell(each, _three(resampling.pair_contrast, times), "rows", "seed"), PAIR).drop("seed")


def pool_checks(rows: DataFrame, kept: DataFrame | None = None, times: int = 2000, expected: DataFrame | None = None) -> DataFrame:
    """Pooled ranks of task pairs against the identity, with percentile intervals; `match` compares with expected rho_a, rho_b, r_spear to 1e-9."""
    each = seeded(paired(rows, kept), 90001, "feature", "target", "task_a", "task_b")
    out = spread(by_cell(each, _three(resampling.pool_check, times), "rows", "seed"), CHECK).drop("seed")
    out = out.withColumns({c: F.col(c) == 1 for c in CHECK if c.endswith("_0")})
    if expected is None:
        return out
    keys = ["feature", "target", "task_a", "task_b"]
    told = expected.select(*keys, *(F.col(c).alias(f"__{c}") for c in ("rho_a", "rho_b", "r_spear")))
    near = [F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) < 1e-9, F.lit(True)) for c in ("rho_a", "rho_b", "r_spear")]
    return out.join(told, keys, "left").withColumn("match", near[0] & near[1] & near[2]).drop("__rho_a", "__rho_b", "__r_spear")


def _matrix(rows: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """feature, target and the values of all tasks of each participant."""
    kept = rows if tasks is None else rows.join(tasks.select("feature", "target", "task"), ["feature", "target", "task"], "left_semi")
    people = kept.groupBy("feature", "target", "pid").agg(F.first("y").alias("y"), F.map_from_entries(F.collect_list(F.struct("task", "x"))).alias("xs"))
    names = kept.groupBy("feature", "target").agg(F.array_sort(F.collect_set("task")).alias("tasks"))
    listed = people.join(names, ["feature", "target"]).withColumn("x", F.transform("tasks", lambda t: F.element_at("xs", t))).drop("xs", "tasks")
    return cells(listed, ["feature", "target"], ["x", "y"])


def _over_tasks(part: Callable, times: int) -> Callable:
    return lambda own, seed, some: part(own.matrix("x").T, column(own, "y"), np.random.default_rng(int(seed)), times, part=some)


def families(rows: DataFrame, times: int = 9999) -> DataFrame:
    """Heterogeneity of a feature's correlations over tasks, chi-square and bootstrap p, q over the whole table."""
    each = seeded(_matrix(rows), 88001, "feature", "target")
    found = by_parts(each, ["feature", "target"], times, F.size("rows") * F.size(F.get("rows", 0)["x"]), _over_tasks(resampling.heterogeneity_part, times), resampling.heterogeneity_p)
    return controlled(spread(found, FAMILY).where("n_tasks >= 2").withColumnRenamed("q", "cochran_q"), [])


def largest_contrasts(rows: DataFrame, hits: DataFrame | None = None, times: int = 4999) -> DataFrame:
    """p of the largest contrast over all pairs of the tasks, or of the tasks in hits."""
    each = seeded(_matrix(rows, hits), 89102, "feature", "target")
    return spread(by_parts(each, ["feature", "target"], times, F.size("rows") * F.size(F.get("rows", 0)["x"]), _over_tasks(resampling.largest_part, times), resampling.largest_p), LARGEST)


def task_correlations(features: DataFrame, least: int = 12) -> DataFrame:
    """feature, task_a, task_b, n, r of every pair of tasks, whatever the target."""
    known = features.where("value is not null and not isnan(value)")
    a, b = (known.select("feature", "pid", F.col("task").alias(f"task_{s}"), F.col("value").alias(f"x{s}")) for s in "ab")
    return spearman(a.join(b, ["feature", "pid"]).where("task_a < task_b"), ["feature", "task_a", "task_b"], "xa", "xb", least).withColumnRenamed("rho", "r")


def with_duration(rows: DataFrame, durations: DataFrame, least: int = LEAST) -> DataFrame:
    """task, target, feature, n, rho, rho_duration, partial, rate_normalised, sign_survives: correlations given the duration (pid, task, seconds)."""
    keys = ["task", "target", "feature"]
    joined = rows.join(durations.where("seconds is not null"), ["pid", "task"])
    part = partial_spearman(joined, keys, "x", "y", "seconds", least)
    return part.withColumn("rate_normalised", F.col("feature").contains("per_min")).withColumn("sign_survives", F.coalesce((F.signum("rho") == F.signum("partial")) & (F.abs("partial") > 1e-9), F.lit(False)))


def selection_cells(rows: DataFrame, taus: DataFrame, hits: DataFrame, permutations: int = 200, splits: int = 40, least: int = 12) -> DataFrame:
    """task, source, target cells that have hits: validated selection from all features of the source, with p and q within task and target.

    rows and hits carry a source column; a cell's matrix is participants by features.
    """
    keys = ["task", "source", "target"]
    kept = rows.join(hits.select(*keys).distinct(), keys, "left_semi")
    names = kept.groupBy(*keys).agg(F.array_sort(F.collect_set("feature")).alias("cols"))
    people = kept.groupBy(*keys, "pid").agg(F.first("y").alias("y"), F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("xs")).join(names, keys)
    each = cells(people.withColumn("x", F.transform("cols", lambda c: F.element_at("xs", c))), keys, ["x", "y"]).join(names, keys).join(taus, ["task", "target"])

    # a unit of work is a stretch of left-out participants of one shuffle; shuffle 0 is what was seen
    most = -(-256 // (permutations + 1))
    units = seeded(each, 77001, *keys).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    n, cost = F.size("rows"), F.size("rows").cast("double") ** 2 * F.size("cols") * splits
    units = units.withColumn("__u", F.least(n, F.lit(most), F.greatest(F.lit(1), F.ceil(cost / replicates.PART_ELEMENTS))).cast("int"))
    units = units.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("__u") - 1))).withColumn("first", F.floor(F.col("u") * n / F.col("__u")).cast("int")).withColumn("end", F.floor((F.col("u") + 1) * n / F.col("__u")).cast("int"))

    def kernel(own, tau, seed, k, first, end):
        x, y = own.matrix("x"), column(own, "y")
        ok = np.isfinite(y)
        # `first` and `end` count all participants, the selection those with a target
        first, end = int(ok[:first].sum()), int(ok[:end].sum())
        new, seed = models.shuffled(y[ok], int(seed), k)
        if len(new) < least:
            return {"y": new[first:end], "guess": None, "picks": None, "passed": None}
        guess, picks, passed = models.left_out_part(x[ok], new, float(tau), seed, first, end, splits, least)
        return {"y": new[first:end], "guess": guess, "picks": picks, "passed": passed}

    def whole(y, guess, picks, passed):
        if not len(guess):
            return {"values": {"n": float(len(y))}}
        got = models.left_out_summary(y, np.asarray(guess, float), picks, passed)
        top = got.pop("top")
        return {"values": finite(got | {f"top{k + 1}": float(j) for k, j in enumerate(top)})}

    found = replicates.mapped(replicates.dealt(units.drop("cols", "u", "__u")), kernel, ("rows", "tau", "seed", "k", "first", "end"), "y array<double>, guess array<double>, picks array<int>, passed array<int>")
    joined = F.array_sort(F.collect_list(F.struct("first", "y", "guess", "picks", "passed")))
    by_shuffle = found.groupBy(*keys, "k").agg(joined.alias("units"))
    flat = lambda c: F.flatten(F.transform("units", lambda u: F.coalesce(u[c], F.array().cast("array<double>" if c in ("y", "guess") else "array<int>")))).alias(c)
    each_k = replicates.mapped(by_shuffle.select(*keys, "k", *map(flat, ("y", "guess", "picks", "passed"))), whole, ("y", "guess", "picks", "passed"), "values map<string, double>")
    null = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.struct("k", F.col("values")["rho"].alias("rho"))))), lambda r: r["rho"])
    cell = each_k.groupBy(*keys).agg(F.max_by("values", -F.col("k")).alias("seen"), null.alias("null"))
    out = replicates.mapped(cell, lambda seen, null: {"values": dict(seen) | models.selection_p(dict(seen).get("rho", float("nan")), np.asarray(null, float))}, ("seen", "null"), "values map<string, double>").drop("seen").join(names, keys)
    name = lambda k: F.get("cols", F.col("values")[k].cast("int"))
    out = out.withColumn("selected", name("top1")).withColumn("second", name("top2")).withColumn("n_pool", F.size("cols"))
    return controlled(spread(out, ["n", "rho", "p", "null_med", "null_p95", "stage_frac", "npass_mean", "top1_frac"]).drop("cols"))


def ranked_hits(hits: DataFrame) -> DataFrame:
    """The hits that a ridge cell is made of: the best one of a single hit, else the best two, by q, then rho, stability and name."""
    cell = Window.partitionBy("task", "source", "target")
    order = cell.orderBy(F.col("q"), F.col("rho").desc(), F.col("stability").desc(), F.col("feature"))
    return hits.withColumn("k", F.row_number().over(order)).withColumn("n_hits", F.count("*").over(cell)).where("k <= case when n_hits = 1 then 1 else 2 end")


def ridge_cells(rows: DataFrame, hits: DataFrame, groups: DataFrame, permutations: int = 1000) -> DataFrame:
    """task, source, target cells: validated ridge on the best hits, p and q.  groups: pid, grp (`preterm` or other)."""
    keys = ["task", "source", "target"]
    best = ranked_hits(hits).select(*keys, "feature", "k")
    cols = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "feature"))).alias("cols"))
    people = rows.join(best, [*keys, "feature"]).groupBy(*keys, "pid").agg(F.first("y").alias("y"), F.array_sort(F.collect_list(F.struct("k", "x"))).alias("x"))
    complete = people.join(cols, keys).where("size(x) = size(cols)").join(groups, "pid", "left")
    each = cells(complete.withColumn("x", F.transform("x", lambda v: v["x"])).withColumn("grp", F.coalesce("grp", F.lit("other"))), keys, ["x", "y", "grp"]).join(cols, keys)

    def kernel(own, seed):
        return models.ridge_cell(own.matrix("x"), column(own, "y"), own.values("grp").astype(str), int(seed), permutations)

    out = by_cell(seeded(each, 51001, *keys), kernel, "rows", "seed").withColumn("selected", F.array_join(F.transform("cols", lambda c: c["feature"]), "|"))
    return controlled(spread(out, ["n", "n_splits", "n_repeats", "n_folds", "rho", "rho_sd", "rho_pos_frac", "rho_p025", "rho_p975", "p"]).drop("seed", "cols"))


def mann_whitney(rows: DataFrame, keys: list[str], x: str, flag: str) -> DataFrame:
    """keys, n1, n0, u (of the rows with flag 1), rank_biserial, ties and the two-sided p."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(flag).isNotNull()).withColumn("__r", avg_rank(x, *keys))
    tied = ranked.groupBy(*keys, x).agg(F.count("*").cast("double").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    one = F.col(flag) == 1
    sums = ranked.groupBy(*keys).agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n0"), F.sum(F.when(one, F.col("__r"))).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    both = sums.join(tied, keys).withColumn("u", u).withColumn("rank_biserial", F.try_divide(2 * F.col("u"), (F.col("n1") * F.col("n0")).cast("double")) - 1)
    tested = by_cell(both.where("n1 > 0 and n0 > 0"), lambda u, n1, n0, ties: {"p": special.mann_whitney_p(float(u), int(n1), int(n0), float(ties))}, "u", "n1", "n0", "ties")
    return spread(tested, ["p"]).drop("r1")


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, lo and n of values between low and high in equal bins; the last one holds its upper end."""
    width = (high - low) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(x) - low) / width)).cast("long")
    return df.where(F.col(x).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumn("lo", low + F.col("bin") * width)


def target_overlap(hits: DataFrame, targets: list[str]) -> DataFrame:
    """task, source, feature, n_targets, targets, and on_ and rho_ of each target; empty hits give an empty table of the same columns."""
    mine = lambda t, c: F.max(F.when(F.col("target") == t, c))
    out = hits.groupBy("task", "source", "feature").agg(
        F.count_distinct("target").alias("n_targets"), F.array_join(F.array_sort(F.collect_set("target")), "|").alias("targets"),
        *(F.coalesce(mine(t, F.lit(True)), F.lit(False)).alias(f"on_{t}") for t in targets), *(mine(t, F.col("rho")).alias(f"rho_{t}") for t in targets), F.max("n").alias("n"),
    )
    return out.orderBy(F.col("n_targets").desc(), "task", "source", "feature")


def sign_flips(hits: DataFrame) -> DataFrame:
    """feature, target, task_a (positive), task_b (negative): hits of opposite sign."""
    a, b = (hits.where(f"rho {sign} 0").select("feature", "target", F.col("task").alias(f"task_{s}"), F.col("rho").alias(f"rho_{s}")) for s, sign in (("a", ">"), ("b", "<")))
    return a.join(b, ["feature", "target"])


def contrast_report(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row that compares two runs: rows on either side, in both, only in one, and values that moved by more than the tolerance."""
    a, b = (df.select(*keys, F.col(value).alias(c)) for df, c in ((old, "a"), (new, "b")))
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), keys, "full_outer")
    moved = F.abs(F.col("b") - F.col("a")) > tolerance
    return both.agg(F.count("in_a").alias("n_old"), F.count("in_b").alias("n_new"), F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("n_both"), F.count_if(moved).alias("n_moved"), F.max(F.abs(F.col("b") - F.col("a"))).alias("largest_move"))
