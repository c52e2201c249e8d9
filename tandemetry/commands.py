"""Command lines: each reads tables, runs one part of the study and writes its result tables.

    python -m tandemetry extract --data-root D --cohort C --out O [--task-segments S] [--dynamics-only | --windows-only]
    python -m tandemetry screen --features F --windows W --labels L --cohort C --out O [--n-boot --n-null --n-perm --tasks --smoke]
    python -m tandemetry overlap --hits H --out O
    python -m tandemetry lopo | ridge --hits H --features F --windows W --labels L --cohort C --out O [--thresholds T --n-perm --n-boot --smoke]
    python -m tandemetry pairs | findings | verify --hits H --features F --windows W --labels L --cohort C --out O [...]
    python -m tandemetry compare --old O --new N --keys a,b --value v --out O

Result tables are CSV folders under --out, run records and thresholds JSON; --smoke takes few replicates.
"""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemetry.functions import dimension
from tandemetry.functions.staging import staged
from tandemetry.operators import extraction, recordings, screening
from tandemetry.sources import readers, writers

IDS = ("participant_id", "task_id")


def feature_rows(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """task, pid, feature, value of the catalog's columns of both feature tables, of the cohort and the asked tasks."""
    parts = []
    for path, required in ((args.features, dimension.FROZEN), (args.windows, ())):
        if path:
            table = readers.features(spark, path, required, IDS)
            columns = [c for c in table.columns if c in dimension.FROZEN or c.startswith(dimension.EXTRA_PREFIXES)]
            parts.append(table.unpivot(list(IDS), columns, "feature", "value"))
    rows = reduce(DataFrame.unionByName, parts).select(F.col("task_id").cast("int").alias("task"), F.col("participant_id").alias("pid"), "feature", "value")
    if args.tasks:
        rows = rows.where(F.col("task").isin([int(t) for t in args.tasks.split(",")]))
    return rows.join(F.broadcast(readers.cohort(spark, args.cohort).select("pid")), "pid", "left_semi")


def target_rows(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """pid, target, y of the label file."""
    labels = readers.labels(spark, args.labels, "ID")
    known = [F.struct(F.lit(t).alias("target"), F.col(f"`{c}`").try_cast("double").alias("y")) for t, c in dimension.TARGETS.items() if c in labels.columns]
    return labels.select(F.col("ID").alias("pid"), F.explode(F.array(*known)).alias("t")).select("pid", "t.*").where("y is not null")


def described(df: DataFrame) -> DataFrame:
    name = F.col("feature")
    return df.withColumn("source", dimension.source(name)).withColumn("family", dimension.family(name)).withColumn("asr_risky", dimension.asr_risky(name))


def hit_rows(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    raw = spark.read.option("header", True).csv(args.hits)
    kinds = {"task": "int", "n": "double", "rho": "double", "p": "double", "q": "double", "stability": "double"}
    return raw.select(*(F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns))


def observed(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return staged(screening.observed(feature_rows(spark, args), target_rows(spark, args)), "observed")


def extract(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    cohort = readers.cohort(spark, args.cohort).select("pid")
    segments = None
    if args.task_segments:
        told = readers.task_segments(spark, args.task_segments)
        readers.require_complete(cohort, told)
        segments = told.where("task is not null").select("pid", "task", "a", "b")
    sessions, failed = readers.readable_sessions(spark, f"{args.data_root}/*/*_multimodal_session_v1.json", recordings.SESSION, cohort)
    sessions = sessions.join(F.broadcast(cohort), "pid", "left_semi")
    out = {"failed": failed}
    if not args.windows_only:
        out["dynamics"] = extraction.dynamics(sessions, segments, min_task_sec=20.0).where("half = -1").drop("half").withColumnsRenamed({"pid": "participant_id", "task": "task_id"})
    if not args.dynamics_only:
        out["windows"] = extraction.windows_rows(sessions, segments).withColumnsRenamed({"pid": "participant_id", "task": "task_id"})
    return out


def screen(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    splits, shuffles, permutations = (10, 3, 50) if args.smoke else (args.n_boot, args.n_null, args.n_perm)
    rows = observed(spark, args)
    # the threshold is written before anything that was seen is looked at
    null = staged(screening.null_stabilities(rows, shuffles, splits), "null")
    taus = screening.thresholds(null)
    writers.thresholds(spark, {f"{r.target}:{r.task}": r.tau for r in taus.collect()}, f"{args.out}/thresholds")
    stage_a = staged(described(screening.candidates(screening.stabilities(rows, splits), taus)), "stage-a")
    tests = screening.permutation_tests(rows, stage_a.where("candidate"), permutations)
    stage_b = staged(screening.controlled(stage_a.where("candidate").join(tests, ["task", "target", "feature"])), "stage-b")
    return {"null_stability": null, "stage_a": stage_a, "candidates": stage_a.where("candidate"), "stage_b": stage_b, "hits_main": stage_b.where("fdr_sig")}


def overlap(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    every = screening.target_overlap(hit_rows(spark, args), list(dimension.TARGETS))
    return {"target_overlap": every, "target_overlap_multi": every.where("n_targets >= 2")}


def lopo(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    told = readers.thresholds(spark, args.thresholds)
    taus = spark.createDataFrame([(int(k.split(":")[1]), k.split(":")[0], float(v)) for k, v in told.items() if v is not None], "task int, target string, tau double")
    permutations, splits = (2, 5) if args.smoke else (args.n_perm or 200, args.n_boot or 40)
    cells = screening.selection_cells(described(observed(spark, args)), taus, hit_rows(spark, args), permutations, splits)
    return {"cells": cells.where("rho is not null"), "skipped": cells.where("rho is null")}


def ridge(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    groups = readers.groups(readers.cohort(spark, args.cohort).select("pid"), readers.labels(spark, args.labels, "ID"))
    cells = screening.ridge_cells(described(observed(spark, args)), hit_rows(spark, args), groups, 2 if args.smoke else args.n_perm or 1000)
    return {"cells": cells.where("rho is not null"), "skipped": cells.where("rho is null"), "selected_features": screening.ranked_hits(hit_rows(spark, args))}


def pairs(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    few = 200 if args.smoke else None
    rows, hits = observed(spark, args), hit_rows(spark, args)
    a, b = (hits.select("feature", "target", F.col("task").alias(f"task_{s}")) for s in "ab")
    both = a.join(b, ["feature", "target"]).where("task_a < task_b")
    flips = screening.sign_flips(hits)
    contrasts = staged(screening.pair_contrasts(rows, both, few or args.n_boot_pair), "contrasts")
    return {"pairs": contrasts, "signflip": flips.join(contrasts.drop("rho_a", "rho_b"), ["feature", "target", "task_a", "task_b"], "left"), "families": screening.families(rows, few or args.n_boot_q), "pool_verify": screening.pool_checks(rows, flips, few or args.n_boot_verify)}


def verify(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    flips = screening.sign_flips(hit_rows(spark, args))
    return {"pool_verify": screening.pool_checks(observed(spark, args), flips, 200 if args.smoke else args.n_boot_verify)}


def findings(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    features, rows = feature_rows(spark, args), observed(spark, args)
    seconds = readers.features(spark, args.windows, ["new_duration_sec"], IDS).select(F.col("participant_id").alias("pid"), F.col("task_id").cast("int").alias("task"), F.col("new_duration_sec").alias("seconds"))
    r = screening.task_correlations(features)
    ranked = r.groupBy("feature").agg(F.percentile("r", F.lit(0.5)).alias("median_r"), F.count("r").alias("n_pairs"))
    summary = seconds.groupBy("task").agg(F.count("seconds").alias("n"), F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("sd"), F.min("seconds").alias("min"), F.percentile("seconds", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.max("seconds").alias("max"))
    quartiles = summary.select("task", "n", "mean", "sd", "min", *(F.col("q")[k].alias(n) for k, n in enumerate(("q25", "median", "q75"))), "max")
    return {"r_all_pairs": r, "r_by_feature": ranked, "duration": quartiles, "duration_partial": screening.with_duration(rows, seconds), "maxstat": screening.largest_contrasts(rows, hit_rows(spark, args), 200 if args.smoke else args.n_boot_maxstat)}


def compare(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    old, new = (spark.read.option("header", True).option("inferSchema", True).csv(p) for p in (args.old, args.new))
    return {"compare": screening.contrast_report(old, new, args.keys.split(","), args.value)}


COMMANDS = {f.__name__: f for f in (extract, screen, overlap, lopo, ridge, pairs, verify, findings, compare)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tandemetry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=COMMANDS)
    for name in ("data-root", "cohort", "task-segments", "features", "windows", "labels", "hits", "thresholds", "tasks", "old", "new", "keys", "value"):
        p.add_argument(f"--{name}")
    p.add_argument("--out", required=True)
    for name in ("dynamics-only", "windows-only", "smoke"):
        p.add_argument(f"--{name}", action="store_true")
    for name, default in (("n-boot", 200), ("n-null", 50), ("n-perm", None), ("n-boot-pair", 4999), ("n-boot-q", 9999), ("n-boot-verify", 2000), ("n-boot-maxstat", 4999)):
        p.add_argument(f"--{name}", type=int, default=default)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "screen" and args.n_perm is None:
        args.n_perm = 1000
    if args.command == "lopo" and args.n_boot == 200:
        args.n_boot = 40
    spark = spark or SparkSession.builder.appName("tandemetry").getOrCreate()
    began = time.time()
    for name, table in COMMANDS[args.command](spark, args).items():
        writers.table(table, f"{args.out}/{name}")
    writers.record(spark, {"command": args.command, "options": vars(args), "seconds": time.time() - began}, f"{args.out}/run_meta")
