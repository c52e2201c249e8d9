"""Coupling of the two persons' motion and head rotation, as long rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemetry.functions import kernels
from tandemetry.functions.staging import staged
from tandemetry.functions.stats import safe_corr
from tandemetry.operators import kinematics
from tandemetry.operators.features import CELL, by_kernel, from_map, grouped, long, runs

KEYS = [*CELL, "signal"]


def paired_motion(moved: DataFrame) -> DataFrame:
    """cell, slot, a (child), b (examiner): motion of both where both are known, of kinematics.joints."""
    energy = kinematics.motion(moved).where("q is not null")
    sides = energy.groupBy(*CELL, "slot").agg(*(F.max(F.when(F.col("role") == role, F.col("q"))).alias(c) for role, c in (("child", "a"), ("examiner", "b"))))
    return sides.where("a is not null and b is not null")


def paired_angles(rows: DataFrame) -> DataFrame:
    """cell, signal, slot, a, b: yaw and pitch of both, in frames with both faces in their places."""
    seen = rows.where("face_ok and not swap").select(*CELL, "slot", "role", F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.col(k).alias("x")) for k in ("yaw", "pitch")))).alias("s")).select(*CELL, "slot", "role", "s.*").where("x is not null")
    sides = seen.groupBy(*KEYS, "slot").agg(*(F.max(F.when(F.col("role") == role, F.col("x"))).alias(c) for role, c in (("child", "a"), ("examiner", "b"))))
    return sides.where("a is not null and b is not null")


def _arrays(found) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(r["a"], float), np.asarray(r["b"], float)) for r in found]


def _in_time(found) -> dict[str, float]:
    return kernels.windowed_sync(_arrays(sorted(found, key=lambda r: r["slot"][0])))


def share(pairs: DataFrame) -> DataFrame:
    """The child's share of both persons' motion, and their correlation, of more than 64 frames."""
    enough = lambda v: F.when(F.count("*") > 64, v)
    values = {"motion_share_child": enough(F.try_divide(F.sum("a"), F.sum("a") + F.sum("b"))), "motion_corr": enough(safe_corr("a", "b"))}
    return long(grouped(pairs, list(CELL), values), list(values), F.lit("dyad"))


def features(rows: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """Windowed synchrony, recurrence and shares of each cell."""
    moved = paired_motion(kinematics.joints(rows) if moved is None else moved)
    every = moved.withColumn("signal", F.lit("motion")).select(*KEYS, "slot", "a", "b").union(paired_angles(rows).select(*KEYS, "slot", "a", "b"))
    every, moved = staged(every, "pairs"), staged(moved, "paired-motion")
    prefix = F.concat(F.lit("dyad_"), "signal")
    windows = by_kernel(runs(every, KEYS, ["slot", "a", "b"], kernels.WINDOW), "runs", _in_time)
    recurring = by_kernel(runs(every.where("signal <> 'pitch'"), KEYS, ["a", "b"], 120, 8), "runs", lambda found: kernels.pooled_recurrence(_arrays(found)))
    return from_map(windows, prefix).union(from_map(recurring, prefix)).union(share(moved))
