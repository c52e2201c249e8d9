"""Features of head and body motion, per cell and role, as long rows.

Input rows are those of recordings.series joined to a cell's slots: differences exist only between neighbouring slots
that are both in the cell and valid, so a gap or a cell's edge never yields one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemetry.functions import kernels
from tandemetry.functions.staging import staged
from tandemetry.operators import intervals
from tandemetry.operators.features import CELL, by_kernel, five, from_map, grouped, long, named, runs
from tandemetry.operators.recordings import ANGLES, STEP, normalised

# Joints whose motion counts, those that span the body, and limits.
MOVING = ("nose", "left_wrist", "right_wrist", "left_elbow", "right_elbow")
SPANNING = ("left_shoulder", "right_shoulder", "left_wrist", "right_wrist", "nose")
STILL, BURST = 0.20, 1.00
LEAST_MINUTES = 0.05


def since(x: str | Column, order, step: int = 1) -> Column:
    """Change since the neighbouring slot; null beside a gap."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.col("slot") - F.lag("slot").over(order) == step, x - F.lag(x).over(order))


def minutes(rows: DataFrame, valid: str) -> DataFrame:
    """cell, role, frames and minutes of valid slots, of the cells with enough of them."""
    return rows.where(valid).groupBy(*CELL, "role").agg(F.count("*").alias("frames")).withColumn("minutes", F.col("frames") * STEP / 60).where(F.col("minutes") > LEAST_MINUTES)


def timed(rows: DataFrame, valid: str) -> DataFrame:
    """The valid slots of the cells with enough of them, with the cell's frames and minutes: by windows, so rows that are together by pid stay where they are."""
    kept = rows.where(valid).withColumn("frames", F.count("*").over(Window.partitionBy(*CELL, "role")))
    return kept.withColumn("minutes", F.col("frames") * STEP / 60).where(F.col("minutes") > LEAST_MINUTES)


def angles(rows: DataFrame, *more: str) -> DataFrame:
    """cell, role, signal, slot, x, d, dd of valid angles, and more columns; signals of fewer than 8 values go."""
    each = rows.where("face_ok").select(*CELL, "role", "slot", *more, F.explode(F.array(*(F.struct(F.lit(a).alias("signal"), F.col(a).alias("x")) for a in ANGLES))).alias("s")).select(*CELL, "role", "slot", *more, "s.*").where("x is not null")
    keys = Window.partitionBy(*CELL, "role", "signal")
    kept = each.withColumn("n", F.count("*").over(keys)).where("n >= 8").drop("n")
    first = kept.withColumn("d", since("x", keys.orderBy("slot")))
    return first.withColumn("dd", since("d", keys.orderBy("slot")))


def reversals(rows: DataFrame, keys: list[str], d: str = "d", least: int = 9) -> DataFrame:
    """keys, reversal_rate: changes of sign a second between successive differences, over gaps; null for fewer than `least`."""
    signs = rows.where(F.col(d).isNotNull()).withColumn("s", F.signum(d)).withColumn("before", F.lag("s").over(Window.partitionBy(*keys).orderBy("slot")))
    turned = F.avg(F.when(F.col("before").isNotNull(), (F.col("s") != F.col("before")).cast("double"))) / STEP
    return signs.groupBy(*keys).agg(F.when(F.count("*") >= least, turned).alias("reversal_rate"))


def head(rows: DataFrame) -> DataFrame:
    """Displacement, speed, reversals and predictability of head rotation."""
    turned = staged(turning(rows), "angles")
    return rotation(turned).union(turn_reversals(turned)).union(entropies(turned))


def turning(rows: DataFrame) -> DataFrame:
    """angles with the minutes of valid faces."""
    return angles(timed(rows, "face_ok"), "frames", "minutes")


def _signal() -> Column:
    return F.concat_ws("_", "role", "signal")


def rotation(turned: DataFrame) -> DataFrame:
    """Spread, range, speed, acceleration and rotation of each angle, and the speed of all three together."""
    keys = [*CELL, "role", "signal"]
    ends = F.percentile("x", F.array(F.lit(0.05), F.lit(0.95)))
    values = {"rms_disp": F.stddev_pop("x"), "range": ends[1] - ends[0], "rot_per_min": F.coalesce(F.sum(F.abs("d")), F.lit(0.0)) / F.first("minutes")}
    values |= named("angvel", five(F.abs("d") / STEP)) | named("angacc", five(F.abs("dd") / STEP**2))
    out = long(grouped(turned, keys, values), list(values), _signal())
    every = turned.groupBy(*CELL, "role", "slot").agg(F.count("d").alias("n"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("v"))
    bundle = named("head_speed", five(F.when(F.col("n") == len(ANGLES), F.col("v") / STEP)))
    return out.union(long(grouped(every, [*CELL, "role"], bundle), list(bundle), F.col("role")))


def turn_reversals(turned: DataFrame) -> DataFrame:
    return long(reversals(turned, [*CELL, "role", "signal"]), ["reversal_rate"], _signal())


def entropies(turned: DataFrame) -> DataFrame:
    """Multiscale entropy of yaw and pitch over the six longest runs of at least 48 slots."""
    stretches = runs(turned.where("signal in ('yaw', 'pitch')"), [*CELL, "role", "signal"], ["x"], 48, 6)
    return from_map(by_kernel(stretches, "runs", _entropies), _signal())


def _entropies(found) -> dict[str, float]:
    got = kernels.multiscale_entropy([np.asarray(r["x"], float) for r in found])
    known = [v for v in got if np.isfinite(v)]
    return {f"sampen_s{k + 1}": v for k, v in enumerate(got)} | ({"mse_slope": known[-1] - known[0]} if len(known) >= 2 else {})


def joints(rows: DataFrame, *more: str) -> DataFrame:
    """cell, role, joint, slot, v (speed in shoulder widths a second) and acc of moving joints in valid poses, and more columns."""
    each = F.array(*(F.struct(F.lit(k).alias("joint"), normalised(k)[0].alias("x"), normalised(k)[1].alias("y")) for k in MOVING))
    placed = rows.where("pose_ok").select(*CELL, "role", "slot", *more, F.explode(each).alias("j")).select(*CELL, "role", "slot", *more, "j.*")
    order = Window.partitionBy(*CELL, "role", "joint").orderBy("slot")
    fast = placed.withColumn("v", F.hypot(since("x", order), since("y", order)) / STEP)
    return fast.withColumn("acc", F.abs(since("v", order)) / STEP)


def motion(moved: DataFrame, *more: str) -> DataFrame:
    """cell, role, slot, q: the mean speed of the joints that have one, and more columns."""
    return moved.groupBy(*CELL, "role", "slot").agg(F.avg("v").alias("q"), *(F.first(c).alias(c) for c in more))


def bursts(energy: DataFrame) -> DataFrame:
    """Shares of still and of fast frames, and runs of fast ones, on the motion that is known, gaps closed.  A run begins where the known frame before is not fast."""
    keys = [*CELL, "role"]
    fast = F.col("q") >= BURST
    known = energy.where("q is not null").withColumn("fresh", fast & ~F.coalesce(F.lag(fast).over(Window.partitionBy(*keys).orderBy("slot")), F.lit(False)))
    shares = known.groupBy(*keys).agg(F.count("*").alias("n"), F.first("minutes").alias("minutes"), F.avg((F.col("q") < STILL).cast("double")).alias("still_frac"), F.avg(fast.cast("double")).alias("burst_frac"), F.count_if("fresh").alias("bursts"), F.count_if(fast).alias("held")).where("n > 16")
    length = F.coalesce(F.try_divide(F.col("held").cast("double"), F.col("bursts").cast("double")), F.lit(0.0))
    return shares.select(*keys, "still_frac", "burst_frac", (F.col("bursts") / F.col("minutes")).alias("burst_rate_per_min"), (length * STEP).alias("burst_dur_mean"))


def body(rows: DataFrame) -> DataFrame:
    """Speed and path of joints, quantity and spectrum of motion, bursts, asymmetry and posture."""
    kept = timed(rows, "pose_ok")
    moved = joints(kept, "frames", "minutes")
    energy = staged(motion(moved, "minutes"), "motion")
    return joint_speeds(kept, moved).union(quantity(energy)).union(spectra(energy)).union(posture(kept))


def energy_of(rows: DataFrame) -> DataFrame:
    """motion of the cells with enough minutes, and these."""
    return motion(joints(timed(rows, "pose_ok"), "minutes"), "minutes")


def joint_speeds(kept: DataFrame, moved: DataFrame) -> DataFrame:
    """Speed, acceleration and path of joints, asymmetry of the wrists and frames with a pose, of timed rows and their joints."""
    keys, role = [*CELL, "role"], F.col("role")
    out = long(kept.groupBy(*keys).agg(F.first("frames").alias("pose_frames")), ["pose_frames"], role)
    path = F.coalesce(F.sum("v"), F.lit(0.0)) * STEP / F.first("minutes")
    values = named("speed", five(F.col("v"))) | {"path_per_min": path} | named("accel", five(F.col("acc")))
    out = out.union(long(grouped(moved, [*keys, "joint"], values), list(values), F.concat_ws("_", "role", "joint")))
    left, right = (F.coalesce(F.sum(F.when(F.col("joint") == k, F.col("v"))), F.lit(0.0)) for k in ("left_wrist", "right_wrist"))
    return out.union(long(grouped(moved, keys, {"wrist_asym": F.when(left + right > 0, F.abs(left - right) / F.nullif(left + right, F.lit(0.0)))}), ["wrist_asym"], role))


def quantity(energy: DataFrame) -> DataFrame:
    """Quantity of motion and its bursts."""
    values = named("qom", five(F.col("q"))) | {"qom_per_min": F.coalesce(F.sum("q"), F.lit(0.0)) * STEP / F.first("minutes")}
    out = long(grouped(energy, [*CELL, "role"], values), list(values), F.col("role"))
    return out.union(long(bursts(energy), ["still_frac", "burst_frac", "burst_rate_per_min", "burst_dur_mean"], F.col("role")))


def spectra(energy: DataFrame) -> DataFrame:
    """Spectrum and entropy of the longest run of motion."""
    keys = [*CELL, "role"]
    enough = energy.where("q is not null").withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 16")
    return from_map(by_kernel(runs(enough, keys, ["q"], 64, 1), "runs", _spectra), F.col("role"))


def _spectra(found) -> dict[str, float]:
    y = np.asarray(found[0]["q"], float)
    return kernels.spectrum(y) | {"qom_sampen": kernels.sample_entropy(y[:2000])}


def posture(rows: DataFrame) -> DataFrame:
    """Area that the upper body spans, and drift of the nose, of more than 16 complete frames."""
    xs, ys = zip(*(normalised(k) for k in SPANNING), strict=True)
    complete = F.array_size(F.array_compact(F.array(*xs, *ys))) == 2 * len(SPANNING)
    area = F.when(complete, (F.greatest(*xs) - F.least(*xs)) * (F.greatest(*ys) - F.least(*ys)))
    x, y = normalised("nose")
    held = rows.where("pose_ok").select(*CELL, "role", area.alias("area"), F.when(y.isNotNull(), x).alias("x"), F.when(x.isNotNull(), y).alias("y"))
    gate = lambda c, v: F.when(F.count(c) > 16, v)
    values = {"contraction_mean": gate("area", F.avg("area")), "contraction_sd": gate("area", F.stddev_pop("area")), "sway_x": gate("x", F.stddev_pop("x")), "sway_y": gate("y", F.stddev_pop("y"))}
    return long(grouped(held, [*CELL, "role"], values), list(values), F.col("role"))
