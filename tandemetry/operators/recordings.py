"""Recordings of two persons as relations: frames, regular series, task spans and the cells that features are made of.

Everything is keyed by pid, so one shuffle by pid serves a whole recording, and no group is larger than one recording.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemetry.operators import intervals

ROLES = ("child", "examiner")
# Tracked joints, grid and quality limits of the recordings.
JOINTS = ("nose", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist")
ANGLES = ("yaw", "pitch", "roll")
STEP = 0.25
TAU = 0.25
SHOULDER_PX = 15.0
JUMP_DEG = 120.0
SCALE_HALF = 60

SESSION = (
    "timeline array<struct<time_sec: double, face: array<struct<role: string, role_confidence: double, det_score: double, bbox: array<double>, mar: double, head_pose: struct<pitch: double, yaw: double, roll: double>>>,"
    " pose: array<struct<role: string, pose_quality: double, keypoints_px: map<string, struct<x: double, y: double, visibility: double>>, events: array<struct<type: string>>>>>>,"
    " speech_segments array<struct<start: double, end: double, text: string, speaker: string, words: array<struct<start: double>>>>,"
    " task_segments array<struct<task_id: int, session_start_sec: double, session_end_sec: double>>"
)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def picked(items: Column, role: str) -> Column:
    """The first element of a list that has the role."""
    return F.get(F.filter(items, lambda x: x["role"] == role), 0)


def face_ok(face: Column) -> Column:
    return F.coalesce(clip01(face["det_score"]) * clip01(face["role_confidence"]) >= TAU, F.lit(False))


def shoulder_width(pose: Column) -> Column:
    left, right = (pose["keypoints_px"][f"{side}_shoulder"] for side in ("left", "right"))
    return F.hypot(left["x"] - right["x"], left["y"] - right["y"])


def pose_ok(pose: Column) -> Column:
    """Quality, both shoulders, and a width that no failed detection has."""
    return F.coalesce((F.coalesce(pose["pose_quality"], F.lit(0.0)) >= TAU) & (finite(shoulder_width(pose)) >= SHOULDER_PX), F.lit(False))


def joint(pose: Column, name: str) -> Column:
    """x and y of a joint that is seen, else null."""
    found = pose["keypoints_px"][name]
    return F.when(F.coalesce(found["visibility"], F.lit(1.0)) > 0, F.struct(finite(found["x"]).alias("x"), finite(found["y"]).alias("y")))


def center(box: Column) -> Column:
    """Centre of a box (x1, y1, x2, y2), null if it lacks a finite corner."""
    corners = [finite(F.get(box, k)) for k in range(4)]
    known = reduce(lambda a, b: a & b, (c.isNotNull() for c in corners))
    return F.when(known, F.struct(((corners[0] + corners[2]) / 2).alias("x"), ((corners[1] + corners[3]) / 2).alias("y")))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def swapped(child: Column, examiner: Column, child_before: Column, examiner_before: Column) -> Column:
    """Whether two persons changed places since the frame before; false where a centre is missing."""
    same = distance(child, child_before) + distance(examiner, examiner_before)
    crossed = distance(child, examiner_before) + distance(examiner, child_before)
    return F.coalesce(crossed + 1e-6 < same, F.lit(False))


def frames(sessions: DataFrame) -> DataFrame:
    """pid, idx, t, slot, n_slots, both_face, swap, and a face and a pose for each role, one row a frame on the grid."""
    each = sessions.select("pid", F.posexplode("timeline").alias("idx", "f")).select("pid", "idx", F.col("f.time_sec").alias("t"), *(picked(F.col(f"f.{part}"), role).alias(f"{role}_{part}") for role in ROLES for part in ("face", "pose")))
    every = Window.partitionBy("pid")
    first, last = F.min_by("t", "idx").over(every), F.max_by("t", "idx").over(every)
    n = F.rint((last - first) / STEP).cast("int") + 1
    placed = each.withColumn("t0", first).withColumn("n_slots", n).withColumn("slot", F.rint((F.col("t") - F.col("t0")) / STEP).cast("int")).where("slot >= 0 and slot < n_slots")
    order = Window.partitionBy("pid").orderBy("idx")
    pair = face_ok(F.col("child_face")) & face_ok(F.col("examiner_face"))
    centred = placed.withColumn("both_face", pair).withColumn("c", center(F.col("child_face.bbox"))).withColumn("e", center(F.col("examiner_face.bbox")))
    follows = F.coalesce(F.lag("both_face").over(order), F.lit(False)) & F.col("both_face")
    swap = follows & swapped(F.col("c"), F.col("e"), F.lag("c").over(order), F.lag("e").over(order))
    return centred.withColumn("swap", swap).drop("c", "e")


def series(framed: DataFrame) -> DataFrame:
    """One row a slot and role of the complete grid: pid, role, slot, t, angles, mar, joints, scale, face_ok, pose_ok, both_face, swap, jumps.

    The last valid frame of a slot wins; angles after an impossible jump are blanked and counted in jumps.
    """
    sides = framed.select("pid", "idx", "slot", F.explode(F.array(*(F.struct(F.lit(role).alias("role"), F.col(f"{role}_face").alias("face"), F.col(f"{role}_pose").alias("pose")) for role in ROLES))).alias("s")).select("pid", "idx", "slot", "s.*")
    seen, stood = F.when(face_ok(F.col("face")), F.col("idx")), F.when(pose_ok(F.col("pose")), F.col("idx"))
    told = [F.max_by(finite(F.col(f"face.head_pose.{a}")), seen).alias(a) for a in ANGLES] + [F.max_by(finite(F.col("face.mar")), seen).alias("mar")]
    joints = [F.max_by(joint(F.col("pose"), k), F.when(stood.isNotNull() & joint(F.col("pose"), k).isNotNull(), F.col("idx"))).alias(k) for k in JOINTS]
    held = sides.groupBy("pid", "role", "slot").agg(*told, *joints, F.max(seen).isNotNull().alias("face_ok"), F.max(stood).isNotNull().alias("pose_ok"))
    both = framed.groupBy("pid", "slot").agg(F.max_by("both_face", "idx").alias("both_face"), F.max_by("swap", "idx").alias("swap"))
    grid = framed.groupBy("pid").agg(F.first("t0").alias("t0"), F.first("n_slots").alias("n")).select("pid", "t0", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot")).select("*", F.explode(F.array(*map(F.lit, ROLES))).alias("role"))
    full = grid.join(held, ["pid", "role", "slot"], "left").join(both, ["pid", "slot"], "left").withColumn("t", F.col("t0") + STEP * F.col("slot")).drop("t0")
    full = full.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("face_ok", "pose_ok", "both_face", "swap")})
    return scaled(blanked(full))


def blanked(grid: DataFrame) -> DataFrame:
    """Angles whose change from the slot before is impossible become null; `jumps` tells which; pitch_d is the change of pitch that is left."""
    order = Window.partitionBy("pid", "role").orderBy("slot")
    bad = {a: F.coalesce(F.abs(F.col(a) - F.lag(a).over(order)) > JUMP_DEG, F.lit(False)) for a in ANGLES}
    marked = grid.withColumns({f"__{a}": b for a, b in bad.items()})
    cleaned = marked.withColumns({a: F.when(~F.col(f"__{a}"), F.col(a)) for a in ANGLES})
    return cleaned.withColumn("jumps", F.struct(*(F.col(f"__{a}").alias(a) for a in ANGLES))).drop(*(f"__{a}" for a in ANGLES)).withColumn("pitch_d", F.col("pitch") - F.lag("pitch").over(order))


def scaled(grid: DataFrame, half: int = SCALE_HALF) -> DataFrame:
    """Adds raw_scale, the shoulder width in pixels, and scale, its median within `half` slots (of at least three, else of all)."""
    width = F.hypot(F.col("left_shoulder.x") - F.col("right_shoulder.x"), F.col("left_shoulder.y") - F.col("right_shoulder.y"))
    raw = grid.withColumn("raw_scale", F.when(width >= SHOULDER_PX, width))
    every = Window.partitionBy("pid", "role")
    near = every.orderBy("slot").rowsBetween(-half, half)
    median = F.percentile("raw_scale", F.lit(0.5))
    return raw.withColumn("scale", F.when(F.count("raw_scale").over(near) >= 3, median.over(near)).otherwise(median.over(every)))


def normalised(name: str) -> tuple[Column, Column]:
    """x and y of a joint in shoulder widths."""
    return F.try_divide(F.col(f"{name}.x"), F.col("scale")), F.try_divide(F.col(f"{name}.y"), F.col("scale"))


def utterances(sessions: DataFrame) -> DataFrame:
    """pid, speaker, a, b, text and words (start times) of every speech segment."""
    said = sessions.select("pid", F.posexplode("speech_segments").alias("n", "s"))
    return said.select("pid", "n", F.col("s.speaker").alias("speaker"), F.col("s.start").alias("a"), F.col("s.end").alias("b"), F.coalesce("s.text", F.lit("")).alias("text"), F.coalesce("s.words.start", F.array().cast("array<double>")).alias("words"))


def own_spans(sessions: DataFrame) -> DataFrame:
    """pid, task, a, b of the segments inside session documents."""
    return sessions.select("pid", F.inline("task_segments")).select("pid", F.col("task_id").alias("task"), F.col("session_start_sec").alias("a"), F.col("session_end_sec").alias("b")).where("a is not null and b is not null")


def diagnostics(series_rows: DataFrame) -> DataFrame:
    """pid, role, scale_px (median shoulder width) and angle_jump_frac (mean share of blanked values of the angles)."""
    shares = [F.try_divide(F.sum(F.col(f"jumps.{a}").cast("double")), F.nullif(F.count(a), F.lit(0)).cast("double")).alias(a) for a in ANGLES]
    found = series_rows.groupBy("pid", "role").agg(F.percentile("raw_scale", F.lit(0.5)).alias("scale_px"), *shares)
    known = F.array_compact(F.array(*ANGLES))
    return found.select("pid", "role", "scale_px", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)).alias("angle_jump_frac"))


def mask(slots: DataFrame, spans: DataFrame) -> DataFrame:
    """pid, task, slot, t of the slots whose time lies in a span: a <= t < b."""
    return intervals.points_in_spans(slots.select("pid", "slot", "t"), spans, ["pid"], bucket=60.0).select("pid", "task", "slot", "t").distinct()


def halved(masked: DataFrame, least: int = 8) -> DataFrame:
    """The mask with `half` 0 or 1, cut at its middle slot; cells of fewer slots go."""
    cell = Window.partitionBy("pid", "task")
    numbered = masked.withColumn("n", F.count("*").over(cell)).withColumn("i", F.row_number().over(cell.orderBy("slot")) - 1)
    return numbered.where(F.col("n") >= least).withColumn("half", (F.col("i") >= F.floor(F.col("n") / 2)).cast("int")).drop("n", "i")


def mask_spans(masked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b: runs of consecutive slots as spans, from the first slot's time to the end of the last."""
    runs = intervals.contiguous_runs(masked.withColumn("on", F.lit(True)), keys, "slot", "on")
    starts = masked.select(*keys, F.col("slot").alias("first"), F.col("t").alias("a"))
    ends = masked.select(*keys, F.col("slot").alias("last"), (F.col("t") + STEP).alias("b"))
    return runs.join(starts, [*keys, "first"]).join(ends, [*keys, "last"]).select(*keys, "a", "b")


SESSION_TASK = -1


def cells(slots: DataFrame, segments: DataFrame, mode: str = "tasks", min_task_sec: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(pid, task, half, slot, t), (pid, task, half, a, b): the frames and the spans that one row of features is made of.

    mode: `tasks`, a row a task that lasts min_task_sec, half -1; `halves`, two rows a task; `session`, one row of all
    annotated time, task -1; `session_halves`, two rows of the first and of the second halves of all tasks.
    """
    if mode == "session":
        spans = intervals.union_spans(segments, ["pid"]).withColumn("task", F.lit(SESSION_TASK))
    else:
        spans = intervals.union_spans(segments, ["pid", "task"])
    masked = mask(slots, spans)
    if mode != "session":
        masked = masked.withColumn("__n", F.count("*").over(Window.partitionBy("pid", "task"))).where(F.col("__n") * STEP >= min_task_sec).drop("__n")
    if mode in ("tasks", "session"):
        kept = masked.select("pid", "task").distinct()
        return masked.withColumn("half", F.lit(-1)).select("pid", "task", "half", "slot", "t"), spans.join(kept, ["pid", "task"], "left_semi").select("pid", "task", F.lit(-1).alias("half"), "a", "b")
    if mode not in ("halves", "session_halves"):
        raise ValueError(f"no such mode: {mode}")
    parts = halved(masked)
    if mode == "session_halves":
        parts = parts.withColumn("task", F.lit(SESSION_TASK)).distinct()
    parts = parts.select("pid", "task", "half", "slot", "t")
    return parts, mask_spans(parts, ["pid", "task", "half"])


def frame_quality(cell_slots: DataFrame, series_rows: DataFrame) -> DataFrame:
    """A row a cell: frames, seconds and shares of frames with a valid face or pose of each role, with both faces and with a change of places."""
    rows = cell_slots.join(series_rows, ["pid", "slot"])
    share = lambda c, role: F.avg(F.when(F.col("role") == role, F.col(c).cast("double"))).alias(f"{role}_{c}_frac")
    n = F.count_if(F.col("role") == ROLES[0])
    return rows.groupBy("pid", "task", "half").agg(
        n.cast("double").alias("n_frames"), (n * STEP).alias("duration_sec"), *(share(c, role) for c in ("face_ok", "pose_ok") for role in ROLES),
        F.avg(F.col("both_face").cast("double")).alias("both_face_frac"), F.avg(F.col("swap").cast("double")).alias("role_swap_frac"),
    )
