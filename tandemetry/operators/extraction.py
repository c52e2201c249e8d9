"""Entry point of feature extraction: recordings and annotated segments in, one row of features a cell out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemetry.functions.staging import staged
from tandemetry.operators import conversation, kinematics, recordings, synchrony, windows
from tandemetry.operators.features import CELL, wide


def long_dynamics(series_rows: DataFrame, utterances: DataFrame, segments: DataFrame, mode: str = "tasks", min_task_sec: float = 30.0) -> DataFrame:
    """pid, task, half, feature, value of head, body, synchrony, conversation and floor features."""
    slots = series_rows.where(F.col("role") == recordings.ROLES[0]).select("pid", "slot", "t")
    return _families(*recordings.cells(slots, segments, mode, min_task_sec), series_rows, utterances)


def _families(cell_slots: DataFrame, spans: DataFrame, series_rows: DataFrame, utterances: DataFrame) -> DataFrame:
    """All families over the cells; what several of them read is written once."""
    rows = staged(cell_slots.drop("t").join(series_rows, ["pid", "slot"]), "cell-rows")
    moved = staged(kinematics.joints(rows), "joints")
    found = [kinematics.head(rows), kinematics.body(rows), synchrony.features(rows, moved), conversation.features(utterances, spans), conversation.crossmodal(rows, utterances, moved)]
    return reduce(DataFrame.union, [staged(df, "features") for df in found])


def _segments(sessions: DataFrame, segments: DataFrame | None) -> DataFrame:
    """The given segments of participants who have a session, else those of the documents."""
    return recordings.own_spans(sessions) if segments is None else segments.join(sessions.select("pid"), "pid", "left_semi")


def dynamics(sessions: DataFrame, segments: DataFrame | None = None, mode: str = "tasks", min_task_sec: float = 30.0, names: list[str] | None = None) -> DataFrame:
    """One row a cell: quality of the frames, then features by name.  segments (pid, task, a, b) replace those of the documents."""
    segments = _segments(sessions, segments)
    series_rows = staged(recordings.series(recordings.frames(sessions)), "series")
    slots = series_rows.where(F.col("role") == recordings.ROLES[0]).select("pid", "slot", "t")
    cell_slots, spans = (staged(df, "cells") for df in recordings.cells(slots, segments, mode, min_task_sec))
    quality = recordings.frame_quality(cell_slots, series_rows)
    per_role = recordings.diagnostics(series_rows).groupBy("pid").agg(*(F.max(F.when(F.col("role") == r, F.col("scale_px"))).alias(f"{r}_scale_px") for r in recordings.ROLES), F.avg("angle_jump_frac").alias("angle_jump_frac"))
    counted = spans.groupBy(*CELL).agg(F.count("*").cast("double").alias("n_task_spans"))
    rows = wide(_families(cell_slots, spans, series_rows, staged(recordings.utterances(sessions), "utterances")), names or dynamics_names())
    return quality.join(per_role, "pid").join(counted, list(CELL), "left").join(rows, list(CELL), "left")


def windows_rows(sessions: DataFrame, segments: DataFrame | None = None, words: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """One row an activity of halves, gestures, replies and texts."""
    segments = _segments(sessions, segments)
    framed = staged(recordings.frames(sessions).select("pid", "idx", "t", *(f"{r}_{part}" for r in recordings.ROLES for part in ("face", "pose"))), "frames")
    found = windows.features(framed, staged(recordings.utterances(sessions), "utterances"), segments, words)
    return wide(found, windows_names(words), ("pid", "task"))


FIVE, FOUR = ("mean", "rms", "med", "p90", "iqr"), ("med", "mean", "iqr", "p90")


def _each(prefix: str, stats: tuple[str, ...]) -> list[str]:
    return [f"{prefix}_{s}" for s in stats]


def dynamics_names() -> list[str]:
    """The features of a cell in a fixed order."""
    out: list[str] = []
    for r in recordings.ROLES:
        for a in recordings.ANGLES:
            out += [f"{r}_{a}_rms_disp", f"{r}_{a}_range", *_each(f"{r}_{a}_angvel", FIVE), f"{r}_{a}_rot_per_min", *_each(f"{r}_{a}_angacc", FIVE), f"{r}_{a}_reversal_rate"]
        out += _each(f"{r}_head_speed", FIVE)
        for a in ("yaw", "pitch"):
            out += [f"{r}_{a}_sampen_s{k}" for k in (1, 2, 3)] + [f"{r}_{a}_mse_slope"]
        out.append(f"{r}_pose_frames")
        for k in kinematics.MOVING:
            out += [*_each(f"{r}_{k}_speed", FIVE), f"{r}_{k}_path_per_min", *_each(f"{r}_{k}_accel", FIVE)]
        out += [*_each(f"{r}_qom", FIVE), *(f"{r}_{k}" for k in ("qom_per_min", "still_frac", "burst_frac", "burst_rate_per_min", "burst_dur_mean", "pow_lo", "pow_mid", "pow_hi", "dom_freq", "spec_entropy", "qom_sampen", "wrist_asym", "contraction_mean", "contraction_sd", "sway_x", "sway_y"))]
    for s in ("motion", "yaw", "pitch"):
        out += [f"dyad_{s}_sync_{k}" for k in ("peak", "peak_sd", "surrogate", "excess", "strong_frac", "lag_abs", "lead", "n_windows")]
        out += [f"dyad_{s}_crqa_{k}" for k in ("rr", "det", "maxline", "meanline", "entropy", "lam", "tt", "n_runs") if s != "pitch"]
    out += ["dyad_motion_share_child", "dyad_motion_corr", "dyad_n_turns", "dyad_turn_rate_per_min", "dyad_silence_frac", "dyad_child_speech_share"]
    for r in recordings.ROLES:
        out += [f"{r}_speech_frac", f"{r}_turn_rate_per_min", *(n for b in ("turn_dur", "turn_words", "artic_rate", "speak_rate") for n in _each(f"{r}_{b}", FOUR)), f"{r}_intraturn_pause_per_turn"]
        out += [*_each(f"{r}_intraturn_pause", FOUR), f"{r}_intraturn_silence_frac", f"{r}_backchannel_frac", *_each(f"{r}_fto", FOUR), f"{r}_initiate_frac"]
    out += ["dyad_turn_dur_ratio", "dyad_turn_dur_entrain", "dyad_turn_convergence", *(f"dyad_chain_{k}{w}" for w in ("", "_exam_init", "_child_init") for k in ("mean", "max", "ge4_per_min", "n"))]
    for r in recordings.ROLES:
        out += [f"{r}_{k}" for k in ("motion_own_speech", "motion_partner_speech", "motion_speech_ratio", "motion_silence", "nod_rate_listening", "nod_rate_speaking", "nod_listen_excess", "mar_speak_minus_listen")]
    return out


def windows_names(words: dict[int, tuple[str, ...]] | None = None) -> list[str]:
    out = ["new_duration_sec", "new_n_task_spans"]
    for r in recordings.ROLES:
        out += [f"win_{r}_{k}_delta" for k in ("speech_frac", "turn_rate", "yawvel")] + [f"ges_{r}_{e}_per_min" for e in windows.EVENTS] + [f"ges_{r}_pose_frame_frac"]
    out += [f"rsp_{k}" for k in ("child_reply_frac", "after_exam_gap_med", "after_exam_gap_p90", "long_silence_frac", "n_exam_turns")]
    out += [f"txt_{r}_{k}" for r in recordings.ROLES for k in ("n_utt", "question_frac", "backchannel_frac", "utt_char_cv", "chars_per_min")]
    return out + [f"kw_{r}_{w}_per_min" for mine in (windows.KEYWORDS if words is None else words).values() for w in mine for r in ("child", "exam")]
