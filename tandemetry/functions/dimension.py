"""What a feature is about, from its name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 34 features of the catalog, prefixes of further ones, targets, tasks, and labels of kinds.
STEMS = ("speech_frac", "turn_rate_per_min", "turn_words_mean", "backchannel_frac", "yaw_angvel_med", "yaw_angacc_med", "yaw_rot_per_min", "roll_range", "roll_angacc_mean", "roll_angvel_p90", "pitch_angacc_p90", "pitch_reversal_rate", "sway_y")
DYAD = ("dyad_child_speech_share", "dyad_silence_frac", "dyad_turn_dur_ratio", "dyad_turn_rate_per_min", "dyad_motion_share_child", "dyad_chain_mean", "dyad_chain_max", "dyad_chain_ge4_per_min")
FROZEN = (*(f"child_{s}" for s in STEMS), *(f"examiner_{s}" for s in STEMS), *DYAD)
EXTRA_PREFIXES = ("win_", "rsp_", "ges_", "txt_")
TARGETS = {"SA": "SA(対人的感情)", "RRB": "RRB(限定的・反復的行動)", "CSS": "Comparative Score"}
TASKS = {1: "構成課題", 2: "ごっこあそび", 3: "共同注意", 4: "実演", 5: "絵の説明", 6: "本のストーリーの説明", 7: "自由遊び", 8: "誕生日", 9: "おやつ", 10: "ルーティン"}
AMOUNT, LENGTH, QUESTION, ASSENT, GESTURE, SHARE, HEAD, SWAY, TIMING, COVERAGE = "発話の量", "発話の長さ", "質問", "あいづち", "身振り", "動きの分担", "首・頭の動き", "揺れ", "やり取りの間", "映り"
NEAR, FAR = "近い", "遠い"
KIND_OF = {
    "speech_frac": AMOUNT, "turn_rate_per_min": AMOUNT, "turn_words_mean": LENGTH, "backchannel_frac": ASSENT, "sway_y": SWAY, **{s: HEAD for s in STEMS if s.startswith(("yaw", "roll", "pitch"))},
}
DYAD_KIND = dict(zip(DYAD, (AMOUNT, TIMING, LENGTH, AMOUNT, SHARE, TIMING, TIMING, TIMING), strict=True))


def _starts(name: Column, *prefixes: str) -> Column:
    return reduce(lambda a, b: a | b, (name.startswith(p) for p in prefixes))


def is_catalog(name: Column) -> Column:
    return name.isin(*FROZEN) | _starts(name, *EXTRA_PREFIXES)


def source(name: Column) -> Column:
    """child, examiner, dyad or other."""
    person = [(_starts(name, f"win_{r}_", f"ges_{r}_", f"txt_{r}_") | (name.isin(*FROZEN) & name.startswith(f"{r}_")), r) for r in ("child", "examiner")]
    return F.when(person[0][0], "child").when(person[1][0], "examiner").when(name.isin(*DYAD) | name.startswith("rsp_"), "dyad").otherwise("other")


def family(name: Column) -> Column:
    """frozen34 for the catalog's own, else what the prefix says."""
    out = F.when(name.isin(*FROZEN), "frozen34")
    for prefix, label in (("win_", "window"), ("rsp_", "response"), ("ges_", "gesture"), ("txt_", "text"), ("kw_", "keyword")):
        out = out.when(name.startswith(prefix), f"new_{label}")
    return out.otherwise("new_other")


def asr_risky(name: Column) -> Column:
    """Whether a feature hangs on recognised words."""
    return _starts(name, "txt_", "kw_")


def kind(name: Column, strict: bool = True) -> Column:
    """The kind of content; a name without one is an error, or null if not strict."""
    stem = F.regexp_replace(name, "^(child|examiner)_", "")
    own = F.create_map(*(F.lit(x) for kv in KIND_OF.items() for x in kv))[stem]
    both = F.create_map(*(F.lit(x) for kv in DYAD_KIND.items() for x in kv))[name]
    win, ges, txt, has = name.startswith("win_"), name.startswith("ges_"), name.startswith("txt_"), name.contains
    out = (
        F.when(both.isNotNull(), both).when(_starts(name, "child_", "examiner_") & own.isNotNull(), own)
        .when(win & (has("speech_frac") | has("turn_rate")), AMOUNT).when(win & (has("yaw") | has("roll") | has("pitch")), HEAD)
        .when(ges & has("pose_frame_frac"), COVERAGE).when(ges, GESTURE)
        .when(txt & has("question"), QUESTION).when(txt & has("backchannel"), ASSENT).when(txt & has("utt_char_cv"), LENGTH).when(txt & (name.endswith("_n_utt") | has("chars_per_min")), AMOUNT)
        .when(name == "rsp_n_exam_turns", AMOUNT).when(name.startswith("rsp_"), TIMING)
    )
    return out.otherwise(F.raise_error(F.concat(F.lit("no kind for the feature "), name)).cast("string")) if strict else out


def near_far(a: Column, b: Column) -> Column:
    """Whether two arrays of kinds share one."""
    return F.when(F.arrays_overlap(a, b), NEAR).otherwise(FAR)
