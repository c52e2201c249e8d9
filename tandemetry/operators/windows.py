"""Features of the two halves of an activity, gestures, replies and texts, as long rows of (pid, task)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemetry.functions.staging import staged
from tandemetry.operators import conversation, intervals
from tandemetry.operators.conversation import BRIEF, LONG, REPLY, SPAN
from tandemetry.operators.features import CELL, grouped, long
from tandemetry.operators.recordings import ROLES, STEP, finite

LEAST_SECONDS = 20.0
# Gestures, words of assent, endings of questions and keywords by task.
EVENTS = ("pointing_candidate", "arm_extended", "fidgeting", "hand_near_face", "leaning_away")
ASSENT = ("うん", "はい", "ええ", "あー", "ん", "あ", "えっ", "ふん")
QUESTION_ENDS = ("？", "?", "か", "の", "かな")
KEYWORDS = {
    9: ("食べ", "おいしい", "ください", "おやつ", "ジュース", "パン", "クッキー"),
    2: ("なって", "ごっこ", "だよ", "わん", "ぶー", "先生"),
}


def activities(segments: DataFrame, least: float = LEAST_SECONDS) -> DataFrame:
    """cell, spans (array of a, b in order), seconds, n_spans of the activities that last long enough."""
    merged = intervals.union_spans(segments, ["pid", "task"]).withColumn("half", F.lit(-1))
    found = merged.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"), F.sum(F.col("b") - F.col("a")).alias("seconds"), F.count("*").alias("n_spans"))
    return found.where(F.col("seconds") >= least)


def progress(t: Column, spans: Column, seconds: Column) -> Column:
    """Share of the covered time that has passed at t; 1 after the last span."""
    return F.aggregate(spans, F.lit(0.0), lambda done, s: done + F.greatest(F.lit(0.0), F.least(t, s["b"]) - s["a"])) / seconds


def utterance_half(p: Column) -> Column:
    """The half that an utterance's middle is in; the very beginning is in neither."""
    return F.when((p > 0) & (p < 0.5), "first").when(p >= 0.5, "second")


def frame_half(p: Column) -> Column:
    """The half that a frame is in; the very beginning counts as the second."""
    return F.when((p > 0) & (p < 0.5), "first").otherwise("second")


def is_question(text: Column) -> Column:
    t = F.trim(text)
    ends = reduce(lambda a, b: a | b, (t.endswith(e) for e in QUESTION_ENDS))
    return (t != "") & (ends | t.contains("？") | t.contains("?"))


def is_assent(text: Column, seconds: Column) -> Column:
    return ((seconds < BRIEF) & (F.char_length(F.trim(text)) <= 4)) | F.trim(text).isin(*ASSENT)


def occurrences(text: Column, word: str) -> Column:
    """How often a word occurs in a text, without overlaps."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def _delta(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Second half less first half; null unless both are known."""
    side = lambda c, half: F.max(F.when(F.col("part") == half, F.col(c)))
    return rows.groupBy(*keys).agg(*((side(c, "second") - side(c, "first")).alias(f"{c}_delta") for c in columns))


def speech_change(said: DataFrame, held: DataFrame) -> DataFrame:
    """Change of speech share and turn rate between the halves, of activities whose halves last over a second."""
    middle = progress((F.col("a") + F.col("b")) / 2, F.col("spans"), F.col("seconds"))
    parts = said.join(held, list(CELL)).withColumn("part", utterance_half(middle)).where("part is not null and seconds > 2")
    keys = [*CELL, "part", "speaker"]
    spoken = intervals.union_spans(parts, keys).groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("total"))
    turned = conversation.turns(parts, [*SPAN, "part"]).groupBy(*keys).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(*(F.struct(F.lit(r).alias("speaker"), F.lit(h).alias("part")) for r in ROLES for h in ("first", "second")))).alias("s")
    every = held.where("seconds > 2").select(*CELL, "seconds", sides).select(*CELL, "seconds", "s.*")
    rows = every.join(spoken, keys, "left").join(turned, keys, "left").withColumn("speech_frac", F.coalesce("total", F.lit(0.0)) / (F.col("seconds") / 2)).withColumn("turn_rate", F.coalesce("n", F.lit(0)) / (F.col("seconds") / 120))
    return long(_delta(rows, [*CELL, "speaker"], ["speech_frac", "turn_rate"]), ["speech_frac_delta", "turn_rate_delta"], F.concat(F.lit("win_"), "speaker"))


def frames_inside(framed: DataFrame, held: DataFrame) -> DataFrame:
    """Frames whose time is covered by an activity, with part and a face and a pose for each role as rows."""
    spans = held.select("pid", "task", "half", "seconds", "spans", F.inline("spans"))
    inside = intervals.points_in_spans(framed.where(finite(F.col("t")).isNotNull()), spans, ["pid"], bucket=60.0)
    placed = inside.withColumn("part", frame_half(progress(F.col("t"), F.col("spans"), F.col("seconds"))))
    sides = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), finite(F.col(f"{r}_face.head_pose.yaw")).alias("yaw"), F.col(f"{r}_pose").alias("pose")) for r in ROLES)))
    return placed.select(*CELL, "seconds", "part", "idx", "t", sides.alias("s")).select(*CELL, "seconds", "part", "idx", "t", "s.*")


def turning_change(inside: DataFrame) -> DataFrame:
    """Change of the median speed of head turns between the halves, each of at least four frames."""
    keys = [*CELL, "role", "part"]
    order = Window.partitionBy(*keys).orderBy("idx")
    known = inside.where("yaw is not null").withColumn("dt", F.col("t") - F.lag("t").over(order)).withColumn("dx", F.abs(F.col("yaw") - F.lag("yaw").over(order)))
    speed = F.percentile(F.when(F.col("dt").between(0.1, 0.6), F.col("dx") / F.col("dt")), F.lit(0.5))
    rows = known.groupBy(*keys).agg(F.when(F.count("*") >= 4, speed).alias("yawvel"))
    return long(_delta(rows, [*CELL, "role"], ["yawvel"]), ["yawvel_delta"], F.concat(F.lit("win_"), "role"))


def gestures(inside: DataFrame, held: DataFrame) -> DataFrame:
    """Frames a minute with each gesture, and the share of frames with a pose."""
    shown = lambda e: F.exists("pose.events", lambda x: x["type"] == e)
    counts = inside.where("pose is not null").groupBy(*CELL, "role").agg(F.count("*").alias("poses"), *(F.count_if(shown(e)).alias(e) for e in EVENTS))
    every = held.select(*CELL, "seconds", F.explode(F.array(*map(F.lit, ROLES))).alias("role")).join(counts, [*CELL, "role"], "left").fillna(0, ["poses", *EVENTS])
    rows = every.select(*CELL, "role", *((F.col(e) / (F.col("seconds") / 60)).alias(f"{e}_per_min") for e in EVENTS), (F.col("poses") / F.greatest(F.col("seconds") / STEP, F.lit(1.0))).alias("pose_frame_frac"))
    return long(rows, [*(f"{e}_per_min" for e in EVENTS), "pose_frame_frac"], F.concat(F.lit("ges_"), "role"))


def replies(said: DataFrame, held: DataFrame) -> DataFrame:
    """What follows a turn of the examiner inside a span."""
    order = Window.partitionBy(*SPAN).orderBy("turn")
    following = conversation.turns(said, SPAN).withColumn("next", F.lead("speaker").over(order)).withColumn("gap", F.lead("a").over(order) - F.col("b"))
    asked = following.where((F.col("speaker") == "examiner") & F.col("next").isNotNull())
    gap = F.when(F.col("next") == "child", F.col("gap"))
    q = F.percentile(gap, F.array(F.lit(0.5), F.lit(0.9)))
    values = {"child_reply_frac": F.avg(F.coalesce(gap.between(0, REPLY), F.lit(False)).cast("double")), "after_exam_gap_med": q[0], "after_exam_gap_p90": q[1], "long_silence_frac": F.avg((gap > LONG).cast("double")), "n_exam_turns": F.count("*")}
    rows = held.select(*CELL).join(grouped(asked, list(CELL), values), list(CELL), "left").withColumn("n_exam_turns", F.coalesce("n_exam_turns", F.lit(0)))
    return long(rows, list(values), F.lit("rsp"))


def texts(said: DataFrame, held: DataFrame) -> DataFrame:
    """Number, questions, assent and length of utterances."""
    seconds, size = F.col("b") - F.col("a"), F.char_length("text")
    values = {
        "n_utt": F.count("*"), "question_frac": F.avg(is_question(F.col("text")).cast("double")), "backchannel_frac": F.avg(is_assent(F.col("text"), seconds).cast("double")),
        "utt_char_cv": F.when((F.count("*") >= 3) & (F.avg(size) > 0), F.stddev_pop(size) / F.nullif(F.avg(size), F.lit(0.0))), "chars_per_min": F.sum(size) / (F.first("seconds") / 60),
    }
    every = held.select(*CELL, "seconds", F.explode(F.array(*map(F.lit, ROLES))).alias("speaker"))
    rows = every.join(grouped(said.join(held.select(*CELL, "seconds"), list(CELL)), [*CELL, "speaker"], values), [*CELL, "speaker"], "left").withColumn("n_utt", F.coalesce("n_utt", F.lit(0)))
    return long(rows, list(values), F.concat(F.lit("txt_"), "speaker"))


def keywords(said: DataFrame, held: DataFrame, words: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """Occurrences a minute of each task's keywords in all that a speaker says, joined."""
    words = KEYWORDS if words is None else words
    listed = F.array_sort(F.collect_list(F.struct("span", "a", "n", "text")))
    blobs = said.groupBy(*CELL, "speaker").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("blob"))
    every = held.where(F.col("task").isin(*words)).select(*CELL, "seconds", F.explode(F.array(*map(F.lit, ROLES))).alias("speaker")).join(blobs, [*CELL, "speaker"], "left").withColumn("blob", F.coalesce("blob", F.lit("")))
    found = F.lit(None)
    for task, mine in words.items():
        each = F.array(*(F.struct(F.lit(w).alias("w"), occurrences(F.col("blob"), w).alias("hits")) for w in mine))
        found = F.when(F.col("task") == task, each).otherwise(found)
    rows = every.select(*CELL, "seconds", "speaker", F.explode(found).alias("k"))
    name = F.concat(F.lit("kw_"), F.when(F.col("speaker") == "examiner", "exam").otherwise(F.col("speaker")), F.lit("_"), F.col("k.w"), F.lit("_per_min"))
    return rows.select(*CELL, name.alias("feature"), (F.col("k.hits") / (F.col("seconds") / 60)).alias("value"))


def features(framed: DataFrame, utterances: DataFrame, segments: DataFrame, words: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """pid, task, half (-1), feature, value of every activity of at least 20 seconds."""
    held = staged(activities(segments), "activities")
    spans = held.select(*CELL, F.inline("spans"))
    said = staged(conversation.clipped(utterances.where(F.col("speaker").isin(*ROLES)), spans, list(CELL)), "clipped")
    inside = staged(frames_inside(framed, held), "frames-inside")
    basic = long(held.select(*CELL, F.col("seconds").alias("new_duration_sec"), F.col("n_spans").alias("new_n_task_spans")), ["new_duration_sec", "new_n_task_spans"])
    return reduce(DataFrame.union, [basic, speech_change(said, held), turning_change(inside), gestures(inside, held), replies(said, held), texts(said, held), keywords(said, held, words)])
