"""Turns, floor transfers, exchange chains and what follows from them, of diarised speech in annotated spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemetry.functions.staging import staged
from tandemetry.functions.stats import safe_corr
from tandemetry.operators import intervals, kinematics
from tandemetry.operators.features import CELL, four, grouped, long, named
from tandemetry.operators.recordings import ROLES, STEP

MERGE_GAP, CHAIN_GAP, REPLY, LONG, BRIEF = 1.0, 3.0, 2.0, 2.0, 1.0
SHORTEST, SLACK = 0.05, 0.05
SPAN = [*CELL, "span"]


def clipped(utterances: DataFrame, spans: DataFrame, keys: list[str], shortest: float = SHORTEST, bucket: float = 60.0) -> DataFrame:
    """Utterances cut to each span that they overlap by more than `shortest`, with the span's other columns and `span`, its start.

    Both sides are dealt to time buckets besides pid; a pair meets in the first bucket that both have.
    """

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("__low", F.floor(F.col("a") / bucket)).withColumn("__k", F.explode(F.sequence("__low", F.greatest("__low", F.floor(F.col("b") / bucket)))))

    places = dealt(spans).select("pid", "__k", F.col("__low").alias("__span_low"), *(F.col(k) for k in keys if k != "pid"), F.col("a").alias("span"), F.col("b").alias("span_end"))
    met = dealt(utterances).join(places, ["pid", "__k"]).where(F.col("__k") == F.greatest("__low", "__span_low")).drop("__k", "__low", "__span_low")
    cut = met.withColumn("a", F.greatest("a", "span")).withColumn("b", F.least("b", "span_end")).where(F.col("b") - F.col("a") > shortest)
    if "words" in cut.columns and dict(cut.dtypes)["words"].startswith("array"):
        cut = cut.withColumn("words", F.size(F.filter("words", lambda w: F.coalesce(w, F.col("a")).between(F.col("a") - SLACK, F.col("b") + SLACK))))
    return cut


def _order(rows: DataFrame) -> list[str]:
    return ["a", "n"] if "n" in rows.columns else ["a", "b"]


def turns(utterances: DataFrame, keys: list[str], gap: float = MERGE_GAP) -> DataFrame:
    """keys, turn, speaker, a, b, n_utterances, words, speech, pauses: neighbours of one speaker at most `gap` apart are one turn, which ends with its last utterance."""
    by = _order(utterances)
    order = Window.partitionBy(*keys).orderBy(*by)
    pause = F.col("a") - F.lag("b").over(order)
    new = F.coalesce((F.lag("speaker").over(order) != F.col("speaker")) | (pause > gap), F.lit(True))
    numbered = utterances.withColumn("pause", pause).withColumn("new", new.cast("int")).withColumn("turn", F.sum("new").over(order))
    words = F.sum("words") if "words" in utterances.columns else F.lit(None).cast("long")
    return numbered.groupBy(*keys, "turn").agg(
        F.first("speaker").alias("speaker"), F.min("a").alias("a"), F.max_by("b", F.struct(*by)).alias("b"), F.count("*").alias("n_utterances"), words.alias("words"),
        F.sum(F.col("b") - F.col("a")).alias("speech"), F.collect_list(F.when(F.col("new") == 0, F.col("pause"))).alias("pauses"),
    )


def chains(turn_rows: DataFrame, keys: list[str], gap: float = CHAIN_GAP) -> DataFrame:
    """keys, chain, initiator and length of alternations whose gaps are at most `gap`."""
    order = Window.partitionBy(*keys).orderBy("turn")
    goes_on = (F.lag("speaker").over(order) != F.col("speaker")) & (F.col("a") - F.lag("b").over(order) <= gap)
    numbered = turn_rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("new").over(order))
    return numbered.groupBy(*keys, "chain").agg(F.min_by("speaker", "turn").alias("initiator"), F.count("*").alias("length"))


def transfers(turn_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, speaker and offset of each change of speaker, attributed to the new one."""
    order = Window.partitionBy(*keys).orderBy("turn")
    change = turn_rows.withColumn("before", F.lag("speaker").over(order)).withColumn("offset", F.col("a") - F.lag("b").over(order))
    return change.where(F.col("before") != F.col("speaker")).select(*keys, "speaker", "offset")


def spoken(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total: time covered by speech of each key."""
    return intervals.union_length(utterances, keys).select(*keys, "total")


def gated(utterances: DataFrame, spans: DataFrame, least: int = 4, longest_idle: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(clipped utterances of the two roles with their cell's seconds, cell and seconds) of cells longer than a second with at least four utterances."""
    seconds = spans.groupBy(*CELL).agg(F.sum(F.col("b") - F.col("a")).alias("seconds")).where(F.col("seconds") > longest_idle)
    cut = clipped(utterances.where(F.col("speaker").isin(*ROLES)), spans, list(CELL))
    enough = cut.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*CELL)
    seconds = seconds.join(enough, list(CELL))
    return cut.join(seconds, list(CELL)), seconds


def features(utterances: DataFrame, spans: DataFrame) -> DataFrame:
    """Long rows of turn-taking, rates, offsets, convergence and chains over each cell's spans."""
    said, seconds = gated(utterances, spans)
    said, seconds = staged(said, "said"), staged(seconds, "seconds")
    built = staged(turns(said, SPAN).join(seconds, list(CELL)), "turns")
    parts = [dyad(said, built, seconds), *(f(said, built, seconds) for f in (by_role, offsets, convergence, initiative))]
    return reduce(DataFrame.union, parts)


def dyad(said: DataFrame, built: DataFrame, seconds: DataFrame) -> DataFrame:
    """Number and rate of turns, silence, and the child's share of speech."""
    talk = spoken(said, list(CELL)).withColumnRenamed("total", "any")
    own = spoken(said.where(F.col("speaker") == ROLES[0]), list(CELL)).withColumnRenamed("total", "child")
    n = built.groupBy(*CELL).agg(F.count("*").alias("n_turns"))
    rows = seconds.join(n, list(CELL)).join(talk, list(CELL)).join(own, list(CELL), "left")
    values = {"n_turns": F.col("n_turns"), "turn_rate_per_min": F.col("n_turns") / (F.col("seconds") / 60), "silence_frac": 1 - F.col("any") / F.col("seconds"), "child_speech_share": F.when(F.col("any") > 0, F.coalesce("child", F.lit(0.0)) / F.col("any"))}
    return long(rows.select(*CELL, *(v.alias(k) for k, v in values.items())), list(values), F.lit("dyad"))


def by_role(said: DataFrame, built: DataFrame, seconds: DataFrame) -> DataFrame:
    """Of each role: shares, rates, and the length, words, articulation, speaking rate and pauses of turns."""
    keys = [*CELL, "speaker"]
    every = seconds.select("*", F.explode(F.array(*map(F.lit, ROLES))).alias("speaker"))
    held = F.col("b") - F.col("a")
    bundles = named("turn_dur", four(held)) | named("turn_words", four(F.col("words").cast("double"))) | named("artic_rate", four(F.when(F.col("speech") > 0.3, F.col("words") / F.col("speech"))))
    bundles |= named("speak_rate", four(F.when(held > 0.3, F.col("words") / held)))
    total = F.sum(held)
    single = {"intraturn_pause_per_turn": F.avg(F.size("pauses")), "intraturn_silence_frac": F.when(total > 0, (total - F.sum("speech")) / F.nullif(total, F.lit(0.0))), "backchannel_frac": F.avg((held < BRIEF).cast("double"))}
    own = grouped(built, keys, {"n": F.count("*")} | bundles | single)
    pauses = built.select(*keys, F.explode("pauses").alias("p"))
    paused = grouped(pauses, keys, named("intraturn_pause", four(F.col("p"))))
    rows = every.join(spoken(said, keys), keys, "left").join(own, keys, "left").join(paused, keys, "left")
    rows = rows.withColumn("speech_frac", F.coalesce("total", F.lit(0.0)) / F.col("seconds")).withColumn("turn_rate_per_min", F.coalesce("n", F.lit(0)) / (F.col("seconds") / 60))
    return long(rows, ["speech_frac", "turn_rate_per_min", *bundles, *single, *named("intraturn_pause", four(F.col("p")))], F.col("speaker"))


def offsets(said: DataFrame, built: DataFrame, seconds: DataFrame) -> DataFrame:
    """Gaps at changes of speaker inside a span, of at least three, and how many of them follow a long silence."""
    values = named("fto", four(F.col("offset"))) | {"initiate_frac": F.when(F.count("*") >= 3, F.avg((F.col("offset") > LONG).cast("double")))}
    return long(grouped(transfers(built, SPAN), [*CELL, "speaker"], values), list(values), F.col("speaker"))


def convergence(said: DataFrame, built: DataFrame, seconds: DataFrame) -> DataFrame:
    """Ratio of the roles' median turns, correlation of neighbouring turns, and how far the medians draw together from the first to the second half of the turns; at least four turns each."""
    held = _halved(built)
    mine = lambda role, part=None: F.percentile(F.when((F.col("speaker") == role) & (F.lit(True) if part is None else F.col("part") == part), F.col("d")), F.lit(0.5))
    count = lambda role: F.count_if(F.col("speaker") == role)
    gap = lambda part: F.abs(mine(ROLES[0], part) - mine(ROLES[1], part))
    enough = (count(ROLES[0]) >= 4) & (count(ROLES[1]) >= 4)
    order = Window.partitionBy(*SPAN).orderBy("turn")
    change = F.col("speaker") != F.lead("speaker").over(order)
    held = held.withColumn("x", F.when(change, F.col("d"))).withColumn("y", F.when(change, F.lead("d").over(order)))
    values = {
        "turn_dur_ratio": F.when(enough, mine(ROLES[0]) / F.greatest(F.lit(1e-6), mine(ROLES[1]))),
        "turn_dur_entrain": F.when(enough & (F.count("x") >= 6), safe_corr(F.when(F.col("y").isNotNull(), F.col("x")), F.col("y"))),
        "turn_convergence": F.when(enough, gap(0) - gap(1)),
    }
    return long(grouped(held, list(CELL), values), list(values), F.lit("dyad"))


def _halved(built: DataFrame) -> DataFrame:
    """Turns with d, their length, and part, the half of the cell's list of turns that they are in."""
    cell = Window.partitionBy(*CELL)
    return built.withColumn("d", F.col("b") - F.col("a")).withColumn("part", (F.row_number().over(cell.orderBy("span", "turn")) > F.floor(F.count("*").over(cell) / 2)).cast("int"))


def initiative(said: DataFrame, built: DataFrame, seconds: DataFrame) -> DataFrame:
    """Length and number of exchange chains, overall and by who began them; who began none has none."""
    found = chains(built, SPAN).join(seconds, list(CELL))
    rate = F.count_if(F.col("length") >= 4) / (F.first("seconds") / 60)
    values = {"chain_mean": F.avg("length"), "chain_max": F.max("length"), "chain_ge4_per_min": rate, "chain_n": F.count("*")}
    out = long(grouped(found, list(CELL), values), list(values), F.lit("dyad"))
    began = grouped(found, [*CELL, "initiator"], {k.replace("chain_", ""): v for k, v in values.items()})
    every = found.select(*CELL).distinct().select("*", F.explode(F.array(*map(F.lit, ROLES))).alias("initiator"))
    rows = every.join(began, [*CELL, "initiator"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ge4_per_min", F.coalesce("ge4_per_min", F.lit(0.0)))
    short = F.when(F.col("initiator") == "examiner", "exam").otherwise(F.col("initiator"))
    each = long(rows.withColumn("who", short), ["mean", "max", "ge4_per_min", "n"], F.lit("dyad_chain"), (*CELL, "who"))
    return out.union(each.select(*CELL, F.concat("feature", F.lit("_"), "who", F.lit("_init")).alias("feature"), "value"))


def floor_states(slots: DataFrame, utterances: DataFrame) -> DataFrame:
    """pid, slot, child, examiner: who speaks in a slot, with half a step to spare at either end."""
    heard = utterances.where(F.col("speaker").isin(*ROLES)).select("pid", "speaker", (F.col("a") - STEP / 2).alias("a"), (F.col("b") + STEP / 2).alias("b"))
    found = intervals.points_in_spans(slots.select("pid", "slot", "t").distinct(), heard, ["pid"], bucket=30.0)
    return found.groupBy("pid", "slot").agg(*(F.max((F.col("speaker") == role).cast("int")).alias(role) for role in ROLES))


def crossmodal(rows: DataFrame, utterances: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """Motion, nods and mouth opening while oneself, the other or nobody speaks."""
    floors = floor_states(rows.select("pid", "slot", "t"), utterances)
    heard = rows.join(floors, ["pid", "slot"], "left").fillna(0, list(ROLES))
    me, other = (F.when(F.col("role") == ROLES[0], F.col(a)).otherwise(F.col(b)) == 1 for a, b in (ROLES, ROLES[::-1]))
    marked = heard.withColumn("own", me).withColumn("other", other).withColumn("silence", ~me & ~other)
    keys = [*CELL, "role"]
    marked = staged(marked.select("pid", "task", "half", "role", "slot", "face_ok", "mar", "pitch_d", "own", "other", "silence"), "floors")
    energy = kinematics.motion(kinematics.joints(rows) if moved is None else moved).where("q is not null").join(marked.select(*keys, "slot", "own", "other", "silence"), [*keys, "slot"])
    n = {k: F.count_if(F.col(k)) > 16 for k in ("own", "other", "silence")}
    mean = {k: F.avg(F.when(F.col(k), F.col("q"))) for k in n}
    values = {"motion_own_speech": F.when(n["own"] & n["other"], mean["own"]), "motion_partner_speech": F.when(n["own"] & n["other"], mean["other"]), "motion_speech_ratio": F.when(n["own"] & n["other"], F.try_divide(mean["own"], mean["other"])), "motion_silence": F.when(n["silence"] & n["other"], mean["silence"])}
    out = long(grouped(energy, keys, values), list(values), F.col("role"))
    seen = marked.where("face_ok")
    open_ = {"own": F.when(F.col("own"), F.col("mar")), "other": F.when(F.col("other"), F.col("mar"))}
    mouth = {"mar_speak_minus_listen": F.when((F.count(open_["own"]) > 16) & (F.count(open_["other"]) > 16), F.avg(open_["own"]) - F.avg(open_["other"]))}
    out = out.union(long(grouped(seen, keys, mouth), list(mouth), F.col("role")))
    return out.union(nods(marked))


def nods(marked: DataFrame, least_deg: float = 3.0, least: int = 6) -> DataFrame:
    """Changes of direction of large vertical head motion a second, while listening and while speaking, and their difference."""
    keys = [*CELL, "role"]
    big = marked.where(F.col("face_ok") & (F.abs("pitch_d") >= least_deg))
    states = big.select(*keys, "slot", F.col("pitch_d").alias("d"), F.explode(F.array(F.when(F.col("other"), F.lit("listening")), F.when(F.col("own"), F.lit("speaking")))).alias("state")).where("state is not null")
    rates = kinematics.reversals(states, [*keys, "state"], "d", least)
    sides = grouped(rates, keys, {f"nod_rate_{s}": F.max(F.when(F.col("state") == s, F.col("reversal_rate"))) for s in ("listening", "speaking")})
    sides = sides.withColumn("nod_listen_excess", F.col("nod_rate_listening") - F.col("nod_rate_speaking"))
    return long(sides, ["nod_rate_listening", "nod_rate_speaking", "nod_listen_excess"], F.col("role"))
