"""Queries of the callable operators on recordings made from the tables, with oracles written apart from them.

Bindings: a recording is ten rows of embeddings, pid vec_id / 10, with 64 slots each; angles and joints are numbers of the row
at other places, missing by fixed rules.  Task 1 has two spans, tasks 2 and 3 one; speech is that of the catalog's clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemetry.functions import replicates, text
from tandemetry.functions.staging import staged
from tandemetry.functions.stats import rounded, spearman
from tandemetry.operators import conversation, kinematics, recordings, relational, screening, synchrony, windows
from tandemetry.operators.features import CELL
from tandemetry.plans.catalog import _CROSS, CORR, EV, FEAT, QUERIES, UT, base, operator, rank
from tandemetry.plans.dialect import spark_sql

JOINTS = {"nose": 2, "left_shoulder": 5, "right_shoulder": 9, "left_elbow": 13, "right_elbow": 17, "left_wrist": 21, "right_wrist": 29}


def _at(k: int) -> str:
    return f"cast(@at(embedding, cast((i * {k} + r * 7) % 64 as int) + 1) as double)"


#: A row a pid, role and slot: what recordings.series gives, but for joints as columns.
REC = (
    "rc0 as (select cast(floor(vec_id / 10) as bigint) as pid, (vec_id % 10) * 64 + i - 1 as slot, r, i, embedding from (select vec_id, embedding, i, @series(0, 1) as r from (select vec_id, embedding, @series(1, 64) as i from embeddings) e1) e2),"
    f" rec as (select pid, slot, slot * 25e-2 as t, case r when 0 then 'child' else 'examiner' end as role, (slot * 37 + pid * 11 + r) % 101 <> 0 as face_ok, (slot * 53 + pid + r * 5) % 149 <> 0 as pose_ok, (slot + pid) % 211 = 0 as swap,"
    f" 40 * {_at(1)} as yaw, 40 * {_at(3)} as pitch, case when (slot * 7 + pid) % 31 = 0 then null else 40 * {_at(11)} end as roll, case when slot % 19 = 0 then null else {_at(27)} end as mar, 1 + abs({_at(33)}) as scale,"
    + ", ".join(f" case when (slot * {k} + pid + r) % 41 = 0 then null else 30 * {_at(k)} end as {n}_x, 30 * {_at(k + 2)} as {n}_y" for n, k in JOINTS.items())
    + " from rc0),"
    " sg as (select distinct pid, task, a, b from (select pid, 1 as task, 0e0 as a, 30e0 as b from rec union all select pid, 1, 30e0, 40e0 from rec union all select pid, 1, 60e0, 80e0 from rec union all select pid, 2, 85e0, 150e0 from rec union all select pid, 3, 40e0, 42e0 from rec) z)"
)
#: The rows of the cells: tasks of at least 20 seconds of frames.
CELLS = REC + ", cl0 as (select rec.*, sg.task from rec join (select distinct * from sg) sg on rec.pid = sg.pid and rec.t >= sg.a and rec.t < sg.b), cl as (select * from (select *, count(*) over (partition by pid, task, role) as frames from cl0) z where frames * 0.25 >= 20)"


def _series(spark, sf_dir) -> DataFrame:
    rows = base(spark, sf_dir, REC, "rec")
    both = [F.when(F.col(f"{n}_x").isNotNull() & F.col(f"{n}_y").isNotNull(), F.struct(F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y"))).alias(n) for n in JOINTS]
    return rows.select("pid", "slot", "t", "role", "face_ok", "pose_ok", "swap", "yaw", "pitch", "roll", "mar", "scale", *both)


def _cells(spark, sf_dir) -> DataFrame:
    series = staged(_series(spark, sf_dir), "series")
    slots = series.where("role = 'child'").select("pid", "slot", "t")
    cells, _ = recordings.cells(slots, base(spark, sf_dir, REC, "sg"), min_task_sec=20.0)
    rows = staged(cells.drop("t").join(series, ["pid", "slot"]), "cell-rows")
    # one shuffle by pid serves all windows and groups after it; partitions grow in number with the rows
    return rows.repartition(max(replicates.parallelism(rows), rows.count() // 250_000), "pid")


def _long(rows: DataFrame, like: str, digits: int = 4) -> DataFrame:
    return rows.where(F.col("feature").rlike(like)).select("pid", "task", "feature", rounded(F.col("value"), digits).alias("value"))


_FIVE = "avg({0}) as mean, sqrt(avg({0} * {0})) as rms, quantile_cont({0}, 0.5) as med, quantile_cont({0}, 0.9) as p90, quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) as iqr, count({0}) as k"


def _unpivoted(source: str, prefix: str, stats: list[str], gate: str = "true") -> str:
    return " union all ".join(f"select pid, task, {prefix} || '{s}' as feature, {s} as value from {source} where {gate}" for s in stats)


_ANG = (
    f"with {CELLS}, an as (select pid, task, role, slot, u.* from cl, lateral (select unnest(['yaw', 'pitch', 'roll']) as sig, unnest([yaw, pitch, roll]) as x) u where face_ok), ak as (select * from (select *, count(*) over (partition by pid, task, role, sig) as n from an where x is not null) z where n >= 8),"
    " d1 as (select *, case when slot - lag(slot) over w = 1 then x - lag(x) over w end as d from ak window w as (partition by pid, task, role, sig order by slot)), d2 as (select *, case when slot - lag(slot) over w = 1 then d - lag(d) over w end as dd from d1 window w as (partition by pid, task, role, sig order by slot)),"
    " mi as (select pid, task, role, count(*) * 0.25 / 60 as minutes from cl where face_ok group by pid, task, role)"
)


@operator(
    _ANG + f", v as (select pid, task, role, sig, {_FIVE.format('abs(d) / 0.25')} from d2 group by all), a as (select pid, task, role, sig, {_FIVE.format('abs(dd) / 0.0625')} from d2 group by all),"
    " b as (select d2.pid, d2.task, d2.role, sig, stddev_pop(x) as rms_disp, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) as range, coalesce(sum(abs(d)), 0) / any_value(minutes) as rot_per_min from d2 join mi using (pid, task, role) group by d2.pid, d2.task, d2.role, sig),"
    " s as (select pid, task, role, slot, case when count(d) = 3 then sqrt(sum(d * d)) / 0.25 end as hs from d2 group by pid, task, role, slot), h as (select pid, task, role, " + _FIVE.format("hs") + " from s group by pid, task, role),"
    " u as (" + _unpivoted("v", "role || '_' || sig || '_angvel_'", ["mean", "rms", "med", "p90", "iqr"], "k >= 4") + " union all " + _unpivoted("a", "role || '_' || sig || '_angacc_'", ["mean", "rms", "med", "p90", "iqr"], "k >= 4")
    + " union all " + _unpivoted("b", "role || '_' || sig || '_'", ["rms_disp", "range", "rot_per_min"]) + " union all " + _unpivoted("h", "role || '_head_speed_'", ["mean", "rms", "med", "p90", "iqr"], "k >= 4") + ")"
    " select pid, task, feature, round(value, 4) + 0.0 as value from u"
)
def head_motion(spark, sf_dir):
    """Displacement, range, speed, acceleration and rotation of the head, and its joint speed."""
    return _long(kinematics.rotation(kinematics.turning(_cells(spark, sf_dir))), ".")


@operator(
    _ANG + ", sn as (select pid, task, role, sig, slot, sign(d) as s from d2 where d is not null), sl as (select *, lag(s) over (partition by pid, task, role, sig order by slot) as ls from sn)"
    " select pid, task, role || '_' || sig || '_reversal_rate' as feature, round(avg(case when ls is not null then (s <> ls)::int end) / 0.25, 4) + 0.0 as value from sl group by pid, task, role, sig having count(*) > 8"
)
def head_reversals(spark, sf_dir):
    """Changes of direction a second, over gaps."""
    return _long(kinematics.turn_reversals(kinematics.turning(_cells(spark, sf_dir))), ".")


_KP = (
    f"with {CELLS}, kp as (select pid, task, role, slot, u.joint, u.x / scale as x, u.y / scale as y from cl, lateral (select unnest([{', '.join(repr(j) for j in kinematics.MOVING)}]) as joint, unnest([{', '.join(f'case when {j}_y is not null then {j}_x end' for j in kinematics.MOVING)}]) as x, unnest([{', '.join(f'case when {j}_x is not null then {j}_y end' for j in kinematics.MOVING)}]) as y) u where pose_ok),"
    " sp as (select *, case when slot - lag(slot) over w = 1 then sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) / 0.25 end as v from kp window w as (partition by pid, task, role, joint order by slot)),"
    " ac as (select *, case when slot - lag(slot) over w = 1 then abs(v - lag(v) over w) / 0.25 end as acc from sp window w as (partition by pid, task, role, joint order by slot)),"
    " mi as (select pid, task, role, count(*) as frames, count(*) * 0.25 / 60 as minutes from cl where pose_ok group by pid, task, role), qm as (select pid, task, role, slot, avg(v) as q from ac group by pid, task, role, slot)"
)


@operator(
    _KP + f", v as (select pid, task, role, joint, {_FIVE.format('v')} from ac group by all), a as (select pid, task, role, joint, {_FIVE.format('acc')} from ac group by all), p as (select ac.pid, ac.task, ac.role, joint, coalesce(sum(v), 0) * 0.25 / any_value(minutes) as path_per_min from ac join mi using (pid, task, role) group by ac.pid, ac.task, ac.role, joint),"
    " w as (select pid, task, role, coalesce(sum(v) filter (where joint = 'left_wrist'), 0) as l, coalesce(sum(v) filter (where joint = 'right_wrist'), 0) as r from ac group by pid, task, role), wa as (select pid, task, role, abs(l - r) / (l + r) as wrist_asym from w where l + r > 0),"
    " u as (" + _unpivoted("v", "role || '_' || joint || '_speed_'", ["mean", "rms", "med", "p90", "iqr"], "k >= 4") + " union all " + _unpivoted("a", "role || '_' || joint || '_accel_'", ["mean", "rms", "med", "p90", "iqr"], "k >= 4") + " union all " + _unpivoted("p", "role || '_' || joint || '_'", ["path_per_min"]) + " union all " + _unpivoted("wa", "role || '_'", ["wrist_asym"])
    + " union all select pid, task, role || '_pose_frames', frames from mi) select pid, task, feature, round(value, 4) + 0.0 as value from u"
)
def joint_motion(spark, sf_dir):
    """Speed, acceleration and path of joints, asymmetry of the wrists, frames with a pose."""
    kept = kinematics.timed(_cells(spark, sf_dir), "pose_ok")
    return _long(kinematics.joint_speeds(kept, kinematics.joints(kept, "frames", "minutes")), ".")


@operator(
    _KP + f", q5 as (select pid, task, role, {_FIVE.format('q')} from qm group by all), qp as (select qm.pid, qm.task, qm.role, coalesce(sum(q), 0) * 0.25 / any_value(minutes) as qom_per_min from qm join mi using (pid, task, role) group by qm.pid, qm.task, qm.role),"
    " kn as (select *, row_number() over (partition by pid, task, role order by slot) as i, count(*) over (partition by pid, task, role) as n from qm where q is not null), sh as (select pid, task, role, avg((q < 0.2)::int) as still_frac, avg((q >= 1)::int) as burst_frac from kn where n > 16 group by pid, task, role),"
    " br as (select pid, task, role, i - row_number() over (partition by pid, task, role order by i) as isl from kn where q >= 1 and n > 16), bl as (select pid, task, role, isl, count(*) as len from br group by all), bs as (select sh.pid, sh.task, sh.role, count(len) / any_value(minutes) as burst_rate_per_min, coalesce(avg(len), 0) * 0.25 as burst_dur_mean from sh join mi using (pid, task, role) left join bl using (pid, task, role) group by sh.pid, sh.task, sh.role),"
    " u as (" + _unpivoted("q5", "role || '_qom_'", ["mean", "rms", "med", "p90", "iqr"], "k >= 4") + " union all " + _unpivoted("qp", "role || '_'", ["qom_per_min"]) + " union all " + _unpivoted("sh", "role || '_'", ["still_frac", "burst_frac"]) + " union all " + _unpivoted("bs", "role || '_'", ["burst_rate_per_min", "burst_dur_mean"]) + ")"
    " select pid, task, feature, round(value, 4) + 0.0 as value from u"
)
def body_bursts(spark, sf_dir):
    """Quantity of motion, still and fast shares, and runs of fast motion with gaps closed."""
    return _long(kinematics.quantity(kinematics.energy_of(_cells(spark, sf_dir))), ".")


_SPAN5 = ", ".join(f"{n}_{c} is not null" for n in kinematics.SPANNING for c in "xy").replace(",", " and")


@operator(
    f"with {CELLS}, ar as (select pid, task, role, (greatest({', '.join(f'{n}_x' for n in kinematics.SPANNING)}) - least({', '.join(f'{n}_x' for n in kinematics.SPANNING)})) * (greatest({', '.join(f'{n}_y' for n in kinematics.SPANNING)}) - least({', '.join(f'{n}_y' for n in kinematics.SPANNING)})) / scale / scale as area from cl where pose_ok and {_SPAN5}),"
    " c as (select pid, task, role, avg(area) as contraction_mean, stddev_pop(area) as contraction_sd from ar group by all having count(*) > 16), s as (select pid, task, role, stddev_pop(nose_x / scale) as sway_x, stddev_pop(nose_y / scale) as sway_y from cl where pose_ok and nose_x is not null and nose_y is not null group by all having count(*) > 16),"
    " u as (" + _unpivoted("c", "role || '_'", ["contraction_mean", "contraction_sd"]) + " union all " + _unpivoted("s", "role || '_'", ["sway_x", "sway_y"]) + ") select pid, task, feature, round(value, 4) + 0.0 as value from u"
)
def body_posture(spark, sf_dir):
    """Area of the upper body and drift of the nose, of more than 16 complete frames."""
    return _long(kinematics.posture(_cells(spark, sf_dir).where("pose_ok")), ".")


@operator(
    _KP + ", pr as (select c.pid, c.task, c.q as a, e.q as b from qm c join qm e on c.pid = e.pid and c.task = e.task and c.slot = e.slot where c.role = 'child' and e.role = 'examiner' and c.q is not null and e.q is not null),"
    " z as (select pid, task, sum(a) / (sum(a) + sum(b)) as motion_share_child, corr(a, b) as motion_corr from pr group by pid, task having count(*) > 64), u as (" + _unpivoted("z", "'dyad_'", ["motion_share_child", "motion_corr"]) + ") select pid, task, feature, round(value, 4) + 0.0 as value from u"
)
def dyad_share(spark, sf_dir):
    """The child's share of motion and the correlation of both, of more than 64 frames."""
    return _long(synchrony.share(synchrony.paired_motion(kinematics.joints(_cells(spark, sf_dir)))), ".")


def dyad_synchrony(spark, sf_dir):
    """Windowed synchrony against surrogates and pooled recurrence: kernels that SQL does not express; restated in the tests."""
    return _long(synchrony.features(_cells(spark, sf_dir)), "_sync_|_crqa_", 6)


def head_entropy(spark, sf_dir):
    """Multiscale entropy of yaw and pitch over the six longest runs."""
    return _long(kinematics.entropies(kinematics.turning(_cells(spark, sf_dir))), ".", 6)


def body_spectrum(spark, sf_dir):
    """Welch spectrum and entropy of the longest run of motion."""
    return _long(kinematics.spectra(kinematics.energy_of(_cells(spark, sf_dir))), ".", 6)


_TALK = (
    f"with {UT}, us as (select pid, speaker, a, b, text, words, turn from ut where speaker in ('child', 'examiner')), le as (select pid, max(b) as e from us group by pid),"
    " sg as (select pid, 1 as task, 0e0 as a, e / 3 as b from le union all select pid, 1, e / 2, e * 3 / 4 from le union all select pid, 2, e * 3 / 4, e + 1 from le),"
    " sec as (select pid, task, sum(b - a) as seconds from sg group by pid, task having sum(b - a) > 1),"
    " cu as (select us.pid, task, sg.a as span, speaker, greatest(us.a, sg.a) as a, least(us.b, sg.b) as b, words, text, turn from us join sg on us.pid = sg.pid where least(us.b, sg.b) - greatest(us.a, sg.a) > 0.05),"
    " en as (select pid, task from cu join sec using (pid, task) group by pid, task having count(*) >= 4), cg as (select cu.* from cu join en using (pid, task)),"
    " t0 as (select *, case when lag(speaker) over w = speaker and a - lag(b) over w <= 1 then 0 else 1 end as fresh, a - lag(b) over w as pause from cg window w as (partition by pid, task, span order by a, b)), t1 as (select *, sum(fresh) over (partition by pid, task, span order by a, b rows unbounded preceding) as k from t0),"
    " tn as (select pid, task, span, k, any_value(speaker) as speaker, min(a) as a, arg_max(b, (a, b)) as b, sum(words) as words, sum(b - a) as speech, list(pause) filter (where fresh = 0) as pauses from t1 group by pid, task, span, k)"
)


def _talk(spark, sf_dir):
    said = base(spark, sf_dir, UT, "ut").where("speaker <> 'other'")
    ends = said.groupBy("pid").agg(F.max("b").alias("e"))
    piece = lambda task, a, b: ends.select("pid", F.lit(task).alias("task"), F.lit(-1).alias("half"), a.alias("a"), b.alias("b"))
    e = F.col("e")
    spans = reduce(DataFrame.union, [piece(1, F.lit(0.0), e / 3), piece(1, e / 2, e * 3 / 4), piece(2, e * 3 / 4, e + 1)])
    return said, spans


_FOUR = "quantile_cont({0}, 0.5) as med, avg({0}) as mean, quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25) as iqr, quantile_cont({0}, 0.9) as p90, count({0}) as k"
_STAT4 = ["med", "mean", "iqr", "p90"]


@operator(
    _TALK + f", du as (select pid, task, speaker, {_FOUR.format('b - a')} from tn group by all), wo as (select pid, task, speaker, {_FOUR.format('words')} from tn group by all), ar as (select pid, task, speaker, {_FOUR.format('words / speech')} from tn where speech > 0.3 group by all), sr as (select pid, task, speaker, {_FOUR.format('words / (b - a)')} from tn where b - a > 0.3 group by all),"
    f" pa as (select pid, task, speaker, {_FOUR.format('p')} from (select pid, task, speaker, unnest(pauses) as p from tn) z group by all), si as (select pid, task, speaker, avg(coalesce(len(pauses), 0)) as intraturn_pause_per_turn, case when sum(b - a) > 0 then (sum(b - a) - sum(speech)) / sum(b - a) end as intraturn_silence_frac, avg((b - a < 1)::int) as backchannel_frac from tn group by all),"
    " u as (" + " union all ".join(_unpivoted(s, f"speaker || '_{n}_'", _STAT4, "k >= 3") for s, n in (("du", "turn_dur"), ("wo", "turn_words"), ("ar", "artic_rate"), ("sr", "speak_rate"), ("pa", "intraturn_pause"))) + " union all " + _unpivoted("si", "speaker || '_'", ["intraturn_pause_per_turn", "intraturn_silence_frac", "backchannel_frac"], "intraturn_silence_frac is not null") + ")"
    " select pid, task, feature, round(value, 4) + 0.0 as value from u"
)
def turns_by_role(spark, sf_dir):
    """Length, words, articulation, speaking rate, pauses, silence and brevity of turns, of at least three."""
    said, spans = _talk(spark, sf_dir)
    return _long(conversation.features(said, spans), "_(turn_dur|turn_words|artic_rate|speak_rate)_(med|mean|iqr|p90)$|intraturn_|backchannel_frac$")


def _covered(source: str, keys: str) -> str:
    return f"(select {keys}, sum(e - s) as total from (select {keys}, isl, min(a) as s, max(b) as e from (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by {keys} order by a, b rows unbounded preceding) as isl from (select *, max(b) over (partition by {keys} order by a, b rows between unbounded preceding and 1 preceding) as reach from {source}) q0) q1 group by {keys}, isl) q2 group by {keys})"


@operator(
    _TALK + f", anyt as {_covered('cg', 'pid, task')}, own as {_covered('cg', 'pid, task, speaker')}, nt as (select pid, task, count(*) as n, count(*) filter (where speaker = 'child') as nc, count(*) filter (where speaker = 'examiner') as ne from tn group by all),"
    " z as (select pid, task, n::double as dyad_n_turns, n / (seconds / 60) as dyad_turn_rate_per_min, 1 - anyt.total / seconds as dyad_silence_frac, coalesce(c.total, 0) / anyt.total as dyad_child_speech_share, coalesce(c.total, 0) / seconds as child_speech_frac, coalesce(e.total, 0) / seconds as examiner_speech_frac, nc / (seconds / 60) as child_turn_rate_per_min, ne / (seconds / 60) as examiner_turn_rate_per_min"
    " from nt join sec using (pid, task) join anyt using (pid, task) left join (select * from own where speaker = 'child') c using (pid, task) left join (select * from own where speaker = 'examiner') e using (pid, task)),"
    " u as (" + _unpivoted("z", "''", ["dyad_n_turns", "dyad_turn_rate_per_min", "dyad_silence_frac", "dyad_child_speech_share", "child_speech_frac", "examiner_speech_frac", "child_turn_rate_per_min", "examiner_turn_rate_per_min"]) + ") select pid, task, feature, round(value, 4) + 0.0 as value from u"
)
def dyad_talk(spark, sf_dir):
    """Number and rate of turns, silence, shares of speech: over the union of the spans, with covered time for the shares."""
    said, spans = _talk(spark, sf_dir)
    return _long(conversation.features(said, spans), "n_turns$|[a-z]_turn_rate_per_min$|silence_frac$|speech_share$|speech_frac$").where("feature not like '%intraturn%'")


@operator(
    _TALK + f", ch as (select pid, task, speaker, a - lag(b) over w as o, lag(speaker) over w as before from tn window w as (partition by pid, task, span order by k)), f as (select pid, task, speaker, {_FOUR.format('o')}, avg((o > 2)::int) as initiate_frac from ch where before <> speaker group by all),"
    " cc as (select *, case when lag(speaker) over w <> speaker and a - lag(b) over w <= 3 then 0 else 1 end as fresh from tn window w as (partition by pid, task, span order by k)), ci as (select *, sum(fresh) over (partition by pid, task, span order by k rows unbounded preceding) as c from cc), cn as (select pid, task, arg_min(speaker, k) as who, count(*) as len from ci group by pid, task, span, c),"
    " al as (select pid, task, avg(len) as dyad_chain_mean, max(len) as dyad_chain_max, count(*) filter (where len >= 4) / (any_value(seconds) / 60) as dyad_chain_ge4_per_min, count(*) as dyad_chain_n from cn join sec using (pid, task) group by all),"
    " rl as (select 'child' as who, 'child' as s union all select 'examiner', 'exam'), wi as (select al.pid, al.task, s, avg(len) as m, max(len) as x, count(len) filter (where len >= 4) / (any_value(seconds) / 60) as g, count(len) as n from al cross join rl join sec on sec.pid = al.pid and sec.task = al.task left join cn on cn.pid = al.pid and cn.task = al.task and cn.who = rl.who group by al.pid, al.task, s),"
    " u as (" + _unpivoted("f", "speaker || '_fto_'", _STAT4, "k >= 3") + " union all " + _unpivoted("f", "speaker || '_'", ["initiate_frac"], "k >= 3") + " union all " + _unpivoted("al", "''", ["dyad_chain_mean", "dyad_chain_max", "dyad_chain_ge4_per_min", "dyad_chain_n"])
    + " union all select pid, task, 'dyad_chain_mean_' || s || '_init', m from wi where n > 0 union all select pid, task, 'dyad_chain_max_' || s || '_init', x from wi where n > 0 union all select pid, task, 'dyad_chain_ge4_per_min_' || s || '_init', g from wi union all select pid, task, 'dyad_chain_n_' || s || '_init', n from wi)"
    " select pid, task, feature, round(value, 4) + 0.0 as value from u"
)
def offsets_and_chains(spark, sf_dir):
    """Floor transfers by span, and exchange chains overall and by who began them, with zero rows."""
    said, spans = _talk(spark, sf_dir)
    return _long(conversation.features(said, spans), "_fto_|initiate_frac$|_chain_")


@operator(
    f"with {UT}, us as (select pid, speaker, a, b, text, turn from ut where speaker in ('child', 'examiner')), le as (select pid, max(b) as e from us group by pid), sg as (select pid, 2 as task, 0e0 as a, e / 2 as b from le where e >= 40 union all select pid, 2, e * 3 / 4, e from le where e >= 40),"
    " sec as (select pid, task, sum(b - a) as seconds from sg group by all), cu as (select us.pid, sg.task, sg.a as span, speaker, greatest(us.a, sg.a) as a, least(us.b, sg.b) as b, text, turn from us join sg on us.pid = sg.pid where least(us.b, sg.b) - greatest(us.a, sg.a) > 0.05),"
    " bl as (select pid, task, speaker, string_agg(text, '' order by span, a, turn, text) as blob from cu group by all), rl as (select 'child' as speaker, 'child' as s union all select 'examiner', 'exam'), kw as (select unnest(['the', 'and', 'ing ']) as w),"
    " z as (select sec.pid, sec.task, 'kw_' || s || '_' || w || '_per_min' as feature, (length(coalesce(blob, '')) - length(replace(coalesce(blob, ''), w, ''))) / length(w) / (seconds / 60) as value from sec cross join rl cross join kw left join bl on bl.pid = sec.pid and bl.task = sec.task and bl.speaker = rl.speaker)"
    " select pid, task, feature, round(value, 4) + 0.0 as value from z"
)
def keyword_blobs(spark, sf_dir):
    """Keywords a minute in all that a speaker says in a task, joined."""
    said = base(spark, sf_dir, UT, "ut").where("speaker <> 'other'").withColumnRenamed("turn", "n")
    ends = said.groupBy("pid").agg(F.max("b").alias("e")).where("e >= 40")
    spans = ends.select("pid", F.lit(2).alias("task"), F.lit(0.0).alias("a"), (F.col("e") / 2).alias("b")).union(ends.select("pid", F.lit(2), F.col("e") * 3 / 4, F.col("e")))
    held = windows.activities(spans, 0.0)
    cut = conversation.clipped(said, held.select(*CELL, F.inline("spans")), list(CELL))
    return _long(windows.keywords(cut, held, {2: ("the", "and", "ing ")}), ".")


@operator(
    _TALK + ", pc as (select cg.*, (a + b) / 2 as mid from cg), pp as (select pc.pid, pc.task, pc.span, pc.speaker, pc.a, pc.b, sum(greatest(0, least(pc.mid, g.b) - g.a)) / any_value(seconds) as p from pc join sg g on g.pid = pc.pid and g.task = pc.task join sec on sec.pid = pc.pid and sec.task = pc.task group by pc.pid, pc.task, pc.span, pc.speaker, pc.a, pc.b, pc.turn),"
    " hf as (select *, case when p >= 0.5 then 2 when p > 0 then 1 end as part from pp), h as (select * from hf where part is not null), cv as " + _covered("h", "pid, task, part, speaker") + ","
    " f0 as (select *, case when lag(speaker) over w = speaker and a - lag(b) over w <= 1 then 0 else 1 end as fresh from h window w as (partition by pid, task, span, part order by a, b)), tc as (select pid, task, part, speaker, sum(fresh) as n from f0 group by all),"
    " gr as (select s.pid, s.task, seconds, part, speaker from sec s join en using (pid, task), (select unnest([1, 2]) as part) x, (select unnest(['child', 'examiner']) as speaker) y where seconds > 2),"
    " v as (select pid, task, speaker, part, coalesce(total, 0) / (seconds / 2) as speech_frac, coalesce(n, 0) / (seconds / 120) as turn_rate from gr left join cv using (pid, task, part, speaker) left join tc using (pid, task, part, speaker)),"
    " d as (select pid, task, speaker, sum(speech_frac * (2 * part - 3)) as sf, sum(turn_rate * (2 * part - 3)) as tr from v group by all) select pid, task, 'win_' || speaker || '_speech_frac_delta' as feature, round(sf, 4) + 0.0 as value from d union all select pid, task, 'win_' || speaker || '_turn_rate_delta', round(tr, 4) + 0.0 from d"
)
def half_changes(spark, sf_dir):
    """Speech and turns of the second half of an activity less the first, turns built within the half and the span."""
    said, spans = _talk(spark, sf_dir)
    cut, seconds = conversation.gated(said, spans)
    held = windows.activities(spans, 0.0).join(seconds.select(*CELL), list(CELL))
    return _long(windows.speech_change(cut.drop("seconds"), held), ".")


# Statistics that decide

_Z = f"{FEAT}, g as (select f.pid, f.task, f.x, l.y from feat f join lab l using (pid) where f.x is not null), r as (select task, {rank('x', 'task')} as rx, {rank('y', 'task')} as ry from g), q as (select task, count(*) as n, {CORR} as rho from r group by task), z as (select task, n - 3 as w, atanh(rho) as z from q)"


def _observed(spark, sf_dir) -> DataFrame:
    rows = base(spark, sf_dir, FEAT, "feat").where("x is not null").join(base(spark, sf_dir, FEAT, "lab"), "pid")
    return rows.select("task", F.lit("mean").alias("target"), F.lit("x").alias("feature"), "pid", "x", "y")


@operator(f"with {_Z}, m as (select sum(w * z) / sum(w) as zb from z), s as (select sum(w * (z - zb) * (z - zb)) as q, count(*) as t from z, m) select t as n_tasks, round(q, 6) + 0.0 as q, case when t = 5 then round(exp(-q / 2) * (1 + q / 2), 6) end as p from s")
def heterogeneity_p(spark, sf_dir):
    """Cochran's Q over the tasks and its chi-square p."""
    fam = screening.families(_observed(spark, sf_dir), 0)
    return fam.select(F.col("n_tasks").cast("long").alias("n_tasks"), rounded(F.col("cochran_q")).alias("q"), F.round("p_chi2", 6).alias("p"))


@operator(
    f"with {_CROSS}, r as (select ta, tb, {rank('xa', 'ta, tb')} as ra, {rank('xb', 'ta, tb')} as rb, {rank('y', 'ta, tb')} as ry from ab), c as (select ta, tb, count(*) as n, corr(ra, ry) as pa, corr(rb, ry) as pb, corr(ra, rb) as rr from r group by ta, tb),"
    " d as (select *, 1 - pa * pa - pb * pb - rr * rr + 2 * pa * pb * rr as det, (pa + pb) / 2 as m from c where n >= 8), t as (select *, n - 3 as df, (pa - pb) * sqrt((n - 1) * (1 + rr) / (2 * (n - 1.0) / (n - 3) * det + m * m * power(1 - rr, 3))) as t from d),"
    # two-sided tail by Simpson's rule over the density
    " g as (select ta, tb, df, t, i, abs(t) * i / 2000.0 as v from t, range(0, 2001) s(i)), w as (select ta, tb, any_value(df) as df, any_value(t) as t, sum((case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * power(1 + v * v / df, -(df + 1) / 2.0)) * abs(any_value(t)) / 6000.0 as inside from g group by ta, tb)"
    " select ta, tb, df, round(t, 5) + 0.0 as t, round(1 - 2 * inside, 5) + 0.0 as p from w"
)
def williams_p(spark, sf_dir):
    """Williams's t of two tasks' correlations with one target, and its p."""
    got = screening.pair_contrasts(_observed(spark, sf_dir), times=0)
    return got.select(F.col("task_a").alias("ta"), F.col("task_b").alias("tb"), (F.col("n_cap") - 3).cast("long").alias("df"), rounded(F.col("t_hw"), 5).alias("t"), rounded(F.col("p_hw"), 5).alias("p"))


@operator(
    "with g as (select d.lang as grp, l.toxic, d.n_chars as x from documents d join labels l on d.doc_id = l.doc_id), r as (select *, rank() over (partition by grp order by x) + (count(*) over (partition by grp, x) - 1) / 2.0 as rx from g),"
    " ti as (select grp, sum(t * t * t - t) as ties from (select grp, x, count(*)::double as t from g group by grp, x) z group by grp), s as (select grp, count(*) filter (where toxic = 1) as n1, count(*) filter (where toxic = 0) as n0, sum(rx) filter (where toxic = 1) as r1 from r group by grp),"
    " u as (select grp, n1, n0, r1 - n1 * (n1 + 1) / 2.0 as u, ties from s join ti using (grp) where n1 >= 3 and n0 >= 3), z as (select *, (greatest(u, n1 * n0 - u) - n1 * n0 / 2.0 - 0.5) / sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1.0)))) as z from u),"
    " w as (select grp, n1, n0, u, ties, sum((case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-power(z * i / 2000.0, 2) / 2) / sqrt(2 * pi())) * any_value(z) / 6000.0 as inside from z, range(0, 2001) s(i) group by grp, n1, n0, u, ties)"
    " select grp, n1, n0, u, case when ties > 0 or least(n1, n0) > 8 then round(least(1.0, 1 - 2 * inside), 5) + 0.0 end as p from w"
)
def mann_whitney_p(spark, sf_dir):
    """U of toxic against other documents' lengths and its two-sided p; the exact p of small groups without ties is left to the tests."""
    rows = spark_sql(spark, sf_dir, "select d.lang as grp, l.toxic, d.n_chars as x from documents d join labels l on d.doc_id = l.doc_id")
    got = screening.mann_whitney(rows, ["grp"], "x", "toxic")
    p = F.when((F.col("ties") > 0) | (F.least("n1", "n0") > 8), rounded(F.col("p"), 5))
    return got.where("n1 >= 3 and n0 >= 3").select("grp", "n1", "n0", "u", p.alias("p"))


@operator(f"with {FEAT}, l as (select pid, task, 'x' as feature, x as v from feat union all select pid, task, 'top', top from feat union all select pid, task, 'sd', sd from feat), t as (select pid, 'mean' as target, y from lab union all select pid, 'n', n_all from lab), j as (select task, target, feature, l.pid, v, y from l join t using (pid) where v is not null and y is not null), r as (select task, target, feature, {rank('v', 'task, target, feature')} as rx, {rank('y', 'task, target, feature')} as ry from j), c as (select task, target, feature, count(*) as n, corr(rx, ry) as rho from r group by all), p as (select *, 1 - abs(rho) as p from c where n >= 8), b as (select *, count(p) over (partition by task, target) as m, row_number() over (partition by task, target order by p, feature) as i from p) select task, target, feature, n, round(rho, 6) + 0.0 as rho, m, round(least(1, min(p * m / i) over (partition by task, target order by p, feature rows between current row and unbounded following)), 6) as q from b")
def families_controlled(spark, sf_dir):
    """False discovery control within each task and target, of many features (p stands in: one less the correlation's size)."""
    rho = spearman(_features_and_targets(spark, sf_dir), ["task", "target", "feature"]).withColumn("p", 1 - F.abs("rho"))
    return screening.controlled(rho).select("task", "target", "feature", "n", rounded(F.col("rho")).alias("rho"), "m", F.round("q", 6).alias("q"))


@operator(f"with {FEAT}, g as (select f.pid, f.task, f.x, f.n_events as z, l.y from feat f join lab l using (pid) where f.x is not null), r as (select task, {rank('x', 'task')} as rx, {rank('y', 'task')} as ry, {rank('z', 'task')} as rz from g), c as (select task, count(*) as n, corr(rx, ry) as xy, corr(rx, rz) as xz, corr(ry, rz) as yz from r group by task), p as (select *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) as part from c) select task, n, round(xy, 6) + 0.0 as rho, round(yz, 6) + 0.0 as rho_duration, round(part, 6) + 0.0 as partial, false as rate_normalised, sign(part) = sign(xy) and abs(part) > 1e-9 as sign_survives from p")
def duration_partials(spark, sf_dir):
    """Correlations given the duration, with flags."""
    seconds = base(spark, sf_dir, FEAT, "feat").selectExpr("pid", "task", "cast(n_events as double) as seconds")
    got = screening.with_duration(_observed(spark, sf_dir), seconds)
    return got.select("task", "n", rounded(F.col("rho")).alias("rho"), rounded(F.col("rho_duration")).alias("rho_duration"), rounded(F.col("partial")).alias("partial"), "rate_normalised", "sign_survives")


def _features_and_targets(spark, sf_dir) -> DataFrame:
    feat, lab = base(spark, sf_dir, FEAT, "feat"), base(spark, sf_dir, FEAT, "lab")
    long = feat.select("pid", "task", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("value")) for k in ("x", "top", "sd")))).alias("f")).select("pid", "task", "f.*")
    targets = lab.select("pid", F.explode(F.array(F.struct(F.lit("mean").alias("target"), F.col("y").alias("y")), F.struct(F.lit("n").alias("target"), F.col("n_all").cast("double").alias("y")))).alias("t")).select("pid", "t.*")
    return staged(screening.observed(long, targets), "observed")


def stability_candidates(spark, sf_dir):
    """Half-split stability of 200 splits against the 0.95 quantile of 50 shuffles, by task, target and feature."""
    rows = _features_and_targets(spark, sf_dir)
    return screening.candidates(screening.stabilities(rows), screening.thresholds(screening.null_stabilities(rows)))


def validated_selection(spark, sf_dir):
    """Selection validated on each participant left out, with the 200 shuffles of the study that repeat all of it."""
    rows = _features_and_targets(spark, sf_dir).withColumn("source", F.lit("child"))
    cells = rows.select("task", "source", "target").distinct()
    return screening.selection_cells(rows, rows.select("task", "target").distinct().withColumn("tau", F.lit(0.5)), cells)


def validated_ridge(spark, sf_dir):
    """Ridge on each cell's best two features with repeated stratified folds; without its 1,000 permutations, which repeat all of it."""
    rows = _features_and_targets(spark, sf_dir).withColumn("source", F.lit("child"))
    hits = spearman(rows, ["task", "source", "target", "feature"]).withColumn("q", 1 - F.abs("rho")).withColumn("stability", F.abs("rho"))
    groups = rows.select("pid").distinct().select("pid", F.when(F.col("pid") % 3 == 0, "preterm").otherwise("other").alias("grp"))
    return screening.ridge_cells(rows, hits, groups, 0)


def pair_intervals(spark, sf_dir):
    """Contrasts of task pairs with BCa intervals of 4,999 draws by numpy's generator; restated in the tests."""
    return screening.pair_contrasts(_observed(spark, sf_dir))


def pool_intervals(spark, sf_dir):
    """Pool checks of task pairs with 2,000 draws; restated in the tests."""
    return screening.pool_checks(_observed(spark, sf_dir))


def heterogeneity_bootstrap(spark, sf_dir):
    """Heterogeneity over tasks with 9,999 draws; restated in the tests."""
    return screening.families(_observed(spark, sf_dir))


def largest_contrast(spark, sf_dir):
    """The largest contrast over task pairs with 4,999 draws; restated in the tests."""
    return screening.largest_contrasts(_observed(spark, sf_dir))


@operator(
    "with e as (select event_id, cast(extract(hour from ts) as int) as h, cast(extract(minute from ts) as int) as m, cast(extract(second from ts) as int) as s from events)"
    " select event_id, case event_id % 7 when 0 then h * 3600 + m * 60 + s when 1 then h * 3600 + m * 60 + s when 2 then (h * 60 + m) * 60 + s when 3 then (h * 60 + m) * 60 when 4 then s when 5 then m * 60 + s end::double as parsed from e"
)
def time_spellings(spark, sf_dir):
    """Every spelling of a time, and one that is none."""
    e = spark_sql(spark, sf_dir, "select event_id, hour(ts) as h, minute(ts) as m, second(ts) as s from events")
    h, m, s = (F.col(c).cast("string") for c in "hms")
    total = (F.col("h") * 60 + F.col("m")).cast("string")
    spelled = [F.concat_ws(":", h, m, s), F.concat(h, F.lit(":;"), m, F.lit("::"), s), F.concat(total, F.lit("分"), s, F.lit("秒")), F.concat(F.lit(" "), total, F.lit("分")), F.concat(s, F.lit("秒 ")), F.concat(m, F.lit("分"), s), F.lit("later")]
    told = F.element_at(F.array(*spelled), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", text.seconds(told, strict=False).alias("parsed"))


@operator(f"with {EV}, b as (select least(31, greatest(0, floor((x / 50 - 1 + 0.6) / 0.05)))::bigint as bin from ev where x / 50 - 1 >= -0.6 and x / 50 - 1 <= 1) select bin, round(-0.6 + bin * 0.05, 2) as lo, count(*) as n from b group by bin")
def correlation_histogram(spark, sf_dir):
    """The data of a histogram of 32 bins from -0.6 to 1, its last bin closed."""
    r = base(spark, sf_dir, EV, "ev").select((F.col("x") / 50 - 1).alias("r"))
    return screening.histogram(r, "r", -0.6, 1.0, 32).select("bin", F.round("lo", 2).alias("lo"), "n")


# Selections and lookups


@operator(f"with {EV}, q as (select pid, x, row_number() over (partition by pid order by t, event_id) as i from ev), b as (select pid, i, i - row_number() over (partition by pid order by i) as k from q where x >= 30), r as (select pid, min(i) as first, count(*) as length from b group by pid, k having count(*) >= 2), p as (select *, row_number() over (partition by pid order by length desc, first) as place from r) select pid, first, length, place from p where place <= 6")
def longest_runs(spark, sf_dir):
    """The six longest runs of large values."""
    rows = spark_sql(spark, sf_dir, f"with {EV} select pid, x, row_number() over (partition by pid order by t, event_id) as i from ev").withColumn("on", F.col("x") >= 30)
    return relational.longest_runs(rows, ["pid"], "i", "on", 6, 2).select("pid", F.col("first").cast("long").alias("first"), "length", F.col("place").cast("long").alias("place"))


@operator(f"with {FEAT}, c as (select pid, task, x - 50 as r, top > 90 as ok from feat where x is not null), k as (select *, row_number() over (partition by pid order by case when ok then 0 else 1 end, abs(r) desc, task) as i from c) select pid, task, round(r, 6) + 0.0 as r, case when ok then 'stage' else 'fallback' end as stage from k where i = 1")
def strongest_or_fallback(spark, sf_dir):
    """The strongest of those that pass, else of all."""
    rows = base(spark, sf_dir, FEAT, "feat").where("x is not null").withColumn("r", F.col("x") - 50)
    return relational.strongest(rows, ["pid"], "r", F.col("top") > 90, "task").select("pid", "task", rounded(F.col("r")).alias("r"), "stage")


@operator(f"with {EV}, c as (select pid, task, count(*) as n, min((t, event_id)) as f from ev group by pid, task), r as (select *, row_number() over (partition by pid order by n desc, f) as place from c) select pid, task, n, place from r where place <= 3")
def commonest_first_seen(spark, sf_dir):
    """The three commonest tasks, of equals the one seen first."""
    rows = base(spark, sf_dir, EV, "ev").withColumn("seen", F.struct("t", "event_id"))
    return relational.most_common(rows, ["pid"], "task", "seen", 3).select("pid", "task", "n", F.col("place").cast("long").alias("place"))


@operator(f"with {FEAT}, h as (select *, n_events // 4 as v from feat), e as (select list_distinct([quantile_cont(v, 0.0), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 1.0)]) as e from h), s as (select list_sort(e) as e from e), b as (select v, 1 + len(list_filter(e[2:len(e) - 1], lambda x: x < v)) as bin from h, s) select bin::bigint as bin, count(*) as n, min(v) as lo, max(v) as hi from b group by bin")
def distinct_quantile_bins(spark, sf_dir):
    """Quartile bins whose equal edges are one."""
    rows = base(spark, sf_dir, FEAT, "feat").withColumn("v", F.floor(F.col("n_events") / 4))
    return relational.quantile_bins(rows, "v").groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@operator(f"with {_CROSS}, r as (select ta, tb, ({rank('xa', 'ta, tb')} + {rank('xb', 'ta, tb')}) / 2 as z, {rank('y', 'ta, tb')} as ry from ab), q as (select *, {rank('z', 'ta, tb')} as rz from r) select ta, tb, count(*) as n, round(corr(z, ry), 6) + 0.0 as pooled, round(corr(rz, ry), 6) + 0.0 as again from q group by ta, tb")
def rerank_comparison(spark, sf_dir):
    """Pooled ranks as they are, and ranked anew."""
    return relational.reranked(base(spark, sf_dir, _CROSS, "ab"), ["ta", "tb"]).select("ta", "tb", "n", rounded(F.col("pooled")).alias("pooled"), rounded(F.col("again")).alias("again"))


@operator(f"with {EV}, o as (select pid, min(t) as t0 from ev group by pid), p as (select pid, i as part, t0 + i * 200000.0 as a, t0 + i * 200000.0 + 150000.0 as b from o, range(0, 30) s(i)) select e.pid, event_id, part, round(e.t - p.a, 3) as local from ev e join p on e.pid = p.pid and e.t >= p.a and e.t < p.b")
def recording_parts(spark, sf_dir):
    """The part of a recording that an event is in, and its time there."""
    ev = base(spark, sf_dir, EV, "ev")
    parts = ev.groupBy("pid").agg(F.min("t").alias("t0")).select("pid", "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("part")).select("pid", "part", (F.col("t0") + F.col("part") * 200000.0).alias("a"), (F.col("t0") + F.col("part") * 200000.0 + 150000.0).alias("b"))
    return relational.part_of(ev, parts, ["pid"]).select("pid", "event_id", "part", F.round("local", 3).alias("local"))


@operator(
    _TALK + ", cc as (select *, case when lag(speaker) over w <> speaker and a - lag(b) over w <= 3 then 0 else 1 end as fresh from tn window w as (partition by pid, task, span order by k)), ci as (select *, sum(fresh) over (partition by pid, task, span order by k rows unbounded preceding) as c from cc), cn as (select pid, task, arg_min(speaker, k) as who, count(*) as len from ci group by pid, task, span, c),"
    " rl as (select unnest(['child', 'examiner']) as initiator), e as (select sec.pid, sec.task, seconds, initiator from sec join en using (pid, task) cross join rl) select e.pid, e.task, initiator, count(len) as n, count(len) filter (where len >= 4) as ge4, round(count(len) filter (where len >= 4) / (any_value(seconds) / 60), 6) + 0.0 as ge4_per_min, count(len) > 0 as any from e left join cn on cn.pid = e.pid and cn.task = e.task and cn.who = e.initiator group by e.pid, e.task, initiator"
)
def initiator_counts(spark, sf_dir):
    """Chains that each person began, with rows of none."""
    said, seconds = conversation.gated(*_talk(spark, sf_dir))
    chains = conversation.chains(conversation.turns(said, conversation.SPAN), conversation.SPAN)
    return relational.initiated(chains, seconds, list(CELL)).select("pid", "task", "initiator", "n", "ge4", rounded(F.col("ge4_per_min")).alias("ge4_per_min"), "any")


@operator(f"with {_CROSS}, r as (select ta, tb, {rank('xa', 'ta, tb')} as rx, {rank('xb', 'ta, tb')} as ry from ab), c as (select ta, tb, corr(rx, ry) as r from r group by ta, tb) select ta, tb, round(r, 6) + 0.0 as r from c order by r desc, ta, tb limit 8")
def highest_eight(spark, sf_dir):
    """The eight pairs of tasks that agree best."""
    feat = base(spark, sf_dir, FEAT, "feat").select("task", "pid", F.lit("x").alias("feature"), F.col("x").alias("value"))
    r = screening.task_correlations(feat)
    return relational.top_rows(r, [F.col("r").desc(), F.col("task_a"), F.col("task_b")], 8).select(F.col("task_a").alias("ta"), F.col("task_b").alias("tb"), rounded(F.col("r")).alias("r"))


@operator(
    f"with {FEAT}, h as (select *, case when pid % 3 = 0 then 'child' else 'dyad' end as source from feat), j as (select pid, task, source, x as v, 'mean' as feature from h where x is not null union all select pid, task, source, top, 'top' from h), s as (select source, feature, task, avg(v) - 50 as rho, count(*) as n from j group by all), t as (select * from s where abs(rho) > 1)"
    " select source, feature, count(distinct task) as n_targets, string_agg(distinct task, '|' order by task) as targets, bool_or(task = 'click') as on_click, bool_or(task = 'view') as on_view, round(max(rho) filter (where task = 'click'), 6) + 0.0 as rho_click, round(max(rho) filter (where task = 'view'), 6) + 0.0 as rho_view from t group by source, feature"
)
def overlap_by_target(spark, sf_dir):
    """Targets that each feature hits, with a flag and a correlation for each target."""
    feat = base(spark, sf_dir, FEAT, "feat").withColumn("source", F.when(F.col("pid") % 3 == 0, "child").otherwise("dyad"))
    each = feat.select("source", "task", F.explode(F.array(F.struct(F.lit("mean").alias("feature"), F.col("x").alias("v")), F.struct(F.lit("top").alias("feature"), F.col("top").alias("v")))).alias("f")).select("source", "task", "f.*").where("v is not null")
    hits = each.groupBy("source", "feature", F.col("task").alias("target")).agg((F.avg("v") - 50).alias("rho"), F.count("*").alias("n")).where(F.abs("rho") > 1).withColumn("task", F.lit(1))
    got = screening.target_overlap(hits, ["click", "view"])
    return got.select("source", "feature", "n_targets", "targets", "on_click", "on_view", rounded(F.col("rho_click")).alias("rho_click"), rounded(F.col("rho_view")).alias("rho_view"))


for _query in (dyad_synchrony, head_entropy, body_spectrum, pair_intervals, pool_intervals, heterogeneity_bootstrap, largest_contrast, stability_candidates, validated_selection, validated_ridge):
    QUERIES[_query.__name__] = _query
