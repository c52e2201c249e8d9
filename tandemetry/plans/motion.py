"""Queries of key points, floor states, halves and permutations; they join those of the catalog.

Bindings: a pose frame is a row of embeddings, of the participant vec_id % 50 at
slot vec_id / 50; its first ten numbers are x and y of five joints (nose, left
and right wrist, left and right elbow) and the eleventh the shoulder width.
"""

from __future__ import annotations

from tandemetry.functions.staging import staged
from tandemetry.operators import resampled
from tandemetry.plans.catalog import CORR, EV, FEAT, TURNS, UT, _pieces, add, base, frames, operator, rank

POSE = (
    "ps as (select vec_id % 50 as pid, @div(vec_id, 50) as slot, j, cast(@at(embedding, 2 * j - 1) as double) as x, cast(@at(embedding, 2 * j) as double) as y, abs(cast(@at(embedding, 11) as double)) + 5e-2 as w"
    " from (select vec_id, embedding, @series(1, 5) as j from embeddings) e)"
)
SPEED = (
    POSE + ", md as (select *, @pct(w, 0.5) over (partition by pid, j order by slot rows between 4 preceding and 4 following) as scale from ps),"
    " nm as (select pid, slot, j, x / nullif(scale, 0) as x, y / nullif(scale, 0) as y from md),"
    " sp as (select pid, slot, j, x, y, sqrt(power(x - lag(x) over o, 2) + power(y - lag(y) over o, 2)) / 25e-2 as v from nm window o as (partition by pid, j order by slot)),"
    " ac as (select *, abs(v - lag(v) over (partition by pid, j order by slot)) / 25e-2 as acc from sp)"
)
QOM = SPEED + ", qm as (select pid, slot, avg(v) as q from ac group by pid, slot)"

add("scaled_keypoints", f"with {SPEED} select pid, j, count(x) as n, round(avg(x), 6) + 0.0 as x_mean, round(avg(y), 6) + 0.0 as y_mean from nm group by pid, j")
add(
    "keypoint_speeds",
    f"with {SPEED} select pid, j, count(v) as n, round(avg(v), 5) as speed_mean, round(@pct(v, 0.9), 5) as speed_p90, round(sum(v) * 25e-2 / nullif(count(*) * 25e-2 / 60e0, 0), 4) as path_per_min, round(avg(acc), 4) as accel_mean from ac group by pid, j",
)
add("quantity_of_motion", f"with {QOM} select pid, count(q) as n, round(avg(q), 5) as qom_mean, round(stddev_pop(q), 5) as qom_sd, round(sum(q) * 25e-2 / (count(*) * 25e-2 / 60e0), 4) as qom_per_min from qm group by pid")
add("wrist_asymmetry", f"with {SPEED}, s as (select pid, sum(case when j = 2 then v end) as l, sum(case when j = 3 then v end) as r from ac group by pid) select pid, round(abs(l - r) / nullif(l + r, 0), 6) as wrist_asym from s")
add(
    "contraction",
    f"with {SPEED}, b as (select pid, slot, case when count(x) = 5 and count(y) = 5 then (max(x) - min(x)) * (max(y) - min(y)) end as area from nm group by pid, slot) select pid, count(area) as n, round(avg(area), 5) as contraction_mean, round(stddev_pop(area), 5) as contraction_sd from b group by pid",
)
add("sway", f"with {SPEED} select pid, round(stddev_pop(x), 6) as sway_x, round(stddev_pop(y), 6) as sway_y from nm where j = 1 group by pid")
add("pose_frames", f"with {POSE}, f as (select pid, slot, count(x) as n from ps group by pid, slot) select pid, count(*) filter (where n > 0) as pose_frames from f group by pid")
add(
    "motion_share",
    f"with {QOM}, d as (select a.pid, a.q as c, b.q as e from qm a join qm b on b.pid = a.pid + 1 and b.slot = a.slot where a.q is not null and b.q is not null)"
    " select pid, count(*) as n, round(sum(c) / nullif(sum(c) + sum(e), 0), 6) as motion_share, round(covar_pop(c, e) / nullif(stddev_pop(c) * stddev_pop(e), 0), 5) + 0.0 as motion_corr from d group by pid",
)

_FRAMES = (
    f"{UT}, {frames()}, fr as (select pid, s, ((s * 37 + pid) % 23) / 10e0 as motion, ((s * 53 + pid * 7) % 31) - 15e0 as pitch from (select pid, @series(0, last) as s from fe) z),"
    " fm as (select fr.pid, fr.s, fr.motion, fr.pitch, coalesce(child, false) as own, coalesce(examiner, false) as other from fr left join fs on fr.pid = fs.pid and fr.s = fs.s)"
)
_IN = "case when count(*) filter (where {0}) > 16 then avg(case when {0} then motion end) end"
add(
    "motion_by_floor",
    f"with {_FRAMES}, m as (select pid, {_IN.format('own')} as own, {_IN.format('other')} as other, {_IN.format('not own and not other')} as silence from fm group by pid)"
    " select pid, round(own, 6) as motion_own_speech, round(other, 6) as motion_partner_speech, round(own / nullif(other, 0), 6) as motion_speech_ratio, round(silence, 6) as motion_silence from m",
)
add(
    "nod_rates",
    f"with {_FRAMES}, st as (select pid, s, own, other, pitch - lag(pitch) over (partition by pid order by s) as d from fm), bg as (select pid, s, case when own then 'speaking' else 'listening' end as state, sign(d) as sg from st where abs(d) >= 3 and (own or other)),"
    " ch as (select pid, state, sg, lag(sg) over (partition by pid, state order by s) as ls from bg), r as (select pid, state, case when count(*) >= 6 then avg(case when ls is null then null when sg <> ls then 1e0 else 0e0 end) / 25e-2 end as rate from ch group by pid, state),"
    " p as (select pid, max(case when state = 'listening' then rate end) as l, max(case when state = 'speaking' then rate end) as k from r group by pid) select pid, round(l, 5) as nod_listening, round(k, 5) as nod_speaking, round(l - k, 5) + 0.0 as nod_excess from p",
)
add("speak_minus_listen", f"with {_FRAMES} select pid, round(avg(case when own then motion end) - avg(case when other and not own then motion end), 6) + 0.0 as speak_minus_listen from fm group by pid")

add(
    "half_deltas",
    f"with {TURNS}, e as (select pid, min(a) as a0, max(b) as b0 from ut group by pid), c as (select t.pid, t.speaker, e.b0 - e.a0 as span, greatest(0e0, least(t.b, (e.a0 + e.b0) / 2) - t.a) as s1, greatest(0e0, t.b - greatest(t.a, (e.a0 + e.b0) / 2)) as s2 from tn t join e on t.pid = e.pid)"
    " select pid, speaker, round((sum(s2) - sum(s1)) / nullif(max(span) / 2, 0), 6) + 0.0 as speech_frac_delta, round((count(*) filter (where s2 > 0) - count(*) filter (where s1 > 0)) / nullif(max(span) / 120e0, 0), 5) + 0.0 as turn_rate_delta from c group by pid, speaker",
)
add(
    "velocity_delta",
    f"with {EV}, o as (select pid, min(t) as t0, max(t) as t1 from ev group by pid), f as (select ev.pid, case when t < (t0 + t1) / 2 then 1 else 2 end as half, t / 86400e0 as t, x, event_id from ev join o on ev.pid = o.pid),"
    " d as (select pid, half, abs(x - lag(x) over w) as dx, t - lag(t) over w as dt from f window w as (partition by pid, half order by t, event_id)), m as (select pid, half, case when count(*) >= 4 then @pct(dx / dt, 0.5) end as v from d where dt >= 0.1e0 and dt <= 0.6e0 group by pid, half)"
    " select pid, round(max(case when half = 2 then v end) - max(case when half = 1 then v end), 4) + 0.0 as yawvel_delta from m group by pid",
)
add(
    "gesture_rates",
    f"with {EV}, f as (select pid, @div(t, 21600) as frame, task, count(*) as n from ev group by pid, @div(t, 21600), task), g as (select pid, (max(t) - min(t)) / 86400e0 as days, count(distinct @div(t, 21600)) as frames from ev group by pid)"
    " select f.pid, f.task, round(count(*) / nullif(max(days), 0), 6) as per_day, round(max(frames) / greatest(max(days) / 25e-2, 1e0), 6) as frame_frac from f join g on f.pid = g.pid group by f.pid, f.task",
)

add("string_hash", "select p_partkey, @hash(p_name) as h, (@hash(p_name) * 7 + p_size) % 1000003 as seed from part")
add("role_pick", "select conv_id, role, turn, text from (select *, row_number() over (partition by conv_id, role order by turn, text) as i from conversations) z where i = 1")
add(
    "role_swaps",
    f"with {EV}, p as (select pid, t, event_id, x as cx, (event_id * 13) % 100 as cy, 100 - x as ex, (event_id * 29) % 100 as ey, h is not null as pair from ev),"
    " l as (select *, lag(pair) over w as was, lag(cx) over w as c0, lag(cy) over w as c1, lag(ex) over w as e0, lag(ey) over w as e1 from p window w as (partition by pid order by t, event_id)),"
    " d as (select pid, pair and was as paired, sqrt(power(cx - c0, 2) + power(cy - c1, 2)) + sqrt(power(ex - e0, 2) + power(ey - e1, 2)) as same, sqrt(power(cx - e0, 2) + power(cy - e1, 2)) + sqrt(power(ex - c0, 2) + power(ey - c1, 2)) as crossed from l)"
    " select pid, count(*) filter (where paired) as n_pairs, count(*) filter (where paired and crossed + 1e-6 < same) as n_swaps from d group by pid",
)
add(
    "diagnostics",
    f"with {EV}, d as (select pid, h, x, abs(x - lag(x) over (partition by pid order by t, event_id)) > 120 as jump from ev) select pid, count(*) as n, round(avg(case when h is not null then 1e0 else 0e0 end), 6) as ok_frac, round(@pct(x, 0.5), 4) as scale_median, round(avg(case when jump is null then null when jump then 1e0 else 0e0 end), 6) as jump_share from d group by pid",
)

_CELL = f"{FEAT}, ab as (select a.task as ta, b.task as tb, a.pid, a.x as xa, b.x as xb, l.y from feat a join feat b on a.pid = b.pid and a.task < b.task join lab l on l.pid = a.pid where a.x is not null and b.x is not null)"
_Z2 = "atanh(greatest(-0.999999e0, least(0.999999e0, {0})))"
add(
    "pair_contrast",
    f"with {_CELL}, r as (select ta, tb, {rank('xa', 'ta, tb')} as ra, {rank('xb', 'ta, tb')} as rb, {rank('y', 'ta, tb')} as ry from ab), c as (select ta, tb, count(*) as n, {CORR.replace('rx', 'ra')} as pa, {CORR.replace('rx', 'rb')} as pb from r group by ta, tb)"
    f" select ta, tb, n, round(pa - pb, 6) + 0.0 as delta_rho, round({_Z2.format('pa')} - {_Z2.format('pb')}, 6) + 0.0 as delta_z from c where n >= 12",
)
_SHUFFLED = (
    f"{_CELL}, yp as (select s.rep, s.pid, o.y from (select rep, pid, row_number() over (partition by rep order by md5(concat(rep, ':', pid)), pid) as slot from lab, (select @series(1, 500) as rep) q) s"
    " join (select rep, y, row_number() over (partition by rep order by pid) as own from lab, (select @series(1, 500) as rep) q2) o on s.rep = o.rep and s.slot = o.own),"
    " bb as (select 0 as rep, ta, tb, xa, xb, y from ab union all select yp.rep, ta, tb, xa, xb, yp.y from ab join yp on ab.pid = yp.pid),"
    f" rr as (select rep, ta, tb, {rank('xa', 'rep, ta, tb')} as ra, {rank('xb', 'rep, ta, tb')} as rb, {rank('y', 'rep, ta, tb')} as ry from bb),"
    f" cc as (select rep, ta, tb, count(*) as n, {CORR.replace('rx', 'ra')} as pa, {CORR.replace('rx', 'rb')} as pb, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) as rab from rr group by rep, ta, tb)"
)


def _shuffled(spark, sf_dir):
    """cc of _SHUFFLED: correlations of all pairs of tasks in each replicate."""
    pairs = base(spark, sf_dir, _CELL, "ab").select("ta", "tb", "pid", "xa", "xb")
    return staged(resampled.shuffled_pairs(pairs, base(spark, sf_dir, FEAT, "lab").select("pid", "y")), "shuffled")


@operator(
    f"with {_SHUFFLED}, dz as (select rep, ta, tb, abs({_Z2.format('pa')} - {_Z2.format('pb')}) as d from cc where n >= 12), mx as (select rep, max(d) as m from dz where rep > 0 group by rep)"
    " select o.ta, o.tb, round(max(o.d), 6) as d, round((1 + count(*) filter (where mx.m >= o.d - 1e-12)) / (1e0 + count(mx.m)), 6) as p_max from dz o cross join mx where o.rep = 0 group by o.ta, o.tb"
)
def max_statistic(spark, sf_dir):
    """p of each pair's difference against the largest difference of each permutation."""
    return _pieces(
        spark,
        f"with dz as (select rep, ta, tb, abs({_Z2.format('pa')} - {_Z2.format('pb')}) as d from {{cc}} where n >= 12), mx as (select rep, max(d) as m from dz where rep > 0 group by rep)"
        " select o.ta, o.tb, round(max(o.d), 6) as d, round((1 + count(*) filter (where mx.m >= o.d - 1e-12)) / (1e0 + count(mx.m)), 6) as p_max from dz o cross join mx where o.rep = 0 group by o.ta, o.tb",
        cc=_shuffled(spark, sf_dir),
    )


@operator(
    f"with {_SHUFFLED}, lm as (select rep, (case when abs(pa) >= abs(pb) then pb else pa end) / nullif(case when abs(pa) >= abs(pb) then pa else pb end, 0) as lam, sqrt(greatest(0e0, 2 * (1 + rab))) - 1 as star from cc where n >= 12),"
    " fr as (select rep, avg(case when lam is null then null when lam < star then 1e0 else 0e0 end) as frac from lm group by rep) select round(max(case when rep = 0 then frac end), 6) as observed, round(@pct(case when rep > 0 then frac end, 0.5), 6) as null_median, count(*) filter (where rep > 0) as n_null from fr"
)
def lambda_permutation(spark, sf_dir):
    """Share of pairs that pooling makes worse, as seen and in the median permutation."""
    return _pieces(
        spark,
        "with lm as (select rep, (case when abs(pa) >= abs(pb) then pb else pa end) / nullif(case when abs(pa) >= abs(pb) then pa else pb end, 0) as lam, sqrt(greatest(0e0, 2 * (1 + rab))) - 1 as star from {cc} where n >= 12),"
        " fr as (select rep, avg(case when lam is null then null when lam < star then 1e0 else 0e0 end) as frac from lm group by rep) select round(max(case when rep = 0 then frac end), 6) as observed, round(@pct(case when rep > 0 then frac end, 0.5), 6) as null_median, count(*) filter (where rep > 0) as n_null from fr",
        cc=_shuffled(spark, sf_dir),
    )


