"""Feature extraction end to end on made recordings, against a restatement with plain arrays."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tandemetry.functions import kernels
from tandemetry.operators import conversation, extraction, recordings, windows

ROLES = ("child", "examiner")
NAN = float("nan")


def made_session(seed):
    rng = random.Random(seed)
    timeline, t = [], 3.0
    for i in range(760):
        t += 0.25 if rng.random() < 0.97 else rng.choice([0.11, 0.5, 1.0])
        face, pose = [], []
        for k, role in enumerate(ROLES):
            if rng.random() < 0.97:
                yaw = 20 * math.sin(i / (7 + k)) + rng.gauss(0, 3) + (200 if rng.random() < 0.004 else 0)
                x = 100 + 200 * (k ^ (rng.random() < 0.02))
                face.append({"role": role, "role_confidence": rng.choice([0.9, 1.4, 0.6]), "det_score": rng.choice([0.9, 0.9, 0.9, 0.2]), "bbox": [x, 10, x + 40, 60] if rng.random() < 0.98 else [x, 10], "mar": rng.random() if rng.random() < 0.95 else None, "head_pose": {"yaw": yaw, "pitch": 5 * math.cos(i / 3) + rng.gauss(0, 2), "roll": rng.gauss(0, 4) if rng.random() < 0.97 else None}})
            if rng.random() < 0.98:
                base = {"nose": (0, -60), "left_shoulder": (-40, 0), "right_shoulder": (40, 0), "left_elbow": (-60, 40), "right_elbow": (60, 40), "left_wrist": (-50, 80), "right_wrist": (50, 80)}
                swing = 20 * math.sin(i / 5 + k)
                points = {j: {"x": 300 + a + rng.gauss(0, 2) + (swing if "wrist" in j else 0), "y": 200 + b + rng.gauss(0, 2), "visibility": 0.0 if rng.random() < 0.02 and "shoulder" not in j else 1.0} for j, (a, b) in base.items()}
                if rng.random() < 0.02:
                    points["left_shoulder"]["x"] = points["right_shoulder"]["x"] + 3
                    points["left_shoulder"]["y"] = points["right_shoulder"]["y"]
                pose.append({"role": role, "pose_quality": 0.9 if rng.random() < 0.97 else 0.1, "keypoints_px": points, "events": [{"type": e} for e in windows.EVENTS if rng.random() < 0.1] * 2})
        timeline.append({"time_sec": t, "face": face, "pose": pose})
    said, a = [], 2.0
    for _ in range(90):
        a += rng.choice([0.3, 0.8, 1.0, 2.5, 3.5])
        b = a + rng.choice([0.4, 0.9, 1.5, 3.0])
        said.append({"start": a, "end": b, "speaker": rng.choice([*ROLES, "other"]), "text": rng.choice(["うん", "なんですか", "先生、先生なって", "これはおやつ おいしい", "what? yes", ""]), "words": [{"start": a + (b - a) * k / 3} for k in range(3)]})
        a = b - (0.5 if rng.random() < 0.1 else 0)
    return {"timeline": timeline, "speech_segments": said, "task_segments": [{"task_id": 2, "session_start_sec": 5.0, "session_end_sec": 60.0}, {"task_id": 2, "session_start_sec": 60.0, "session_end_sec": 75.0}, {"task_id": 2, "session_start_sec": 110.0, "session_end_sec": 150.0}, {"task_id": 9, "session_start_sec": 75.0, "session_end_sec": 108.0}, {"task_id": 4, "session_start_sec": 150.0, "session_end_sec": 163.0}, {"task_id": 7, "session_start_sec": 9.0, "session_end_sec": 9.0}]}


# A restatement


def grid_of(doc):
    times = [f["time_sec"] for f in doc["timeline"]]
    n = round((times[-1] - times[0]) / 0.25) + 1
    out = {r: {k: np.full(n, NAN) for k in ("yaw", "pitch", "roll", "mar")} | {"face": np.zeros(n, bool), "pose": np.zeros(n, bool)} | {j: np.full((n, 2), NAN) for j in recordings.JOINTS} for r in ROLES}
    both, swap, before = np.zeros(n, bool), np.zeros(n, bool), None
    unit = lambda v: min(1.0, max(0.0, v))
    mid = lambda f: ((f["bbox"][0] + f["bbox"][2]) / 2, (f["bbox"][1] + f["bbox"][3]) / 2) if len(f["bbox"]) == 4 else None
    for f in doc["timeline"]:
        s = int(np.rint((f["time_sec"] - times[0]) / 0.25))
        faces = {x["role"]: x for x in f["face"] if unit(x["det_score"]) * unit(x["role_confidence"]) >= 0.25}
        both[s], swap[s] = len(faces) == 2, False
        if len(faces) == 2:
            now = [mid(faces[r]) for r in ROLES]
            if before and None not in now + before:
                swap[s] = math.dist(now[0], before[1]) + math.dist(now[1], before[0]) + 1e-6 < math.dist(now[0], before[0]) + math.dist(now[1], before[1])
            before = now
        else:
            before = None
        for r, x in faces.items():
            for a in ("yaw", "pitch", "roll"):
                out[r][a][s] = NAN if x["head_pose"][a] is None else x["head_pose"][a]
            out[r]["mar"][s] = NAN if x["mar"] is None else x["mar"]
            out[r]["face"][s] = True
        for x in f["pose"]:
            p = x["keypoints_px"]
            if x["pose_quality"] >= 0.25 and math.dist(*((p[f"{k}_shoulder"]["x"], p[f"{k}_shoulder"]["y"]) for k in ("left", "right"))) >= 15:
                out[x["role"]]["pose"][s] = True
                for j in recordings.JOINTS:
                    if p[j]["visibility"] > 0:
                        out[x["role"]][j][s] = p[j]["x"], p[j]["y"]
    for r in ROLES:
        for a in ("yaw", "pitch", "roll"):
            v = out[r][a]
            v[1:][np.abs(np.diff(v)) > 120] = NAN
        width = np.hypot(*(out[r]["left_shoulder"] - out[r]["right_shoulder"]).T)
        width[width < 15] = NAN
        near = [width[max(0, i - 60) : i + 61] for i in range(n)]
        scale = np.array([np.nanmedian(w) if np.isfinite(w).sum() >= 3 else np.nanmedian(width) for w in near])
        for j in recordings.JOINTS:
            out[r][j] = out[r][j] / scale[:, None]
    return times[0] + 0.25 * np.arange(n), out, both, swap


def merged(spans):
    out = []
    for a, b in sorted(s for s in spans if s[1] > s[0]):
        if out and a <= out[-1][1] + 1e-6:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def bundle(v, names, least):
    v = np.asarray(v, float)
    v = v[np.isfinite(v)]
    made = {"mean": np.mean, "rms": lambda x: np.sqrt(np.mean(x * x)), "med": np.median, "p90": lambda x: np.percentile(x, 90), "iqr": lambda x: np.percentile(x, 75) - np.percentile(x, 25)}
    return {k: made[k](v) for k in names} if len(v) >= least else {}


FIVE, FOUR = ("mean", "rms", "med", "p90", "iqr"), ("med", "mean", "iqr", "p90")


def stretches(flags, least):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            if i - start >= least:
                out.append((start, i))
            start = None
    return out


def turns_of(said, spans):
    groups = []
    for a, b in spans:
        cut = sorted((max(u["start"], a), min(u["end"], b), i) for i, u in enumerate(said) if u["speaker"] in ROLES and min(u["end"], b) - max(u["start"], a) > 0.05)
        group = []
        for x, y, i in cut:
            u = said[i]
            words = sum(x - 0.05 <= w["start"] <= y + 0.05 for w in u["words"])
            if group and group[-1]["who"] == u["speaker"] and x - group[-1]["b"] <= 1:
                t = group[-1]
                t["pauses"].append(x - t["b"])
                t["b"], t["words"], t["speech"] = y, t["words"] + words, t["speech"] + y - x
                t["utts"].append((x, y, u["text"]))
            else:
                group.append({"who": u["speaker"], "a": x, "b": y, "words": words, "speech": y - x, "pauses": [], "utts": [(x, y, u["text"])]})
        groups.append(group)
    return groups


def length(spans):
    return sum(b - a for a, b in merged(spans))


def restated(doc, spans, mask, t, g, swap):
    f = {}

    def put(prefix, got):
        f.update({f"{prefix}_{k}": v for k, v in got.items()})

    energy = {}
    for r in ROLES:
        d = g[r]
        valid = mask & d["face"]
        speeds = []
        for a in ("yaw", "pitch", "roll"):
            x = np.where(valid, d[a], NAN)
            known = x[np.isfinite(x)]
            if valid.sum() / 240 <= 0.05 or len(known) < 8:
                continue
            dx = np.diff(x)
            put(f"{r}_{a}", {"rms_disp": known.std(), "range": np.percentile(known, 95) - np.percentile(known, 5), "rot_per_min": np.nansum(abs(dx)) / (valid.sum() / 240)})
            put(f"{r}_{a}_angvel", bundle(abs(dx) / 0.25, FIVE, 4))
            put(f"{r}_{a}_angacc", bundle(abs(np.diff(dx)) / 0.0625, FIVE, 4))
            s = np.sign(dx[np.isfinite(dx)])
            if len(s) > 8:
                f[f"{r}_{a}_reversal_rate"] = np.mean(s[1:] != s[:-1]) * 4
            speeds.append(dx)
            if a != "roll":
                runs = sorted((x[i:j] for i, j in stretches(np.isfinite(x), 48)), key=len, reverse=True)[:6]
                es = kernels.multiscale_entropy(runs)
                put(f"{r}_{a}", {f"sampen_s{k + 1}": v for k, v in enumerate(es)})
                fin = [v for v in es if v == v]
                if len(fin) > 1:
                    f[f"{r}_{a}_mse_slope"] = fin[-1] - fin[0]
        if len(speeds) == 3:
            put(f"{r}_head_speed", bundle(np.sqrt(sum(v * v for v in speeds)) / 0.25, FIVE, 4))
        valid = mask & d["pose"]
        minutes = valid.sum() / 240
        speed = {}
        for j in ("nose", "left_wrist", "right_wrist", "left_elbow", "right_elbow"):
            v = np.hypot(*np.diff(np.where(valid[:, None], d[j], NAN), axis=0).T) / 0.25
            speed[j] = v
            put(f"{r}_{j}_speed", bundle(v, FIVE, 4))
            put(f"{r}_{j}_accel", bundle(abs(np.diff(v)) / 0.25, FIVE, 4))
            f[f"{r}_{j}_path_per_min"] = np.nansum(v) * 0.25 / minutes
        f[f"{r}_pose_frames"] = valid.sum()
        stack = np.vstack(list(speed.values()))
        q = np.array([np.mean(c[np.isfinite(c)]) if np.isfinite(c).any() else NAN for c in stack.T])
        energy[r] = np.concatenate([[NAN], q])
        put(f"{r}_qom", bundle(q, FIVE, 4))
        f[f"{r}_qom_per_min"] = np.nansum(q) * 0.25 / minutes
        known = q[np.isfinite(q)]
        if len(known) > 16:
            fast = stretches(known >= 1, 1)
            put(r, {"still_frac": np.mean(known < 0.2), "burst_frac": np.mean(known >= 1), "burst_rate_per_min": len(fast) / minutes, "burst_dur_mean": np.mean([j - i for i, j in fast]) * 0.25 if fast else 0})
            best = max(stretches(np.isfinite(q), 64), key=lambda x: x[1] - x[0], default=None)
            if best:
                put(r, kernels.spectrum(q[slice(*best)]) | {"qom_sampen": kernels.sample_entropy(q[slice(*best)])})
        l, w = np.nansum(speed["left_wrist"]), np.nansum(speed["right_wrist"])
        f[f"{r}_wrist_asym"] = abs(l - w) / (l + w)
        five = np.stack([d[j] for j in ("left_shoulder", "right_shoulder", "left_wrist", "right_wrist", "nose")])
        full = valid & np.isfinite(five).all(axis=(0, 2))
        area = np.ptp(five[:, full], axis=0).prod(axis=1)
        put(r, {"contraction_mean": area.mean(), "contraction_sd": area.std()} if len(area) > 16 else {})
        nose = d["nose"][valid & np.isfinite(d["nose"]).all(axis=1)]
        put(r, {"sway_x": nose[:, 0].std(), "sway_y": nose[:, 1].std()} if len(nose) > 16 else {})
    pairs = {"motion": (energy["child"], energy["examiner"], mask)}
    seen = mask & g["child"]["face"] & g["examiner"]["face"] & ~swap
    pairs |= {a: (g["child"][a], g["examiner"][a], seen) for a in ("yaw", "pitch")}
    for s, (a, b, m) in pairs.items():
        ok = m & np.isfinite(a) & np.isfinite(b)
        put(f"dyad_{s}", kernels.windowed_sync([(a[i:j], b[i:j]) for i, j in stretches(ok, 60)]))
        if s != "pitch":
            put(f"dyad_{s}", kernels.pooled_recurrence([(a[i:j], b[i:j]) for i, j in sorted(stretches(ok, 120), key=lambda x: x[0] - x[1])[:8]]))
        if s == "motion" and ok.sum() > 64:
            f["dyad_motion_share_child"], f["dyad_motion_corr"] = a[ok].sum() / (a[ok].sum() + b[ok].sum()), np.corrcoef(a[ok], b[ok])[0, 1]
    groups = turns_of(doc["speech_segments"], spans)
    turns = [x for grp in groups for x in grp]
    seconds = sum(b - a for a, b in spans)
    if seconds > 1 and sum(len(x["utts"]) for x in turns) >= 4:
        talk = {r: [u[:2] for x in turns if x["who"] == r for u in x["utts"]] for r in ROLES}
        any_ = length(talk["child"] + talk["examiner"])
        put("dyad", {"n_turns": len(turns), "turn_rate_per_min": len(turns) / seconds * 60, "silence_frac": 1 - any_ / seconds, "child_speech_share": length(talk["child"]) / any_})
        changes = [(p, c) for grp in groups for p, c in zip(grp, grp[1:], strict=False) if p["who"] != c["who"]]
        for r in ROLES:
            mine = [x for x in turns if x["who"] == r]
            held = np.array([x["b"] - x["a"] for x in mine])
            put(r, {"speech_frac": length(talk[r]) / seconds, "turn_rate_per_min": len(mine) / seconds * 60})
            if mine:
                put(f"{r}_turn_dur", bundle(held, FOUR, 3))
                put(f"{r}_turn_words", bundle([x["words"] for x in mine], FOUR, 3))
                put(f"{r}_artic_rate", bundle([x["words"] / x["speech"] for x in mine if x["speech"] > 0.3], FOUR, 3))
                put(f"{r}_speak_rate", bundle([x["words"] / (x["b"] - x["a"]) for x in mine if x["b"] - x["a"] > 0.3], FOUR, 3))
                pauses = [p for x in mine for p in x["pauses"]]
                put(f"{r}_intraturn_pause", bundle(pauses, FOUR, 3))
                put(r, {"intraturn_pause_per_turn": len(pauses) / len(mine), "intraturn_silence_frac": 1 - sum(x["speech"] for x in mine) / held.sum(), "backchannel_frac": np.mean(held < 1)})
            gaps = np.array([c["a"] - p["b"] for p, c in changes if c["who"] == r])
            if len(gaps) >= 3:
                put(f"{r}_fto", bundle(gaps, FOUR, 3))
                f[f"{r}_initiate_frac"] = np.mean(gaps > 2)
        size = {r: np.array([x["b"] - x["a"] for x in turns if x["who"] == r]) for r in ROLES}
        if min(map(len, size.values())) >= 4:
            f["dyad_turn_dur_ratio"] = np.median(size["child"]) / np.median(size["examiner"])
            if len(changes) >= 6:
                f["dyad_turn_dur_entrain"] = np.corrcoef([p["b"] - p["a"] for p, _ in changes], [c["b"] - c["a"] for _, c in changes])[0, 1]
            cut = len(turns) // 2
            part = [[np.median([x["b"] - x["a"] for x in h if x["who"] == r] or [NAN]) for r in ROLES] for h in (turns[:cut], turns[cut:])]
            f["dyad_turn_convergence"] = abs(part[0][0] - part[0][1]) - abs(part[1][0] - part[1][1])
        chains = []
        for grp in groups:
            for k, x in enumerate(grp):
                if k and grp[k - 1]["who"] != x["who"] and x["a"] - grp[k - 1]["b"] <= 3:
                    chains[-1][1] += 1
                else:
                    chains.append([x["who"], 1])
        for suffix, who in (("", None), ("_exam_init", "examiner"), ("_child_init", "child")):
            n = [c for w, c in chains if who in (None, w)]
            put("dyad_chain", {f"n{suffix}": len(n), f"ge4_per_min{suffix}": sum(c >= 4 for c in n) / seconds * 60} | ({f"mean{suffix}": np.mean(n), f"max{suffix}": max(n)} if n else {}))
    speaks = {r: np.zeros(len(t), bool) for r in ROLES}
    for u in doc["speech_segments"]:
        if u["speaker"] in ROLES:
            speaks[u["speaker"]] |= (t >= u["start"] - 0.125) & (t < u["end"] + 0.125)
    quiet = ~speaks["child"] & ~speaks["examiner"]
    for r, o in (ROLES, ROLES[::-1]):
        me = energy[r]
        state = {k: me[mask & m & np.isfinite(me)] for k, m in (("own", speaks[r]), ("other", speaks[o]), ("quiet", quiet))}
        if len(state["own"]) > 16 and len(state["other"]) > 16:
            put(r, {"motion_own_speech": state["own"].mean(), "motion_partner_speech": state["other"].mean(), "motion_speech_ratio": state["own"].mean() / state["other"].mean()})
        if len(state["quiet"]) > 16 and len(state["other"]) > 16:
            f[f"{r}_motion_silence"] = state["quiet"].mean()
        dp = np.concatenate([[NAN], np.diff(g[r]["pitch"])])
        nod = {}
        for k, m in (("listening", speaks[o]), ("speaking", speaks[r])):
            s = dp[mask & g[r]["face"] & m & (np.abs(dp) >= 3)]
            if len(s) >= 6:
                nod[k] = f[f"{r}_nod_rate_{k}"] = np.mean(np.sign(s[1:]) != np.sign(s[:-1])) * 4
        if len(nod) == 2:
            f[f"{r}_nod_listen_excess"] = nod["listening"] - nod["speaking"]
        mouth = [(m := g[r]["mar"][mask & g[r]["face"] & speaks[k]])[np.isfinite(m)] for k in (r, o)]
        if min(map(len, mouth)) > 16:
            f[f"{r}_mar_speak_minus_listen"] = mouth[0].mean() - mouth[1].mean()
    return f


def cells_of(doc, mode, least=30.0):
    t, g, both, swap = grid_of(doc)
    by = defaultdict(list)
    for s in doc["task_segments"]:
        by[s["task_id"]].append((s["session_start_sec"], s["session_end_sec"]))
    masks = {k: np.any([(t >= a) & (t < b) for a, b in merged(v)], axis=0) if merged(v) else np.zeros(len(t), bool) for k, v in by.items()}
    if mode == "session":
        spans = merged([x for v in by.values() for x in v])
        masks, by = {-1: np.any([(t >= a) & (t < b) for a, b in spans], axis=0)}, {-1: spans}
    kept = {k: m for k, m in masks.items() if mode == "session" or m.sum() * 0.25 >= least}
    out = {}
    if mode in ("tasks", "session"):
        out = {(k, -1): (m, merged(by[k])) for k, m in kept.items()}
    else:
        halves = {}
        for k, m in kept.items():
            at = np.flatnonzero(m)
            for h in (0, 1):
                half = np.zeros(len(t), bool)
                half[at[: len(at) // 2] if h == 0 else at[len(at) // 2 :]] = True
                key = (k if mode == "halves" else -1, h)
                halves[key] = halves.get(key, np.zeros(len(t), bool)) | half
        out = {key: (m, [[t[i], t[j - 1] + 0.25] for i, j in stretches(m, 1)]) for key, m in halves.items()}
    return {key: restated(doc, spans, m, t, g, swap) for key, (m, spans) in out.items()}


@pytest.fixture(scope="module")
def docs():
    return {f"p{k}": made_session(k) for k in range(2)}


@pytest.fixture(scope="module")
def sessions(spark, docs, tmp_path_factory):
    from tandemetry.sources import readers

    root = tmp_path_factory.mktemp("sessions")
    for pid, doc in docs.items():
        (root / pid).mkdir()
        (root / pid / "session.json").write_text(json.dumps(doc))
    out = readers.sessions(spark, f"{root}/*/session.json", recordings.SESSION).cache()
    yield out
    out.unpersist()


@pytest.mark.parametrize("mode", ["tasks", "session", "halves", "session_halves"])
def test_dynamics_equal_a_restatement(spark, docs, sessions, mode):
    rows = extraction.dynamics(sessions, mode=mode).collect()
    got = {(r.pid, r.task, r.half): r.asDict() for r in rows}
    want = {(pid, *key): f for pid, doc in docs.items() for key, f in cells_of(doc, mode).items()}
    assert set(got) == set(want)
    names, wrong = set(extraction.dynamics_names()), []
    for key, f in want.items():
        assert set(f) <= names, set(f) - names
        for k in names:
            w, v = f.get(k, NAN), got[key][k]
            if (w == w) != (v is not None) or v is not None and abs(v - w) > 1e-6 * max(1, abs(w)):
                wrong.append((key, k, v, w))
    assert not wrong, wrong[:12]
    assert sum(v == v for f in want.values() for v in f.values()) > 250 * len(want)


def test_windows_equal_a_restatement(spark, docs, sessions):
    got = {(r.pid, r.task): r.asDict() for r in extraction.windows_rows(sessions).collect()}
    names = set(extraction.windows_names())
    for pid, doc in docs.items():
        by = defaultdict(list)
        for s in doc["task_segments"]:
            by[s["task_id"]].append((s["session_start_sec"], s["session_end_sec"]))
        for task, raw in by.items():
            spans = merged(raw)
            seconds = sum(b - a for a, b in spans)
            if seconds < 20:
                assert (pid, task) not in got
                continue
            done = lambda x: sum(max(0, min(x, b) - a) for a, b in spans) / seconds  # noqa: B023, E731
            f = {"new_duration_sec": seconds, "new_n_task_spans": len(spans)}
            groups = turns_of(doc["speech_segments"], spans)
            said = [[(x["who"], *u) for x in grp for u in x["utts"]] for grp in groups]
            part = {}
            for h in (0, 1):
                kept = [sorted((a, b, who) for who, a, b, _ in grp if (0 < done((a + b) / 2) < 0.5 if h == 0 else done((a + b) / 2) >= 0.5)) for grp in said]
                n = defaultdict(int)
                for grp in kept:
                    for k, (a, _, who) in enumerate(grp):
                        n[who] += not (k and grp[k - 1][2] == who and a - grp[k - 1][1] <= 1)
                for r in ROLES:
                    part[r, h] = length([(a, b) for grp in kept for a, b, who in grp if who == r]) / (seconds / 2), n[r] / (seconds / 120)
            frames = [(x, fr) for fr in doc["timeline"] for x in [fr["time_sec"]] if any(a <= x < b for a, b in spans)]
            for r in ROLES:
                f[f"win_{r}_speech_frac_delta"], f[f"win_{r}_turn_rate_delta"] = (part[r, 1][k] - part[r, 0][k] for k in (0, 1))
                med = []
                for h in (0, 1):
                    v = [(x, face["head_pose"]["yaw"]) for x, fr in frames for face in fr["face"] if face["role"] == r and (0 < done(x) < 0.5) == (h == 0)]
                    med.append(np.median([abs(y2 - y1) / (x2 - x1) for (x1, y1), (x2, y2) in zip(v, v[1:], strict=False) if 0.1 <= x2 - x1 <= 0.6]))
                f[f"win_{r}_yawvel_delta"] = med[1] - med[0]
                poses = [p for _, fr in frames for p in fr["pose"] if p["role"] == r]
                f[f"ges_{r}_pose_frame_frac"] = len(poses) / (seconds * 4)
                for e in windows.EVENTS:
                    f[f"ges_{r}_{e}_per_min"] = sum(any(x["type"] == e for x in p["events"]) for p in poses) / seconds * 60
                mine = sorted((a, b, x) for grp in said for who, a, b, x in grp if who == r)
                sizes = np.array([len(x) for *_, x in mine])
                asks = [bool(x.strip()) and (x.strip()[-1] in "？?かの" or "?" in x or "？" in x) for *_, x in mine]
                brief = [b - a < 1 and len(x.strip()) <= 4 or x.strip() in windows.ASSENT for a, b, x in mine]
                f |= {f"txt_{r}_n_utt": len(mine), f"txt_{r}_question_frac": np.mean(asks), f"txt_{r}_backchannel_frac": np.mean(brief), f"txt_{r}_utt_char_cv": sizes.std() / sizes.mean(), f"txt_{r}_chars_per_min": sizes.sum() / seconds * 60}
                for w in windows.KEYWORDS.get(task, ()):
                    f[f"kw_{'exam' if r == 'examiner' else r}_{w}_per_min"] = "".join(x for *_, x in mine).count(w) / seconds * 60
            after = [(p, c) for grp in groups for p, c in zip(grp, grp[1:], strict=False) if p["who"] == "examiner"]
            gaps = np.array([c["a"] - p["b"] for p, c in after if c["who"] == "child"])
            f |= {"rsp_n_exam_turns": len(after), "rsp_child_reply_frac": sum((gaps >= 0) & (gaps <= 2)) / len(after), "rsp_after_exam_gap_med": np.median(gaps), "rsp_after_exam_gap_p90": np.percentile(gaps, 90), "rsp_long_silence_frac": np.mean(gaps > 2)}
            assert set(f) <= names
            wrong = [(k, got[pid, task][k], f.get(k)) for k in names if (f.get(k, NAN) == f.get(k, NAN)) != (got[pid, task][k] is not None) or k in f and got[pid, task][k] is not None and abs(got[pid, task][k] - f[k]) > 1e-6 * max(1, abs(f[k]))]
            assert not wrong, (pid, task, wrong[:10])
