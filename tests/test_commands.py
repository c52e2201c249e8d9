"""Command lines end to end on made recordings and labels."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_extraction import made_session

from tandemetry import commands
from tandemetry.functions import dimension


def csv(path):
    import glob

    return pd.concat([pd.read_csv(f, dtype={"participant_id": str, "pid": str}) for f in glob.glob(f"{path}/*.csv")], ignore_index=True)


def test_extract(spark, tmp_path):
    for k, pid in enumerate(("000001", "000002")):
        (tmp_path / pid).mkdir()
        (tmp_path / pid / f"{pid}_multimodal_session_v1.json").write_text(json.dumps(made_session(k)) if k == 0 else "{")
    (tmp_path / "c.yaml").write_text('participant_ids:\n  - "000001"\n  - "000002"\n')
    (tmp_path / "s.json").write_text(json.dumps({"1": [{"task_id": 2, "t0": "0:05", "t1": "1分40秒"}], "2": [{"task_id": 2, "t0": "0:05", "t1": "1:00"}]}))
    commands.main(["extract", "--data-root", str(tmp_path), "--cohort", str(tmp_path / "c.yaml"), "--task-segments", str(tmp_path / "s.json"), "--out", str(tmp_path / "o"), "--windows-only"], spark)
    got = csv(tmp_path / "o" / "windows")
    assert list(got.participant_id) == ["000001"] and got.task_id[0] == 2 and got.new_duration_sec[0] == 95
    assert list(csv(tmp_path / "o" / "failed").reason) == ["unreadable"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("study"), np.random.default_rng(0)
    ids, y = [f"1000{k:02d}" for k in range(30)], rng.normal(size=30)
    rows = [{"participant_id": p, "task_id": t} | {f: rng.normal() for f in dimension.FROZEN[:3]} | {"child_sway_y": (2 if t == 1 else -2) * v + rng.normal()} for t in (1, 2) for p, v in zip(ids, y, strict=True)]
    dynamics = pd.DataFrame(rows).reindex(columns=["participant_id", "task_id", *dimension.FROZEN])
    dynamics.to_csv(root / "d.csv", index=False)
    dynamics[["participant_id", "task_id"]].assign(new_duration_sec=rng.uniform(30, 90, len(dynamics)), win_child_yawvel_delta=rng.normal(size=len(dynamics))).to_csv(root / "w.csv", index=False)
    pd.DataFrame({"ID": ids, "属性": ["d" if k % 3 else "t" for k in range(30)]} | {c: y + rng.normal(size=30) * 0.2 * k for k, c in enumerate(dimension.TARGETS.values())}).to_csv(root / "l.csv", index=False)
    (root / "c.yaml").write_text("participant_ids:\n" + "".join(f'  - "{p}"\n' for p in ids))
    return root


def test_study(spark, tables):
    common = ["--features", f"{tables}/d.csv", "--windows", f"{tables}/w.csv", "--labels", f"{tables}/l.csv", "--cohort", f"{tables}/c.yaml", "--smoke"]
    run = lambda name, *more: commands.main([name, *common, "--out", f"{tables}/{name}", *more], spark)
    run("screen")
    hits = csv(f"{tables}/screen/hits_main")
    assert {(1, "child_sway_y"), (2, "child_sway_y")} <= set(zip(hits.task, hits.feature, strict=True)) and {"source", "family", "asr_risky", "n", "rho", "p", "q"} <= set(hits.columns)
    with pytest.raises(Exception, match="(?i)exist"):
        run("screen")
    found = ["--hits", f"{tables}/screen/hits_main"]
    run("overlap", *found)
    assert csv(f"{tables}/overlap/target_overlap").n_targets.max() >= 2
    run("pairs", *found)
    flips = csv(f"{tables}/pairs/signflip")
    assert len(flips) and (flips.p_boot < 0.05).all() and csv(f"{tables}/pairs/pool_verify").rho_a_excludes_0.all()
    run("ridge", *found)
    assert csv(f"{tables}/ridge/cells").rho.max() > 0.6
    run("lopo", *found, "--thresholds", f"{tables}/screen/thresholds", "--tasks", "1")
    cells = csv(f"{tables}/lopo/cells")
    assert set(cells.task) == {1} and "child_sway_y" in set(cells.selected)
    run("findings", *found)
    assert {"median_r", "n_pairs"} <= set(csv(f"{tables}/findings/r_by_feature").columns) and (csv(f"{tables}/findings/maxstat").p_max < 0.1).any()
    commands.main(["compare", "--old", f"{tables}/screen/stage_a", "--new", f"{tables}/screen/candidates", "--keys", "task,target,feature", "--value", "rho", "--out", f"{tables}/compare"], spark)
    assert csv(f"{tables}/compare/compare").n_moved[0] == 0


def test_dimension(spark):
    names = ["child_sway_y", "dyad_chain_max", "win_child_yawvel_delta", "ges_examiner_fidgeting_per_min", "ges_child_pose_frame_frac", "txt_child_question_frac", "rsp_n_exam_turns", "rsp_child_reply_frac", "kw_child_x_per_min", "child_qom_mean", "txt_examiner_n_utt", "examiner_speech_frac"]
    c = F.col("f")
    got = spark.createDataFrame([(n,) for n in names], "f string").select(c, dimension.source(c), dimension.family(c), dimension.asr_risky(c), dimension.kind(c, strict=False)).collect()
    want = [("child", "frozen34", False, "揺れ"), ("dyad", "frozen34", False, "やり取りの間"), ("child", "new_window", False, "首・頭の動き"), ("examiner", "new_gesture", False, "身振り"), ("child", "new_gesture", False, "映り"), ("child", "new_text", True, "質問"), ("dyad", "new_response", False, "発話の量"), ("dyad", "new_response", False, "やり取りの間"), ("other", "new_keyword", True, None), ("other", "new_other", False, None), ("examiner", "new_text", True, "発話の量"), ("examiner", "frozen34", False, "発話の量")]
    assert [tuple(r)[1:] for r in got] == want and len(dimension.FROZEN) == 34
    with pytest.raises(Exception, match="child_qom_mean"):
        spark.createDataFrame([("child_qom_mean",)], "f string").select(dimension.kind(c)).collect()
