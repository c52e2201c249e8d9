import json

import pytest

from tandemetry.sources import readers, writers


def test_segments_and_completeness(spark, tmp_path):
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"a": [{"task_id": 1, "t0": "1分40秒", "t1": "1:03:50"}, {"task_id": 2, "t0": "10::30", "t1": "10;45"}], "b": [], "7": [{"task_id": 3, "t0": "15秒", "t1": "2分5", "stage": "x"}]}))
    got = readers.task_segments(spark, str(file))
    assert sorted((r.pid, r.task or 0, r.a or 0, r.b or 0) for r in got.collect()) == [("000007", 3, 15, 125), ("a", 1, 100, 3830), ("a", 2, 630, 645), ("b", 0, 0, 0)]
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "pid string")
    assert sorted((r.pid, r.state) for r in readers.incomplete(ids, got).collect()) == [("b", "empty"), ("c", "missing")]
    with pytest.raises(ValueError, match="b, c"):
        readers.require_complete(ids, got)
    file.write_text("[1]")
    with pytest.raises(TypeError):
        readers.task_segments(spark, str(file))


def test_sessions_take_their_id_from_the_folder(spark, tmp_path):
    (tmp_path / "p 1").mkdir()
    (tmp_path / "p 1" / "session.json").write_text('{\n"frames": [{"t": 0.0}]\n}')
    got = readers.sessions(spark, f"{tmp_path}/*/session.json", "frames array<struct<t: double>>").collect()
    assert [(r.pid, len(r.frames)) for r in got] == [("p 1", 1)]


def test_one_bad_session_costs_only_itself(spark, tmp_path):
    for pid, text in (("p1", '{"frames": [{"t": 0.0}]}'), ("p2", '{"frames": ['), ("p3", "{}")):
        (tmp_path / pid).mkdir()
        (tmp_path / pid / "session.json").write_text(text)
    cohort = spark.createDataFrame([("p1",), ("p2",), ("p4",)], "pid string")
    good, failed = readers.readable_sessions(spark, f"{tmp_path}/*/session.json", "frames array<struct<t: double>>", cohort)
    assert sorted(r.pid for r in good.collect()) == ["p1", "p3"] and sorted(map(tuple, failed.collect())) == [("p2", "unreadable"), ("p4", "missing")]


def test_times_and_ids(spark):
    from pyspark.sql import functions as F

    from tandemetry.functions import text

    told = {"1:03:50": 3830, "10:30": 630, "10::30": 630, "10;30": 630, " 3分 ": 180, "15秒": 15, "2分5": 125, "1分40秒": 100, "x": None, "": None, "1:2:3:4": None, "分5": None}
    got = spark.createDataFrame([(k,) for k in told], "t string").select("t", text.seconds(F.col("t"), strict=False).alias("s")).collect()
    assert {r.t: r.s for r in got} == told
    with pytest.raises(Exception, match="not a time: x"):
        spark.createDataFrame([("x",)], "t string").select(text.seconds(F.col("t"))).collect()
    ids = spark.createDataFrame([(" 12.0",), ("d1-3",), ("1234567",), ("a.0",)], "t string").select(text.participant_id(F.col("t")).alias("i")).collect()
    assert [r.i for r in ids] == ["000012", "d1_3", "1234567", "a.0"]


def test_workbook(spark, tmp_path):
    import zipfile

    cell = lambda r, v, t="": f'<c r="{r}"{t}><v>{v}</v></c>'
    rows = "<row>" + cell("A1", 0, ' t="s"') + cell("B1", 1, ' t="s"') + "</row><row>" + cell("A2", 7) + cell("B2", 2, ' t="s"') + '</row><row><c r="A3" t="inlineStr"><is><t>7</t></is></c></row><row>' + cell("B4", "3.5") + "</row>"
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "l.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>ID</t></si><si><r><t>属</t></r><r><t>性</t></r></si><si><t>d</t></si></sst>')
    got = readers.labels(spark, str(tmp_path / "l.xlsx"), "ID")
    assert [(r.ID, r["属性"]) for r in got.collect()] == [("7", "d")]
    people = spark.createDataFrame([("7",), ("d12",), ("8",)], "pid string")
    assert sorted(map(tuple, readers.groups(people, got).collect())) == [("7", "preterm"), ("8", "other"), ("d12", "preterm")]


def test_features_labels_and_cohort(spark, tmp_path):
    (tmp_path / "f.csv").write_text("participant_id,x\n007,1.5\n8,n/a\n")
    got = readers.features(spark, str(tmp_path / "f.csv"), ["x"]).collect()
    assert [(r.participant_id, r.x) for r in got] == [("007", 1.5), ("8", None)]
    with pytest.raises(ValueError, match="y"):
        readers.features(spark, str(tmp_path / "f.csv"), ["y"])
    (tmp_path / "l.csv").write_text("ID,v\n 7.0,first\n7,second\n,none\n9,third\n")
    assert sorted((r.ID, r.v) for r in readers.labels(spark, str(tmp_path / "l.csv"), "ID").collect()) == [("7", "first"), ("9", "third")]
    (tmp_path / "c.yaml").write_text('# top\nname: x\nother:\n  - "no"\nparticipant_ids:\n  - "01"\n  - 02  # late\n')
    assert [r.pid for r in readers.cohort(spark, str(tmp_path / "c.yaml")).orderBy("place").collect()] == ["01", "02"]


def test_sinks(spark, tmp_path):
    writers.thresholds(spark, {"t": 0.25}, str(tmp_path / "t"))
    assert readers.thresholds(spark, str(tmp_path / "t")) == {"t": 0.25}
    with pytest.raises(Exception, match="(?i)exist"):
        writers.thresholds(spark, {"t": 0.5}, str(tmp_path / "t"))
    assert writers.finite({"a": float("nan"), "b": [1, float("inf")], "c": tmp_path}) == {"a": None, "b": [1, None], "c": str(tmp_path)}
    made = []
    for _ in range(2):
        assert writers.reused(spark, str(tmp_path / "r"), lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1
