"""Readers of the files that a study consists of, as DataFrames.

A missing or malformed file is an error where the caller cannot go on without
it, and a row of a report where it can.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterable
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemetry.functions.text import participant_id, seconds

SEGMENTS = "map<string, array<struct<task_id: int, t0: string, t1: string, stage: string, stage_ja: string>>>"


def sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per session document, with pid from the folder that holds it.  A document is one task: it is not splittable."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.url_decode(folder).alias("pid"), "*")


def readable_sessions(spark: SparkSession, path: str, schema: str, cohort: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the sessions that can be read, pid and reason of the others): one bad document costs only its own participant.

    A document that is no JSON object of the schema is `unreadable`; with a cohort (pid), one without a document is `missing`.
    """
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    text = spark.read.text(path, wholetext=True).select(F.url_decode(folder).alias("pid"), "value")
    every = text.select("pid", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("d")).withColumn("bad", F.col("d").isNull() | F.col("d._bad").isNotNull())
    failed = every.where("bad").select("pid", F.lit("unreadable").alias("reason"))
    if cohort is not None:
        failed = failed.union(cohort.select("pid").join(text.select("pid"), "pid", "left_anti").select("pid", F.lit("missing")))
    return every.where("not bad").select("pid", "d.*").drop("_bad"), failed


def task_segments(spark: SparkSession, path: str) -> DataFrame:
    """pid, task, a, b (seconds), stage, stage_ja of a JSON object keyed by pid, its times as texts; anything but an object raises TypeError.

    A participant with an empty list has one row without a task.
    """
    text = spark.read.text(path, wholetext=True)
    if text.where(~F.coalesce(F.ltrim("value").startswith("{"), F.lit(False))).limit(1).count():
        raise TypeError("a segment file must be an object keyed by participant")
    parsed = text.select(F.explode(F.from_json("value", SEGMENTS, {"mode": "FAILFAST"})).alias("pid", "spans"))
    each = parsed.select(participant_id(F.col("pid")).alias("pid"), F.inline_outer("spans"))
    return each.select("pid", F.col("task_id").alias("task"), seconds(F.col("t0")).alias("a"), seconds(F.col("t1")).alias("b"), "stage", "stage_ja")


def incomplete(cohort: DataFrame, segments: DataFrame) -> DataFrame:
    """pid of the cohort's participants that have no segment, and whether they are missing or empty."""
    state = segments.groupBy("pid").agg(F.count("task").alias("n"))
    joined = cohort.select("pid").distinct().join(state, "pid", "left")
    return joined.where("coalesce(n, 0) = 0").select("pid", F.when(F.col("n").isNull(), "missing").otherwise("empty").alias("state"))


def require_complete(cohort: DataFrame, segments: DataFrame) -> None:
    """Raise ValueError naming the first participants without segments."""
    lacking = [r.pid for r in incomplete(cohort, segments).orderBy("pid").limit(20).collect()]
    if lacking:
        raise ValueError(f"participants without segments: {', '.join(lacking)}")


def features(spark: SparkSession, path: str, required: Iterable[str], ids: tuple[str, ...] = ("participant_id",)) -> DataFrame:
    """A feature table with text ids and numeric columns; a missing required column raises ValueError, text that is no number is null."""
    raw = spark.read.option("header", True).csv(path)
    lacking = sorted({*required, *ids} - set(raw.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return raw.select(*(F.col(f"`{c}`") if c in ids else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in raw.columns))


def normal_id(c: str):
    """Ids trimmed, without the '.0' of a number read as text, with `_` for `-`."""
    return F.replace(F.regexp_replace(F.trim(F.col(c)), r"\.0$", ""), F.lit("-"), F.lit("_"))


def sheet(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet as texts, row by row; short rows are filled up."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{{{ns['m']}}}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))[0]
        rows = []
        for row in ElementTree.fromstring(book.read(first)).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str | None] = {}
            for cell in row.findall("m:c", ns):
                letters = re.match("[A-Z]+", cell.get("r", "")) or None
                place = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                value, kind = cell.find("m:v", ns), cell.get("t")
                text = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else None if value is None else value.text
                cells[place] = shared[int(text)] if kind == "s" and text is not None else text
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    width = max(map(len, rows), default=0)
    return [r + [None] * (width - len(r)) for r in rows]


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """A workbook's first sheet, with the columns of its first row, all texts; label tables are small, so the driver reads them, through Spark."""
    rows = sheet(bytes(spark.read.format("binaryFile").load(path).first().content))
    schema = ", ".join(f"`{c}` string" for c in rows[0])
    return spark.createDataFrame([tuple(r) for r in rows[1:]], schema)


def labels(spark: SparkSession, path: str, pid: str, order: str | None = None) -> DataFrame:
    """Labels of a CSV or XLSX file as text; of rows with one normalised id the first stays (by `order`, else by place in the file)."""
    if path.lower().endswith(".xlsx"):
        raw = workbook(spark, path)
        place = [F.col(order) if order else F.monotonically_increasing_id()]
    else:
        raw = spark.read.option("header", True).csv(path)
        place = [F.col(order)] if order else [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    numbered = raw.select("*", F.struct(*place).alias("_place")).withColumn(pid, normal_id(pid))
    first = Window.partitionBy(pid).orderBy("_place")
    return numbered.withColumn("_nth", F.row_number().over(first)).where(f"_nth = 1 and `{pid}` <> ''").drop("_nth", "_place")


def groups(cohort: DataFrame, labels: DataFrame | None, pid: str = "ID", attribute: str = "属性") -> DataFrame:
    """pid, grp of every participant: preterm by the attribute of the labels, by the id where there is no such label."""
    by_id = F.when(F.col("pid").startswith("d1"), "preterm").otherwise("other")
    if labels is None or attribute not in labels.columns:
        return cohort.select("pid", by_id.alias("grp"))
    told = labels.select(F.col(pid).alias("pid"), F.lit(True).alias("__told"), F.trim(F.col(f"`{attribute}`")).alias("__a"))
    return cohort.join(told, "pid", "left").select("pid", F.when(F.col("__told"), F.when(F.col("__a") == "d", "preterm").otherwise("other")).otherwise(by_id).alias("grp"))


def cohort(spark: SparkSession, path: str, key: str = "participant_ids") -> DataFrame:
    """pid of the `- "id"` items under a key of a YAML file, in the file's order."""
    lines = spark.read.text(path, wholetext=True).first()
    inside, ids = False, []
    for line in (lines.value if lines else "").splitlines():
        bare = line.split(" #")[0].strip()
        if bare and not bare.startswith(("-", "#")):
            inside = bare == f"{key}:"
        elif inside and bare.startswith("-"):
            ids.append((len(ids), bare[1:].strip().strip("\"'")))
    return spark.createDataFrame(ids, "place int, pid string")


def thresholds(spark: SparkSession, path: str) -> dict[str, float]:
    """Thresholds written by writers.thresholds: the barrier between null and observed statistics."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)
