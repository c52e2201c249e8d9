"""A training corpus from documents: five stages, each on what the one before it kept.

Counted as part of the subpackage tandemetry.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemetry.llm import bagminhash, decontaminate, packing, quality_forest, recompression
from tandemetry.llm.common import by_ids, drop_staged, fresh_path, staged, table
from tandemetry.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the forest rejects go."""
    return quality_forest.keep(docs, quality_forest.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the smallest doc_id, of its least text key where different texts share the id.

    A row without a doc_id stays where its class has no row with one; of rows equal in doc_id and words one stays.
    """
    rows = bagminhash.labelled(docs)
    chosen = staged(rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")).alias("c")).select("class", "c.doc_id", "c.k1", "c.k2"), "chosen")
    n_rows, n_ids = rows.agg(F.count("*"), F.count("doc_id")).head()
    if n_rows == n_ids and not rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # a doc_id names a row: the others go by their ids
        others = staged(rows.join(chosen.select(F.col("doc_id")), "doc_id", "left_anti").select("doc_id"), "others")
        kept = by_ids(docs, others, "doc_id", "left_anti")
    else:
        keys = chosen.select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
        found = bagminhash.keyed(docs).join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")), "left_semi")
        kept = found.dropDuplicates(["k1", "k2"]).select(*docs.columns)
    return kept


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages are cut out of texts."""
    return recompression.removed_from(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; rows that share a doc_id, or have none, go together."""
    hit = staged(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct(), "contaminated")
    return by_ids(docs, hit, "doc_id", "left_anti", null_safe=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A forest and a tokenizer are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        docs._staged_path = path
        drop_staged(before)
    return docs
