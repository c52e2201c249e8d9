"""Every stage of the pipeline against a plain version of it, on whole small tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tandemetry.llm import bagminhash, common, quality_forest
from tandemetry.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_near(rows):
    """Kept (doc_id, text) of rows with distinct ids, by all pairs."""
    bags = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := WORD.findall(t or "")) else Counter() for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            if bags[i] == bags[j] or shared and shared >= 0.8 * (bags[i].total() + bags[j].total() - shared) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        least[r] = min(doc, least.get(r, doc))
    return {doc for doc, _ in rows if doc in least.values()}


def plain_cut(rows):
    """Text of each document without repeated windows of 50 words; documents that nothing is left of are left out."""
    words = {doc: WORD.findall(t or "") for doc, t in rows}
    first = {}
    for doc in sorted(words):
        for k in range(len(words[doc]) - 49):
            first.setdefault(tuple(words[doc][k : k + 50]), doc)
    out = {}
    for doc, w in words.items():
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < doc for j in range(50)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        if kept or not w:
            out[doc] = kept
    return out


def plain_clean(rows, items):
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for t in items if (w := terms(t)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    return {doc for doc, t in rows if not any(tuple(w[k : k + n]) in windows for w in [terms(t)] for n in sizes for k in range(len(w) - n + 1))}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_stages_equal_plain_versions(spark, monkeypatch, few):
    monkeypatch.setattr(common, "BROADCAST_IDS", few)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        schema, columns = docs.schema, docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), schema)
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and docs.count() == len(got)
        if name == "quality_rules":
            forest = quality_forest.fit(spark.createDataFrame(rows, "doc_id long, text string"), table(spark, SF, "labels"))
            assert set(got) == {r.doc_id for r in quality_forest.rate(spark.createDataFrame(rows, "doc_id long, text string"), forest).where("kept").collect()}
        elif name == "near_dedup":
            assert set(got) == plain_near(rows)
        elif name == "substring_dedup":
            assert {k: WORD.findall(t or "") for k, t in got.items()} == plain_cut(rows)
        else:
            assert set(got) == plain_clean(rows, [r.text for r in table(spark, SF, "benchmark").collect()])
        assert got
    from tokenizers import Tokenizer

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    plain = Tokenizer.from_file(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    assert set(packed.doc_id) == set(got)
    for doc, mine in packed.groupby("doc_id"):
        ids = np.array([*plain.encode(got[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        mine = mine.sort_values("piece")
        assert mine.length.sum() == len(ids) and list(mine.ids_crc32) == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)]
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048


def test_rows_without_an_id_and_texts_that_share_one(spark):
    rows = [(None, "a text that nobody else has", "s"), (None, "twice  and nameless", "s"), (None, "twice and nameless", "s"), (None, "also named", "s"), (7, "also named", "s"), (9, "also  named", "s"), (8, "something else again", "s")]
    rows += [(2, "one text of the id two", "s"), (2, "quite another text under the same id", "s"), (2, "one text of the id two", "s"), (3, "quite another text under the same id", "s")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), None).collect()
    assert sorted((r.doc_id or 0, " ".join(r.text.split())) for r in got) == [(0, "a text that nobody else has"), (0, "twice and nameless"), (2, "one text of the id two"), (2, "quite another text under the same id"), (7, "also named"), (8, "something else again")]


def test_texts_that_share_an_id_are_compared_each(spark):
    base = [f"w{k}" for k in range(60)]
    near = [*base[:59], "x"]
    rows = [(5, " ".join(base)), (5, "nothing like it"), (6, " ".join(near)), (None, " ".join([*base[:58], "y"])), (None, "all alone")]
    got = bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got) == [(0, 0), (0, 5), (5, 5), (5, 5), (6, 5)]
