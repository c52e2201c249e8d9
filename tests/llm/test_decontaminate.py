"""The positional index against plain search, in one broadcast and in chunks."""

import random
import re

import pytest

from tandemetry.llm import common, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def made(seed=0):
    rng = random.Random(seed)
    say = lambda n, k=12: " ".join(rng.choice(["The", "of", "a"]) if rng.random() < 0.5 else f"w{rng.randrange(k)}" for _ in range(n))
    items = [(i, say(rng.randrange(1, 30), 60)) for i in range(14)] + [(20, None), (21, " . "), (22, "of"), (23, "The of"), (23, "The of"), (None, "a a"), (24, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12")]
    docs = []
    for i in range(60):
        text = say(rng.randrange(0, 80))
        if i % 3 == 0:
            text += " " + (rng.choice(items)[1] or "") + ", " + say(5)
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "THE of. The-of x1 x2 x3"), (102, "w1 x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11"), (None, "of of"), (103, "the the " * 2000 + "of x")]
    return docs, items


def restated(docs, items, window=10):
    windows = {(item, tuple(w[k : k + window])) for item, text in items if item is not None and (w := words(text)) for k in range(max(1, len(w) - window + 1))}
    out, hits = [], {}
    for doc, text in docs:
        w = words(text)
        spans = {(k, len(p), item) for item, p in windows for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p}
        hits.setdefault(doc, set()).update(spans)
        out.append((doc, len(w)))
    rows = []
    for doc, n in out:
        covered = {k + j for k, size, _ in hits[doc] for j in range(size)}
        rows.append((doc, n, len(covered), len({i for *_, i in hits[doc]})))
    return rows


@pytest.mark.parametrize("broadcast", [500_000, 7, 0])
def test_equals_plain_search(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", max(1, broadcast))
    monkeypatch.setattr(common, "BROADCAST_IDS", broadcast)
    docs, items = made()
    if broadcast < 5:
        docs, items = docs[::4], items[::4]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got), key=key) == sorted(restated(docs, items), key=key)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("d1", "x y z"), ("d2", "q")], "doc_id string, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([("i9", "Y z"), ("i10", "y")], "item_id string, text string")).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got) == [("d1", 2, 2), ("d2", 0, 0)]


def test_proximity_in_any_order(spark):
    items = [(1, "rare1 common rare2")]
    docs = [(1, "rare2 a b rare1"), (2, "rare1 " + "a " * 30 + "rare2"), (3, "common common"), (4, "rare1 common rare2 common common")]
    got = decontaminate.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), within=5).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (4, 1)]
