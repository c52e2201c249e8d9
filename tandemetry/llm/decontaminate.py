"""Benchmark decontamination by a distributed positional inverted index, DataFrame functions only.

Terms are ASCII-lower-cased words.  A first pass counts every test term over all
documents.  Of each test window the RARE rarest terms are kept, with their offsets.
A second pass stores the postings (document, term, position) of these terms.
Grouped per document and term they are the lists of the index: the lists of a
window's rarest terms, each shifted by the term's offset, are intersected, which
leaves the words where the window can start.  The few that are left are compared
with the document's words: exact phrases.  `proximity` intersects the same lists
with a tolerance, for windows whose rare terms occur near each other in any order.

Both passes stream over the documents and emit counts and postings of test terms
alone; no text is shuffled but those that hold a candidate, once each, and these
only when they are too many to be broadcast.  Test tables are broadcast in chunks of
at most BROADCAST_ROWS rows, one scan a chunk, so no term is ever dealt to one task,
however frequent.

Defined results: null texts have no words; wordless items match nothing; an item
without id is ignored, documents without id are one document; repeated items count
once; rows that share a doc_id are one document: each has its own n_words, and all
have the hits of the one that is hit most.  Ids may be of any type that can be
grouped.  Empty tables give no hits or an empty result.  Extra columns are ignored;
a text may be as long as a row can be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemetry.llm.common import by_ids, drop_staged, staged

WINDOW = 10
#: Terms of a window whose lists are intersected.
RARE = 2
#: Rows of a test table that one broadcast may hold.
BROADCAST_ROWS = 500_000
# Fixed values of the contract: what separates words, and the letters that are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(term: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the same for ASCII, and faster."""
    return F.when(F.octet_length(term) == F.char_length(term), F.lower(term)).otherwise(F.translate(term, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """Words as they stand.  Letters separate nothing, but capitals are within the contract's separators only before lowering, so the class here leaves them out."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, start, terms of every window; an item of fewer words, but not none, is one window."""
    items = benchmark.select("item_id", F.transform(raw_words(F.col("text")), lowered).alias("w")).where("item_id is not null and size(w) > 0")
    at = items.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))))
    return at.select("item_id", "start", F.slice("w", F.col("start") + 1, F.lit(window)).alias("terms")).distinct()


def chunks(small: DataFrame) -> list[DataFrame]:
    """The rows of a table in parts of about BROADCAST_ROWS, each to be broadcast."""
    n = -(-small.count() // BROADCAST_ROWS)
    if n <= 1:
        return [F.broadcast(small)]
    part = F.pmod(F.xxhash64(*small.columns), F.lit(n))
    return [F.broadcast(small.where(part == k)) for k in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n, its occurrences over all documents: summed within each task before any shuffle."""
    each = docs.select(F.explode(raw_words(F.col("text"))).alias("word")).select(lowered(F.col("word")).alias("term"))
    return _union([each.join(part, "term").groupBy("term").agg(F.count("*").alias("n")) for part in chunks(terms)])


def anchored(windows: DataFrame, counts: DataFrame, rare: int = RARE) -> DataFrame:
    """Windows that can occur, with `by`: their rarest terms and offsets, rarest first."""
    each = windows.select("*", F.posexplode("terms").alias("offset", "term"))
    known = each.join(counts, "term", "left").groupBy("item_id", "start", "terms").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("by"))
    return known.where("by[0].n > 0").select("item_id", "start", "terms", F.slice("by", 1, rare).alias("by"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index, of the given terms: doc_id, term, pos.  Besides, one row of each document with a null term and its n_words."""
    words = raw_words(F.col("text"))
    at = docs.select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.posexplode_outer("w").alias("pos", "word")).withColumn("key", lowered(F.col("word")))
    parts = chunks(terms)
    last = F.coalesce(F.col("pos") == F.col("n") - 1, F.lit(True))
    # the first scan also gives lengths: of a document's last word there may be two rows
    first = at.join(parts[0], F.col("key") == F.col("term"), "left").where(F.col("term").isNotNull() | last)
    both = F.when(last & F.col("term").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(last))
    out = [first.select("doc_id", "term", "pos", "n", F.explode(both).alias("length")).select("doc_id", F.when(~F.col("length"), F.col("term")).alias("term"), F.when(~F.col("length"), F.col("pos")).alias("pos"), F.when(F.col("length"), F.col("n")).alias("n_words"))]
    for part in parts[1:]:
        out.append(at.join(part, F.col("key") == F.col("term")).select("doc_id", "term", "pos", F.lit(None).cast("long").alias("n_words")))
    return _union(out)


def lists(index: DataFrame) -> DataFrame:
    """doc_id, term and the positions of the term in the document."""
    return index.where("term is not null").groupBy("doc_id", "term").agg(F.collect_set("pos").alias("positions"))


def _rarest(windows: DataFrame) -> DataFrame:
    return windows.select("item_id", "terms", F.col("start").alias("item_start"), "by", F.col("by")[0]["term"].alias("term"))


def _shifted(positions: str, offset: Column) -> Column:
    return F.transform(positions, lambda p: p - offset)


def candidates(held: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, item_id, terms and start: words of documents where the offset-adjusted lists of a window's rarest terms meet."""
    met = _union([held.join(part, "term") for part in chunks(_rarest(windows))])
    met = met.select("doc_id", "item_id", "terms", "by", _shifted("positions", F.col("by")[0]["offset"]).alias("starts"))
    single = met.where("size(by) = 1").select("doc_id", "item_id", "terms", "starts")
    more = met.where("size(by) > 1")
    for k in range(1, RARE):
        other = held.select(F.col("doc_id").alias("other_doc"), F.col("term").alias("other_term"), F.col("positions").alias("other"))
        kth = F.get("by", F.lit(k))
        joined = more.join(other, F.col("doc_id").eqNullSafe(F.col("other_doc")) & (kth["term"] == F.col("other_term")))
        more = joined.select("doc_id", "item_id", "terms", "by", F.array_intersect("starts", _shifted("other", kth["offset"])).alias("starts")).where("size(starts) > 0")
    every = single.union(more.select("doc_id", "item_id", "terms", "starts"))
    return every.select("doc_id", "item_id", "terms", F.explode("starts").alias("start")).where("start >= 0")


def phrases(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word number in the document), length of every exact occurrence of a window."""
    found = staged(found, "candidates")
    asked = found.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "start", "terms")).alias("asked")).withColumnRenamed("doc_id", "asked_doc")
    ids = staged(found.select("doc_id").distinct(), "candidate-ids")
    some = by_ids(docs.select("doc_id", "text"), ids, "doc_id", "left_semi", null_safe=True)
    words = some.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_doc"))).select("doc_id", "asked", F.transform(raw_words(F.col("text")), lowered).alias("words"))
    exact = F.filter("asked", lambda a: F.slice("words", a["start"] + 1, F.size(a["terms"])) == a["terms"])
    hit = words.select("doc_id", F.explode(exact).alias("a"))
    return hit.select("doc_id", F.col("a")["item_id"].alias("item_id"), F.col("a")["start"].alias("start"), F.size(F.col("a")["terms"]).alias("length"))


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, within: int = WINDOW) -> DataFrame:
    """doc_id, item_id and pos: places of a window's rarest term with its other rare terms at most `within` words off, in any order."""
    raw = staged(test_windows(benchmark, window), "windows")
    windows = staged(anchored(raw, term_counts(docs, raw.select(F.explode("terms").alias("term")).distinct())), "anchored")
    held = staged(lists(postings(docs, windows.select(F.explode("by.term").alias("term")).distinct())), "lists")
    met = _union([held.join(part, "term") for part in chunks(_rarest(windows))]).select("doc_id", "item_id", "by", "positions")
    near = met.where("size(by) = 1").select("doc_id", "item_id", "positions")
    more = met.where("size(by) > 1")
    for k in range(1, RARE):
        other = held.select(F.col("doc_id").alias("other_doc"), F.col("term").alias("other_term"), F.col("positions").alias("other"))
        joined = more.join(other, F.col("doc_id").eqNullSafe(F.col("other_doc")) & (F.get("by", F.lit(k))["term"] == F.col("other_term")))
        # every place within reach of the other list
        reach = F.array_distinct(F.flatten(F.transform("other", lambda q: F.sequence(q - within, q + within))))
        more = joined.select("doc_id", "item_id", "by", F.array_intersect("positions", reach).alias("positions")).where("size(positions) > 0")
    return near.union(more.select("doc_id", "item_id", "positions")).select("doc_id", "item_id", F.explode("positions").alias("pos")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    docs = docs.select("doc_id", "text")
    raw = staged(test_windows(benchmark, window), "windows")
    counts = staged(term_counts(docs, raw.select(F.explode("terms").alias("term")).distinct()), "term-counts")
    windows = staged(anchored(raw, counts), "anchored")
    index = staged(postings(docs, windows.select(F.explode("by.term").alias("term")).distinct()), "postings")
    hits = phrases(docs, candidates(lists(index), windows))
    spans = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    joined = F.aggregate(
        "spans", zero, lambda acc, s: F.struct(F.greatest(acc["end"], s["start"] + s["length"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], acc["end"]))).alias("n"))
    )
    covered = staged(spans.select(F.col("doc_id").alias("hit_doc"), joined["n"].alias("n_hit"), "items"), "covered")
    lengths = index.where("term is null").select("doc_id", "n_words")
    n_covered = covered.count()
    out = lengths.join(F.broadcast(covered) if n_covered <= BROADCAST_ROWS else covered.hint("merge"), F.col("doc_id").eqNullSafe(F.col("hit_doc")), "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    drop_staged(raw, counts, windows)
    return out.select(
        "doc_id", F.greatest("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
