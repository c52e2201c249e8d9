"""Removal of repeated passages by recompression.

Documents are sequences of word symbols.  A round names runs of one symbol, then
pairs: a hash bit deals the symbols into a left and a right half, and a left
symbol followed by a right one is replaced by the pair's name.  Names are
functions of what they stand for, so equal substrings get the same symbols
everywhere, but for the few symbols at their ends whose partner may lie outside.
The names are 64-bit hashes: all executors agree on them without a round trip of
all pairs, which would shuffle the corpus once a round.

For each window the symbols that follow from the window's words alone are known
exactly, level by level: at either end a symbol is dropped if it could join one
outside.  Equal windows thus have equal interior symbols.  A window is anchored at
the least stretch of STRETCH neighbouring interior symbols of its highest level that
has so many (of any, where no level has), a function of its words, and keyed by the
names of these symbols.  Keys are what Spark shuffles: one that also occurs in a
document of a smaller doc_id reveals a candidate.  Only windows on such anchors are hashed by
their 50 words (128 bits) and shuffled to verify the repeat and to find the
smallest document that holds it.

Texts with equal word sequences are grouped first; all but the smallest document
of a group lose every window.

Defined results: null texts have no words; documents below the window lose
nothing; a passage repeated within one document alone stays; rows that share a
doc_id are one document, so nothing is removed because of a row of the same
doc_id; a null doc_id is larger than any other.  Repeated rows give repeated
results, an empty table an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemetry.llm import kernels as K
from tandemetry.llm.common import by_ids, drop_staged, staged, tidied

WINDOW = 50
#: Rounds of naming: symbols then stand for (4/3)**ROUNDS words on average.
ROUNDS = 4
#: Neighbouring symbols that make a key.
STRETCH = 4
#: What stands for a null doc_id in comparisons.
LAST = (1 << 63) - 1


def _names(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(K.mix(a + K.U64(salt)) * K.U64(3) + b)


def anchors(h: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Start and anchor key of every window of each document's words h."""
    n_words = np.diff(first)
    starts = np.flatnonzero(np.arange(len(h)) + window <= np.repeat(first[1:], n_words))
    if not len(starts):
        return starts, np.zeros(0, K.U64)
    symbols = h
    doc = K.groups(first)
    low, high = starts.copy(), starts + window  # symbols [low, high) follow from the window alone
    keys = _least(symbols, low, high, np.zeros(len(starts), K.U64), 0)
    for level in range(1, rounds + 1):
        # runs: equal neighbours become one symbol; a run at either end of a window may go on outside
        n = len(symbols)
        head = np.ones(n, bool)
        head[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(head)
        length = np.diff(np.append(begin, n))
        run = np.cumsum(head) - 1
        named = symbols[begin]
        long = length > 1
        named[long] = _names(named[long], length[long].astype(np.uint64), 2 * level)
        doc = doc[begin]
        last = np.minimum(high, n) - 1
        some = high > low
        # a run that the window may cut is unknown, be it cut or not: at its ends nobody can tell
        low = np.where(some, run[np.minimum(low, n - 1)] + 1, 0)
        high = np.where(some, run[last], 0)
        symbols, n = named, len(named)
        # pairs
        right = (K.mix(symbols + K.U64(level * 0x5851F42D4C957F2D % 2**64)) >> K.U64(63)).astype(bool)
        joins = np.zeros(n, bool)
        joins[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        second = np.zeros(n, bool)
        second[1:] = joins[:-1]
        begin = np.flatnonzero(~second)
        index = np.cumsum(~second) - 1
        named = symbols[begin]
        pair = joins[begin]
        named[pair] = _names(symbols[begin[pair]], symbols[begin[pair] + 1], 2 * level + 1)
        doc = doc[begin]
        some = high > low
        at = np.minimum(low, n - 1)
        low = np.where(some, low + right[at], 0)  # a right symbol at the low end may belong to a pair outside
        end = np.maximum(high - 1, 0)
        high = np.where(some, high - ~right[end], 0)  # so may a left one at the high end
        some = high > low
        bounds = np.append(index, len(named))
        low, high = np.where(some, bounds[low], 0), np.where(some, bounds[np.maximum(high - 1, 0)] + 1, 0)
        symbols = named
        keys = _least(symbols, low, high, keys, level)
    return starts, keys


def _least(symbols: np.ndarray, low: np.ndarray, high: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
    """The least name of STRETCH neighbouring symbols in symbols[low:high] of each window that has as many, else its key so far."""
    some = high - low >= STRETCH
    if not some.any():
        return keys
    a, width = low[some], (high - low)[some] - STRETCH + 1
    with np.errstate(over="ignore"):
        names = np.full(len(symbols) - STRETCH + 1, K.U64(0x1234567 + level))
        for k in range(STRETCH):
            names = K.mix(names * K.U64(3) + symbols[k : len(symbols) - STRETCH + 1 + k])
    table, step = names, 1
    got = np.empty(len(a), K.U64)
    top = int(np.floor(np.log2(width.max())))
    for k in range(top + 1):
        mine = (width >= step) & (width < 2 * step)
        if mine.any():
            x = a[mine]
            got[mine] = np.minimum(table[x], table[x + width[mine] - step])
        if k < top and len(table) > step:
            table = np.minimum(table[:-step], table[step:])
        step *= 2
    keys = keys.copy()
    keys[some] = got
    return keys


def windows(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every window of one document's words."""
    return K.rolling(h, window, K.P1), K.rolling(h, window, K.P2)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _slices(batch):
    for a, b, data, offs in K.text_slices(batch, "text"):
        starts, ends, first = K.word_spans(data, offs)
        yield a, b - a, (data, offs), starts, ends, first, K.span_hashes(data, starts, ends)


def _first_pass(window, rounds):
    def run(batches):
        for batch in batches:
            for a, n, (data, offs), _, _, first, h in _slices(batch):
                k1, k2 = K.sequence_key(h, first)
                starts, names = anchors(h, first, window, rounds)
                cut = np.searchsorted(starts, first)
                raw = data.tobytes()
                lists, ends, digests = [], [0], []
                for i in range(n):
                    mine = np.unique(names[cut[i] : cut[i + 1]])
                    lists.append(mine)
                    ends.append(ends[-1] + len(mine))
                    digests.append(_digest(raw[offs[i] : offs[i + 1]].split()))  # bytes split at the same characters
                flat = pa.array(np.concatenate(lists).view(np.int64) if lists else [], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(first)), pa.array(digests), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    ["doc_id", "k1", "k2", "n_words", "sha", "anchors"],
                )

    return run


def _second_pass(window, rounds):
    """Windows on shared anchors of candidate documents: a row each window of a document, with its first start and, where it is repeated, the others."""

    def run(batches):
        for batch in batches:
            for a, n, _, _, _, first, h in _slices(batch):
                starts, names = anchors(h, first, window, rounds)
                cut = np.searchsorted(starts, first)
                shared = batch.column("shared").slice(a, n)
                ids = batch.column("ord").slice(a, n).to_numpy()
                for i in range(n):
                    own = slice(cut[i], cut[i + 1])
                    want = np.asarray(shared[i].values.to_numpy(), np.int64).view(np.uint64)
                    at = (starts[own] - first[i])[np.isin(names[own], want)]
                    w1, w2 = (w[at] for w in windows(h[first[i] : first[i + 1]], window))
                    order = np.lexsort((at, w2, w1))
                    at, w1, w2 = at[order].astype(np.int32), w1[order], w2[order]
                    head = np.ones(len(at), bool)
                    head[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
                    begin = np.flatnonzero(head)
                    again = np.diff(np.append(begin, len(at))) - 1
                    more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(again)).astype(np.int32)), pa.array(at[~head]), mask=pa.array(again == 0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), ids[i])), pa.array(at[begin]), more, pa.array(w1[begin].view(np.int64)), pa.array(w2[begin].view(np.int64))], ["ord", "at", "more", "w1", "w2"])

    return run


def covered(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Words inside windows that start at the given words."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _cut_rows(window, with_text):
    """n_removed, the digest of the kept words, and the text without the removed ones."""

    def run(batches):
        for batch in batches:
            for a, n, (data, _), s, e, first, _ in _slices(batch):
                starts = batch.column("starts").slice(a, n)
                raw = data.tobytes()
                removed, digests, texts = [], [], []
                for i in range(n):
                    own = slice(first[i], first[i + 1])
                    gone = covered(np.asarray(starts[i].values.to_numpy(), np.int64), first[i + 1] - first[i], window)
                    ws, we = s[own][~gone], e[own][~gone]
                    removed.append(int(gone.sum()))
                    digests.append(_digest([raw[x:y] for x, y in zip(ws, we, strict=True)]))
                    if with_text:
                        # stretches of kept words as they stand, joined by one space
                        heads = np.flatnonzero(~gone & np.append(True, gone[:-1]))
                        tails = np.flatnonzero(~gone & np.append(gone[1:], True))
                        texts.append(" ".join(raw[s[own][x] : e[own][y]].decode() for x, y in zip(heads, tails, strict=True)))
                columns, names = [batch.column("ord").slice(a, n), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["ord", "n_removed", "sha_kept"]
                if with_text:
                    columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def find(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(a row a document: doc_id, ord, k1, k2, n_words, sha, least), (ord, starts of removed windows of representatives)."""
    rows = _keyed(docs)
    passed = staged(
        rows.select("ord", "text").withColumnRenamed("ord", "doc_id").mapInArrow(tidied(_first_pass(window, rounds)), "doc_id long, k1 long, k2 long, n_words long, sha string, anchors array<long>").withColumnRenamed("doc_id", "ord"), "passed"
    )
    groups = staged(passed.groupBy("k1", "k2").agg(F.min("ord").alias("least")), "groups")
    # anchors of representatives; equal texts have equal anchors
    reps = passed.select("ord", "k1", "k2", "anchors").join(groups, ["k1", "k2"]).where("ord = least").select("ord", F.explode("anchors").alias("anchor"))
    reps = staged(reps, "anchors")
    # anti joins on a key and a document: a key that many documents share is spread over all tasks
    single = reps.groupBy("anchor").agg(F.min("ord").alias("ord"), F.max("ord").alias("hi")).where("ord = hi").select("anchor", "ord")
    candidates = reps.join(single.hint("merge"), ["anchor", "ord"], "left_anti").groupBy("ord").agg(F.collect_set("anchor").alias("shared"))
    candidates = staged(candidates, "candidates")
    texts = rows.select("ord", "text").join(candidates.hint("merge"), "ord")
    found = staged(texts.mapInArrow(tidied(_second_pass(window, rounds)), "ord long, at int, more array<int>, w1 long, w2 long"), "windows")
    least = found.groupBy("w1", "w2").agg(F.min("ord").alias("ord"))
    repeats = found.join(least.hint("merge"), ["w1", "w2", "ord"], "left_anti")
    gone = staged(repeats.groupBy("ord").agg(F.concat(F.collect_list("at"), F.flatten(F.collect_list("more"))).alias("starts")), "gone")
    drop_staged(reps, candidates, found)
    return passed.drop("anchors").join(groups, ["k1", "k2"]), gone


def deduplicate(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows, gone = find(docs, window, rounds)
    texts = by_ids(_keyed(docs).select("ord", "text"), gone.select("ord"), "ord", "left_semi").join(gone, "ord")
    cut = staged(texts.mapInArrow(tidied(_cut_rows(window, False)), "ord long, n_removed long, sha_kept string").dropDuplicates(["ord"]), "cut")
    copy = (F.col("ord") > F.col("least")) & (F.col("n_words") >= window)
    return rows.join(cut, "ord", "left").select(
        F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha_kept", "sha")).alias("kept_sha256"),
    )


def removed_from(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """docs with removed words cut out of the text and n_chars, where it is a column, counted anew; documents that nothing is left of go."""
    rows, gone = find(docs, window, rounds)
    copies = rows.where((F.col("ord") > F.col("least")) & (F.col("n_words") >= window)).select(F.col("ord").alias("__ord")).distinct()
    keyed = docs.withColumn("__ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    keyed = by_ids(keyed, staged(copies, "copies"), "__ord", "left_anti")
    touched = gone.select("ord")
    texts = by_ids(_keyed(docs).select("ord", "text"), touched, "ord", "left_semi").join(gone, "ord")
    cut = staged(texts.mapInArrow(tidied(_cut_rows(window, True)), "ord long, n_removed long, sha_kept string, kept_text string").dropDuplicates(["ord"]), "cut").select(F.col("ord").alias("__cut"), F.col("kept_text").alias("__kept"))
    plain = by_ids(keyed, cut.select(F.col("__cut").alias("__ord")), "__ord", "left_anti")
    mended = by_ids(keyed, cut.select(F.col("__cut").alias("__ord")), "__ord", "left_semi").join(cut, F.col("__ord") == F.col("__cut")).where(F.col("__kept") != "").withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        mended = mended.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return plain.select(docs.columns).union(mended.select(docs.columns))
