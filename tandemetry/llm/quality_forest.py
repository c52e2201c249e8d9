"""Quality rules: an isolation forest over rule statistics.

Rule statistics of every whole text are computed by one vectorised pass.  A
forest of random splits, fitted on the good rows of a bounded labelled sample,
turns them into an anomaly score from path lengths; the threshold is calibrated on
the same labelled rows so that at most MAX_GOOD_LOST of the good ones go.

Defined results: a null or wordless text has zero statistics and fails the base
rule (fewer than 50 words).  Repeated rows give repeated results.  Ties in
score are rejected only if the score is above the threshold.  Where no label of
both kinds exists, only the base rule decides.  An empty table gives an empty
result.  Extra columns are ignored by `rate` and kept by `keep`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemetry.llm.common import tidied
from pyspark.sql import types as T

from tandemetry.llm import kernels as K

#: Labelled rows that the forest and its threshold are fitted on at most, those of the smallest hash of doc_id.
MAX_FIT_ROWS = 20_000
TREES, SUBSAMPLE, SEED = 200, 256, 7
#: Quantile of the labelled rows, of either kind, at which a feature's range for splits ends.
BOX = 0.01
#: Share of good labelled rows that the threshold may reject.
MAX_GOOD_LOST = 0.002

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_short", "n_stops")


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each document."""
    with np.errstate(over="ignore"):
        key = K.mix(h + (doc.astype(np.uint64) + K.U64(1)) * K.U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(doc[order][new], minlength=n)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """COUNTS of each document, one row a document."""
    n = len(offs) - 1
    starts, ends, first = K.word_spans(data, offs)
    words = np.diff(first)
    doc = K.groups(first)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]

    out = np.zeros((n, len(COUNTS)), np.int64)
    out[:, 0] = words
    out[:, 1] = count(((data & 0xC0) != 0x80) & ~K.SPACE[data])
    out[:, 2] = count(SYMBOLS[data])
    out[:, 7] = count((data >= 48) & (data <= 57))
    breaks = np.flatnonzero(data == 10)
    ls, le = np.sort(np.concatenate([offs[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offs[1:]]))
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[full], le[full]
    line_doc = np.searchsorted(offs, ls, side="right") - 1
    out[:, 5] = np.bincount(line_doc, minlength=n)
    out[:, 3] = out[:, 5] - _distinct(line_doc, K.span_hashes(data, ls, le), n)
    h = K.span_hashes(data, starts, ends)
    out[:, 6] = _distinct(doc, h, n)
    out[:, 8] = np.bincount(doc[ends - starts <= 3], minlength=n)
    stop = np.isin(data[np.maximum(ends - 1, 0)], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    out[:, 9] = np.bincount(doc[stop], minlength=n)
    if len(h) >= 3:
        inside = doc[:-2] == doc[2:]
        with np.errstate(over="ignore"):
            key = K.mix((h[:-2] * K.U64(3) + h[1:-1]) * K.U64(5) + h[2:] + (doc[:-2].astype(np.uint64) + K.U64(1)) * K.U64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(inside)
        order = at[np.argsort(key[at])]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(h), bool)
        hit = order[twice]
        for k in range(3):
            covered[hit + k] = True
        out[:, 4] = np.bincount(doc[covered], minlength=n)
    return out


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def features(counts: np.ndarray) -> np.ndarray:
    """Rates that the forest splits on; zero words give zeros."""
    c = counts.astype(float)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    return np.column_stack([
        c[:, 1] / words,
        c[:, 2] / words,
        c[:, 3] / (lines + 8),
        c[:, 4] / words,
        np.log1p(c[:, 6]) / np.log1p(words),
        np.log1p(words / lines),
        c[:, 7] / chars,
        c[:, 8] / words,
        c[:, 9] / words,
    ])


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays [tree, node]; a leaf points at itself and holds its path length."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    size: int
    threshold: float = np.inf

    @classmethod
    def fit(cls, x: np.ndarray, box: tuple[np.ndarray, np.ndarray], trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
        """x: rows that are not anomalous.  box: the range of each feature over anomalous rows too, within which the random splits fall, so that space without ordinary rows is isolated by a few of them."""
        rng = np.random.default_rng(seed)
        size = min(subsample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))) + 2)
        made: list[list[tuple[int, float, int, float]]] = []
        for _ in range(trees):
            nodes: list[tuple[int, float, int, float] | None] = [None]
            todo = [(0, x[rng.choice(len(x), size, replace=False)], *box, 0)]
            while todo:
                node, rows, low, high, level = todo.pop()
                wide = np.flatnonzero(high > low)
                if level == depth or len(rows) <= 1 or not len(wide):
                    nodes[node] = (0, np.inf, node, level + float(_average_path(len(rows))))
                    continue
                k = rng.choice(wide)
                cut = rng.uniform(low[k], high[k])
                left = rows[:, k] <= cut
                nodes[node] = (int(k), cut, len(nodes), 0.0)
                below, above = high.copy(), low.copy()
                below[k] = above[k] = cut
                todo += [(len(nodes), rows[left], low, below, level + 1), (len(nodes) + 1, rows[~left], above, high, level + 1)]
                nodes += [None, None]
            made.append(nodes)
        width = max(map(len, made))
        tables = [np.array([nodes[i] if i < len(nodes) else (0, np.inf, i, 0.0) for i in range(width)]) for nodes in made]
        stack = np.stack(tables)
        return cls(stack[..., 0].astype(np.int32), stack[..., 1], stack[..., 2].astype(np.int32), stack[..., 3], depth, size)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1], larger for shorter paths."""
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))[:, None]
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            node = np.zeros((len(self.feature), len(rows)), np.int32)
            for _ in range(self.depth):
                right = rows[np.arange(len(rows)), self.feature[trees, node]] > self.cut[trees, node]
                node = self.child[trees, node] + right
            out[a : a + len(rows)] = 2.0 ** -(self.path[trees, node].mean(axis=0) / max(float(_average_path(self.size)), 1e-9))
        return out


def fit_labelled(counts: np.ndarray, bad: np.ndarray) -> Forest | None:
    """Forest and calibrated threshold from labelled statistics; None without rows of both kinds beyond the base rule."""
    open_ = ~base_failed(counts)
    x, bad = features(counts[open_]), bad[open_]
    if not bad.any() or bad.all():
        return None
    low, high = np.quantile(x, [BOX, 1 - BOX], axis=0)
    forest = Forest.fit(x[~bad], (np.minimum(low, np.quantile(x[bad], BOX, axis=0)), np.maximum(high, np.quantile(x[bad], 1 - BOX, axis=0))))
    s = forest.score(x)
    forest.threshold = _threshold(s, bad)
    return forest


def _threshold(s: np.ndarray, bad: np.ndarray) -> float:
    """Of the cuts that lose at most MAX_GOOD_LOST of the good rows, the middle of the widest gap below the first bad rows left: the lowest cut allowed."""
    good = np.sort(s[~bad])
    floor = good[min(len(good) - 1, int(np.ceil(len(good) * (1 - MAX_GOOD_LOST))))]
    above = s[bad & (s > floor)]
    return float((floor + above.min()) / 2) if len(above) else float(floor)


_STATS = ", ".join(f"{c} long" for c in COUNTS)


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels (quality 0) of at most max_rows labelled documents."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches):
        for batch in batches:
            for a, b, data, offs in K.text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *map(pa.array, statistics(data, offs).T)], ["doc_id", "quality", *COUNTS])

    got = some.mapInArrow(tidied(run), f"doc_id long, quality int, {_STATS}").groupBy("doc_id").agg(F.min(F.struct("quality", *COUNTS)).alias("x"))
    rows = np.array([tuple(r.x) for r in got.collect()], np.int64).reshape(-1, 1 + len(COUNTS))
    rows = rows[np.lexsort(rows.T)]
    return rows[:, 1:], rows[:, 0] == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Forest | None:
    """Fit on a bounded sample of labelled rows (documented parameter MAX_FIT_ROWS)."""
    return fit_labelled(*_sample(docs, labels, max_rows))


def _judge(batch: pa.RecordBatch, forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.concatenate([statistics(data, offs) for _, _, data, offs in K.text_slices(batch, "text")] or [np.zeros((0, len(COUNTS)), np.int64)])
    score = forest.score(features(counts)) if forest else np.zeros(len(counts))
    failed = base_failed(counts)
    return counts, score, ~failed & ~(score > (forest.threshold if forest else np.inf))


def rate(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept of every row."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                counts, score, kept = _judge(batch, forest)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts.T), pa.array(base_failed(counts)), pa.array(score), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(tidied(run), f"doc_id long, {_STATS}, base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of docs that the rules keep, all columns, without a shuffle."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_judge(batch, forest)[2]))

    return docs.mapInArrow(tidied(run), T.StructType.fromJson(json.loads(docs.schema.json())))
