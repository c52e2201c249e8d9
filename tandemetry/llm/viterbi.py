"""Token counts of a unigram vocabulary by a count-only Viterbi.

The vocabulary is pieces with scores, as a SentencePiece model file lists them;
the file's scores are whole numbers, so sums are exact.  An Aho-Corasick
automaton enumerates the pieces that end at each position, longest first; the
dynamic programme keeps the best score and its piece count alone, without paths.
A later candidate replaces an earlier one only if its score is larger, so among
equal scores the piece that starts first wins, as in the tokenizer.  A character
that is no piece costs the lowest score less 10 and counts one piece per UTF-8
byte (byte fallback).

A text is prefixed with the space mark, and spaces become marks.  No piece has
the mark after another character, so segmentation falls apart before each mark
that follows another character, and the parts are counted once per worker.

Defined results: a null or empty text has no pieces; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemetry.llm.common import tidied

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts that a worker remembers; then it forgets all and begins anew.
MEMO = 300_000


class Counter:
    """Piece counts under a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for piece, score in pieces:
            if piece and piece not in best:
                best[piece] = score
        for piece, score in best.items():
            self.automaton.add_word(piece, (len(piece), score))
        if best:
            self.automaton.make_automaton()
        self.best = best
        self.unknown = min(best.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.splits = all(MARK not in p.lstrip(MARK) for p in best)
        self.memo: dict[str, tuple[float, int, int]] = {}

    def solve(self, text: str) -> tuple[float, int, int]:
        """(best score, pieces, of them for unknown characters) of a marked text."""
        n = len(text)
        score, count, odd = [0.0] + [None] * n, [0] * (n + 1), [0] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if self.best:
            for end, match in self.automaton.iter(text):
                matches[end].append(match)
        for end in range(n):
            top, pieces, strange, single = None, 0, 0, False
            for length, s in sorted(matches[end], reverse=True):
                begin = end + 1 - length
                single = single or length == 1
                candidate = score[begin] + s
                if top is None or candidate > top:
                    top, pieces, strange = candidate, count[begin] + 1, odd[begin]
            if not single:
                candidate = score[end] + self.unknown
                if top is None or candidate > top:
                    size = len(text[end].encode("utf-8", "surrogatepass")) if self.byte_fallback else 1
                    top, pieces, strange = candidate, count[end] + size, odd[end] + size
            score[end + 1], count[end + 1], odd[end + 1] = top, pieces, strange
        return score[n], count[n], odd[n]

    def part(self, text: str) -> tuple[float, int, int]:
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[text] = self.solve(text)
        return got

    def count(self, text: str | None) -> tuple[float, int, int]:
        """(score, pieces, unknown pieces) of a raw text."""
        if not text:
            return 0.0, 0, 0
        if not self.splits or MARK in text:
            return self.solve((MARK + text).replace(" ", MARK))
        memo, part = self.memo, self.part
        score, pieces, odd, marks = 0.0, 0, 0, 1
        words = text.split(" ")
        last = len(words) - 1
        for k, word in enumerate(words):
            if not word and k < last:
                marks += 1
                continue
            key = MARK * marks + word
            s, c, o = memo.get(key) or part(key)
            score, pieces, odd, marks = score + s, pieces + c, odd + o, 1
        return score, pieces, odd


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a SentencePiece model file; control, unknown and byte pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_unknown and score of every row.  path: of the model file on every executor."""

    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or Counter(vocabulary(path))
            got = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c for _, c, _ in got], pa.int64()), pa.array([o for *_, o in got], pa.int64()), pa.array([s for s, _, _ in got], pa.float64())], ["doc_id", "n_tokens", "n_unknown", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, n_tokens long, n_unknown long, score double")
