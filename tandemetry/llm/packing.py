"""Best-fit packing by bin completion.

Documents become token sequences, longer ones are cut into full pieces, and all
pieces are packed into as few sequences as possible.  Only lengths matter for
packing, and there are at most `capacity` of them: the driver gets the histogram
of lengths, which does not grow with the corpus, and plans patterns (fillings of
one sequence) with the number of times each is used.  Pieces are then dealt to
the plan by their rank among pieces of their length; ranks are counted per
(length, salt), so a hot length is spread over all tasks.

The plan is a branch-and-bound over fillings around the largest piece left:
all undominated fillings are enumerated lazily in order of waste, each with every
number of times it can be used, best-fit decreasing over the histogram is the
first incumbent, and a branch is cut when its waste already costs as many
sequences as the incumbent; an incumbent at the lower bound is optimal, and so is
one that outlasts the search.  A search of likely fillings
comes first, for a good incumbent.
NODES bounds both; the incumbent stands if it ends the second, and the gap to the
lower bound is logged.

Defined results: a null text is empty; every document ends with token 0, so an
empty one is one piece of length 1; repeated rows are packed each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemetry.llm.common import drop_staged, shards, staged, tidied

CAPACITY = 2048
#: Fillings that each search may try in all, and likely ones kept at each step.
NODES, WIDTH = 6000, 3
#: Words that the tokenizer's memo holds when it begins anew, and characters of the texts that it takes at once.
MEMO, SLICE = 300_000, 1 << 20


class WordBPE:
    """Ids of a word-level BPE file, packed as little-endian unsigned 32-bit numbers.

    Words never merge, so ids are found once for each distinct word of a slice of
    texts and dealt to its places by arrays; they are remembered between slices.
    Texts with characters for which the normaliser could differ from str.lower
    (beyond Latin and common punctuation) or with special tokens go through the
    tokenizer as a whole.
    """

    ODD = r"[^\x{0}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}]|[\x{1C}-\x{1F}\x{130}]|<\|"
    GAP = re.compile(r"\s")
    SPACE, LETTER, NUMBER, OTHER = range(4)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = (b for b in range(256) if b not in plain)
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(shifted)}
        self.words: dict[str, bytes] = {}
        # of every character that a text which is not odd has in lower case
        self.kinds = np.array([self.SPACE if c.isspace() else {"L": self.LETTER, "N": self.NUMBER}.get(unicodedata.category(c)[0], self.OTHER) for c in map(chr, range(0x3000))], np.uint8)

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            spelled = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
            got = self.words[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])
        return got

    def _starts(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of lower-case text that ends in white space: whether a word starts there, and whether it is part of one.

        A word is 's, 't, 're, 've, 'm, 'll or 'd, or a run of letters, or one number, or a run of others; what comes first is taken.
        """
        kind = self.kinds[text]
        lead = np.flatnonzero(text >= 0xC0)
        if len(lead):
            first, second, third = (text[lead + k].astype(np.int32) for k in range(3))
            long = first >= 0xE0
            of = self.kinds[np.where(long, (first & 15) << 12 | (second & 63) << 6 | third & 63, (first & 31) << 6 | second & 63)]
            kind[lead] = kind[lead + 1] = of
            kind[lead[long] + 2] = of[long]
        starts = kind == self.NUMBER
        starts &= text & 0xC0 != 0x80
        starts[0] = True
        starts[1:] |= kind[1:] != kind[:-1]
        inside = kind != self.SPACE
        starts &= inside
        quote = np.flatnonzero(text[:-2] == ord("'"))
        quote = quote[starts[quote] & starts[quote + 1] & (kind[quote + 1] == self.LETTER)]
        one, two = text[quote + 1], text[quote + 2]
        short = np.isin(one, list(b"stmd"))
        cut = short | np.isin(one.astype(np.int32) << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])
        quote, end = quote[cut], (quote + np.where(short, 2, 3))[cut]
        starts[quote + 1] = False
        starts[end[kind[end] == self.LETTER]] = True
        return starts, inside

    def _slice(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are not odd."""
        if not texts:
            return []
        rows = [text.lower().encode() + b"\n" for text in texts]
        text = np.frombuffer(b"".join(rows), np.uint8)
        starts, inside = self._starts(text)
        places = np.flatnonzero(starts)
        edges = np.searchsorted(places, np.cumsum([0, *map(len, rows)]))
        ends = np.append(np.flatnonzero(starts[inside]), np.count_nonzero(inside)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(text[inside])).dictionary_encode()
        if len(self.words) >= MEMO:
            self.words.clear()
        known = [*map(self._word, found.dictionary.to_numpy(zero_copy_only=False).tolist())]
        ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.array([*map(len, known)], np.int64) // 4
        word = found.indices.to_numpy()
        many = sizes[word]
        before = np.append(0, np.cumsum(many))
        at = np.repeat((np.cumsum(sizes) - sizes)[word] - before[:-1], many)
        at += np.arange(len(at))
        ids, cuts = ids[at], before[edges].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _long(self, text: str) -> bytes:
        """Ids of one text that is not odd, cut at white space."""
        done, a = [], 0
        while a < len(text):
            space = self.GAP.search(text, a + SLICE)
            b = space.start() if space else len(text)
            done += self._slice([text[a:b]])
            a = b
        return b"".join(done)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, in order; a null text is empty."""

        def flush() -> list[bytes]:
            got = self._slice(waiting)
            for k, ids in whole.items():
                got[k] = ids
            return got

        waiting, whole, size = [], {}, 0  # texts of the slice, and ids by place of those that do not go through it
        for text, odd in zip(texts, pc.match_substring_regex(texts, self.ODD), strict=True):
            text = text.as_py() or ""
            size += len(text)
            if size > SLICE and waiting:
                yield from flush()
                waiting, whole, size = [], {}, len(text)
            if odd.as_py():
                whole[len(waiting)] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            elif len(text) > SLICE:
                whole[len(waiting)] = self._long(text)
            waiting.append("" if len(waiting) in whole else text)
        yield from flush()


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row: doc_id, piece, start, length, ids_crc32.  path: of the tokenizer file on every executor."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or WordBPE(path)
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode(batch.column("text")), strict=True):
                ids += bytes(4)
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences by size alone, and by pieces over half a sequence with what cannot join them."""
    lengths = np.arange(len(counts))
    best = -(-int((counts * lengths).sum()) // capacity)
    for small in {0, *np.flatnonzero(counts[: capacity // 2 + 1]).tolist()}:
        large = counts[capacity - small + 1 :].sum()
        middle = int(counts[capacity // 2 + 1 : capacity - small + 1].sum())
        room = middle * capacity - int((counts * lengths)[capacity // 2 + 1 : capacity - small + 1].sum())
        rest = int((counts * lengths)[small : capacity // 2 + 1].sum())
        best = max(best, int(large) + middle + max(0, -(-(rest - room) // capacity)))
    return best


def fillings(counts: np.ndarray, room: int, most: int, budget: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Waste and further pieces of every undominated filling of `room` that wastes at most `most`, least waste first, then largest first piece.

    A filling is dominated when a piece left over could stand in for one or two of its own.  Lazy: sums that the
    pieces from each length down can reach lead the search, and each filling looked at takes one from `budget`.
    """
    if room <= 0 or counts[room]:
        yield 0, (room,) if room > 0 else ()  # a perfect fit by one piece dominates all others
        return
    have = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1] if x]
    n = {x: int(counts[x]) for x in have}
    every = (1 << (room + 1)) - 1
    reach = [1]  # reach[i], once turned: sums of pieces of have[i:], as bits
    for x in reversed(have):
        sums, left, step = reach[-1], min(n[x], room // x), 1
        while left:
            step = min(step, left)
            sums |= (sums << (step * x)) & every
            left -= step
            step *= 2
        reach.append(sums)
    reach.reverse()

    def exact(i: int, target: int) -> Iterator[list[tuple[int, int]]]:
        """(length, times) of the sets of have[i:] with this sum, largest pieces first."""
        if not target:
            yield []
            return
        for k in range(i, len(have)):
            if not reach[k] >> target & 1:
                return
            x = have[k]
            for times in range(min(n[x], target // x), 0, -1):
                if reach[k + 1] >> (target - times * x) & 1:
                    for rest in exact(k + 1, target - times * x):
                        yield [(x, times), *rest]

    def dominated(used: list[tuple[int, int]], waste: int) -> bool:
        spare = dict(n)
        for x, times in used:
            spare[x] -= times
        free = 0
        for x in have:
            if spare[x]:
                free |= 1 << x
        if free & ((2 << waste) - 1):
            return True  # a piece left over fits beside them
        for k, (x, times) in enumerate(used):
            if free >> (x + 1) & ((1 << waste) - 1):
                return True  # a larger piece in the place of x
            for y, more in used[k:]:
                if (y != x or more > 1) and free >> (x + y) & ((2 << waste) - 1):
                    return True  # one piece in the place of x and y
        return False

    small = 0  # pieces of at most the waste must all be used: one left over would fit
    for waste in range(min(most, room) + 1):
        small += waste * n.get(waste, 0)
        if small > room - waste:
            return
        if reach[0] >> (room - waste) & 1:
            for used in exact(0, room - waste):
                if budget[0] <= 0:
                    return
                budget[0] -= 1
                if not dominated(used, waste):
                    yield waste, tuple(x for x, times in used for _ in range(times))


def likely(counts: np.ndarray, room: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Some good sets of further pieces for `room`, least waste first, then largest first piece: for a first incumbent alone."""
    if room <= 0:
        return [()]
    if counts[room]:
        return [(room,)]  # a perfect fit by one piece dominates all others
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return [()]
    fit = np.zeros(room + 1, np.int64)
    fit[have] = have
    np.maximum.accumulate(fit, out=fit)  # the largest piece of at most each size

    def second(a: int, left: int) -> int:
        b = int(fit[left])
        if b == a and counts[a] < 2:
            b = int(fit[a - 1])
        return b

    first = have[::-1]
    waste = room - first - fit[room - first]
    found: list[tuple[int, tuple[int, ...]]] = []
    for k in np.argsort(waste, kind="stable")[: 4 * width]:
        a = int(first[k])
        b = second(a, room - a)
        found.append((room - a - b, (a, b) if b else (a,)))
    if min(w for w, _ in found) > 0:
        for a in map(int, first[: 4 * width]):
            counts[a] -= 1
            below = have[(have <= min(room - a, a)) & (counts[have] > 0)]
            if len(below):
                rest = room - a - below
                third = fit[rest]
                k = int(np.argmin(rest - third))
                b, c = int(below[k]), int(third[k])
                if c and counts[c] - (c == b) > 0:
                    left, more = room - a - b - c, [a, b, c]
                    while left > 0 and (d := int(fit[left])) and counts[d] - more.count(d) + (d == a) > 0:
                        more.append(d)
                        left -= d
                    found.append((left, tuple(sorted(more, reverse=True))))
            counts[a] += 1
    found = sorted({(w, tuple(sorted(f, reverse=True))) for w, f in found}, key=lambda x: (x[0], [-v for v in x[1]]))
    kept: list[tuple[int, ...]] = []
    for _, f in found:
        if not any(len(f) <= len(g) and all(x <= y for x, y in zip(f, g, strict=False)) for g in kept):
            kept.append(f)
    return kept[:width]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the histogram: equal pieces go to equally filled sequences at once."""
    rooms: dict[int, list[list]] = {}
    open_ = np.zeros(capacity + 1, bool)

    def add(room: int, pattern: tuple[int, ...], times: int) -> None:
        rooms.setdefault(room, []).append([pattern, times])
        open_[room] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = length + int(np.argmax(open_[length:]))
            if not open_[room]:
                each = capacity // length
                if left >= each:
                    add(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    add(capacity - left % each * length, (length,) * (left % each), 1)
                break
            group = rooms[room][-1]
            n = min(left, group[1])
            group[1] -= n
            if not group[1]:
                rooms[room].pop()
                open_[room] = bool(rooms[room])
            add(room - length, (*group[0], length), n)
            left -= n
    return [(pattern, times) for groups in rooms.values() for pattern, times in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with the times that each is used, by bin completion."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_bins = sum(times for _, times in best)
    if best_bins <= bound:
        return best
    ended = False
    for whole in (False, True):
        budget = [nodes]
        found = _search(counts.copy(), capacity, bound, best_bins, whole, budget)
        if found:
            best, best_bins = found, sum(times for _, times in found)
        ended = best_bins > bound and budget[0] <= 0
        if best_bins <= bound:
            break
    if ended:
        logging.getLogger(__name__).warning("the search for a packing ended at %d fillings: %d sequences, lower bound %d", nodes, best_bins, bound)
    return best


def _search(counts: np.ndarray, capacity: int, bound: int, best_bins: int, whole: bool, budget: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """The best plan of fewer than best_bins sequences, if any: over all fillings and numbers of times, or over likely ones used as often as can be."""
    best: list[tuple[tuple[int, ...], int]] = []
    # a step: what is left of its fillings, the one taken and its number, the largest piece, and the filling that others must follow
    steps: list[list] = []
    used, total = 0, int((counts * np.arange(capacity + 1)).sum())

    def put(pattern: tuple[int, ...], times: int) -> None:
        for x in pattern:
            counts[x] -= times

    while True:
        left = np.flatnonzero(counts)
        spare = (best_bins - 1 - used) * capacity - total  # what a plan that beats the incumbent may yet waste
        if not len(left) and used < best_bins:
            best, best_bins = [(step[1], step[2]) for step in steps], used
            if best_bins <= bound:
                return best
        elif len(left) and spare >= 0 and budget[0] > 0:
            largest = int(left[-1])
            counts[largest] -= 1
            if whole:
                options = fillings(counts.copy(), capacity - largest, spare, budget)
            else:
                budget[0] -= 1
                options = iter([(capacity - largest - sum(f), f) for f in likely(counts, capacity - largest)])
            counts[largest] += 1
            # sequences around equal pieces are taken in the order of the fillings
            floor = (capacity - sum(steps[-1][1]), [-x for x in steps[-1][1]]) if whole and steps and steps[-1][3] == largest else None
            steps.append([options, (), 0, largest, floor])
        # the next choice of the last step: the same filling once less often, or the next filling
        while steps:
            options, pattern, times, largest, floor = steps[-1]
            if times:
                put(pattern, -times)
                used, total = used - times, total + times * sum(pattern)
                times = times - 1 if whole and budget[0] > 0 else 0
                budget[0] -= times > 0
            spare = (best_bins - 1 - used) * capacity - total
            while not times and (found := next(options, None)):
                waste, rest = found
                pattern = (largest, *rest)
                if whole and waste > spare:
                    break
                if floor is None or (waste, [-x for x in pattern]) > floor:
                    times = min(int(counts[x]) // pattern.count(x) for x in set(pattern))
                    if whole and waste:
                        times = min(times, spare // waste)
            if times:
                put(pattern, times)
                used, total = used + times, total - times * sum(pattern)
                steps[-1][1:3] = [pattern, times]
                break
            steps.pop()
        if not steps:
            return best


def _dealt(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the sequence less the rank, and the offset."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            r = rank.get(length, 0)
            rows.append(((length << 44) + r, base - r, offset))
            rank[length] = r + times
            offset += length
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 3)
    return columns[:, 0], columns[:, 1], columns[:, 2]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row."""
    spark = docs.sparkSession
    made = staged(pieces(docs, path, capacity), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(32, shards(spark)))).alias("salt")
    counted = staged(made.groupBy("length", salt).agg(F.count("*").alias("n")), "length-counts")
    histogram = {int(r.length): int(r.n) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    keys, sequence, offset = _dealt(plan(histogram, capacity, nodes))
    ahead = counted.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = made.select("*", salt).withColumn("rn", F.row_number().over(own)).join(ahead, ["length", "salt"])

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[at] + rank), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("rn") - 1).cast("long").alias("rank"))
    out = staged(out.mapInArrow(tidied(run), f"{PIECES}, sequence_id long, offset long"), "packed")
    drop_staged(made, counted)
    return out
