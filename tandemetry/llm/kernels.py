"""Vectorised text kernels on Arrow string buffers.

Every function works on one slice of rows, whose text is at most SLICE bytes or
one single document, so temporaries stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call takes; a longer document comes alone.
SLICE = 1 << 20
#: Bytes whose powers are tabled at once; hashing runs segment by segment.
SEGMENT = 1 << 18

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE2 = U64(0xC2B2AE3D27D4EB4F | 1)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 12)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    x = np.full(size, b, U64)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))


P1, P2 = Powers(_BASE), Powers(_BASE2)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive slices; null texts are empty."""
    arr = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + SLICE, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-space bytes inside each document, and each document's first word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first], end[last] = word[first], word[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes.  Spans are sorted and do not overlap."""
    out = np.empty(len(starts), U64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            base = int(starts[a])
            b = max(int(np.searchsorted(ends, base + SEGMENT, side="right")), a + 1)
            s, e = starts[a:b] - base, ends[a:b] - base
            size = int(e[-1])
            P1.to(size + 1)
            total = np.zeros(size + 1, U64)
            np.cumsum(_BYTE[data[base : base + size]] * P1.up[:size], out=total[1:])
            out[a:b] = mix((total[e] - total[s]) * P1.down[s] + (e - s).astype(U64))
            a = b
    return out


def rolling(h: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hash of every window of `width` consecutive entries; entry i covers i..i+width-1."""
    n = len(h)
    if n < width:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        powers.to(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(mix(h ^ powers.base) * powers.up[:n], out=total[1:])
        return mix((total[width:] - total[:-width]) * powers.down[: n - width + 1])


def groups(first: np.ndarray) -> np.ndarray:
    """Document number of each word, from the documents' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word shingle; a document of fewer words than the width, but not none, is one shingle."""
    doc = groups(first)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        short = np.flatnonzero((n > 0) & (n < width))
        if len(h) >= width:
            inside = doc[: len(h) - width + 1] == doc[width - 1 :]
            x = np.zeros(len(h) - width + 1, U64)
            for k in range(width):
                x = x * U64(0xD6E8FEB86659FD93) + h[k : len(h) - width + 1 + k]
            d, s = doc[: len(x)][inside], mix(x[inside])
        else:
            d, s = np.zeros(0, np.int64), np.zeros(0, U64)
        if len(short):
            hs = []
            for i in short:
                x = U64(n[i])
                for k in h[first[i] : first[i + 1]]:
                    x = x * U64(0xD6E8FEB86659FD93) + k
                hs.append(x)
            d, s = np.concatenate([d, short]), np.concatenate([s, mix(np.array(hs, U64))])
            order = np.argsort(d, kind="stable")
            d, s = d[order], s[order]
    return d, s


def sequence_key(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each document's whole word sequence."""
    out = []
    with np.errstate(over="ignore"):
        n = np.diff(first)
        for p in (P1, P2):
            p.to(int(n.max(initial=0)) + 1)
            pos = np.arange(len(h)) - np.repeat(first[:-1], n)
            total = np.zeros(len(h) + 1, U64)
            np.cumsum(mix(h ^ p.base) * p.up[pos], out=total[1:])
            out.append(mix((total[first[1:]] - total[first[:-1]]) ^ n.astype(U64)))
    return out[0], out[1]


def per_batch(function, *columns):
    """A mapInArrow function: function(batch) -> RecordBatch, dropping empty batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return run
