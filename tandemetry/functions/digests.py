"""MD5 of many short texts at once: a prefix and a number or name of each item, as the SQL statements of the catalog hash them.

Rounds run over arrays of 32-bit words, a part of the items at a time, so a digest costs about a tenth of a call of hashlib.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SHIFTS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]), 4, axis=0).reshape(4, 4, 4).reshape(-1)
_SINES = [int(abs(np.sin(k + 1)) * 2**32) & 0xFFFFFFFF for k in range(64)]
_PLACES = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else (7 * k) % 16 for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
PART = 1 << 16


class Names:
    """The items' texts, grouped by length once, so that each prefix only fills its own places."""

    def __init__(self, items: np.ndarray):
        items = np.asarray(items)
        text = items.astype("S") if items.dtype.kind in "iuS" else np.char.encode(items.astype(str), "utf-8")
        self.n, self.width = len(text), text.dtype.itemsize
        self.bytes = np.ascontiguousarray(text).view(np.uint8).reshape(self.n, self.width)
        size = np.char.str_len(text) if self.n else np.zeros(0, int)
        self.groups = [(int(k), np.flatnonzero(size == k)) for k in np.unique(size)]
        # a group that is a stretch is a slice: no gather
        self.groups = [(k, slice(int(at[0]), int(at[-1]) + 1) if at[-1] - at[0] + 1 == len(at) else at) for k, at in self.groups]

    def digests(self, prefix: str, words: int = 4) -> np.ndarray:
        """The first `words` 32-bit words of each digest, read from the left as in its hexadecimal form; shape (words, items)."""
        head = np.frombuffer(prefix.encode(), np.uint8)
        out = np.empty((words, self.n), np.uint32)
        for size, at in self.groups:
            rows = self.bytes[at][:, :size]
            if len(head) + size > 55:
                out[:, at] = _any_length(np.concatenate([np.repeat(head[None], len(rows), axis=0), rows], axis=1), words)
                continue
            got = np.empty((words, len(rows)), np.uint32)
            for a in range(0, len(rows), PART):
                got[:, a : a + PART] = _one_block(head, rows[a : a + PART], words)
            out[:, at] = got
        return out

    def each(self, prefixes: list[str], words: int = 4) -> Iterator[np.ndarray]:
        """digests of each prefix; those of few items are made of many prefixes at once."""
        if self.n * 4 > PART:
            yield from (self.digests(p, words) for p in prefixes)
            return
        step = max(1, PART // max(self.n, 1))
        for a in range(0, len(prefixes), step):
            some = [np.frombuffer(p.encode(), np.uint8) for p in prefixes[a : a + step]]
            out = np.empty((len(some), words, self.n), np.uint32)
            for length in {len(p) for p in some}:
                own = [k for k, p in enumerate(some) if len(p) == length]
                heads = np.stack([some[k] for k in own]) if length else np.zeros((len(own), 0), np.uint8)
                for size, at in self.groups:
                    rows = self.bytes[at][:, :size]
                    whole = np.concatenate([np.repeat(heads, len(rows), axis=0), np.tile(rows, (len(own), 1))], axis=1)
                    got = _any_length(whole, words).reshape(words, len(own), len(rows))
                    for j, k in enumerate(own):
                        out[k][:, at] = got[:, j]
            yield from out

    def orders(self, prefixes: list[str], items: np.ndarray) -> Iterator[np.ndarray]:
        """For each prefix the items in the order of their digests, of equal ones by item."""
        bits = np.uint64(max(1, int(max(self.n, 1) - 1).bit_length()))
        places, mask = np.arange(self.n, dtype=np.uint64), (np.uint64(1) << bits) - np.uint64(1)
        for d in self.each(prefixes):
            high = (d[0].astype(np.uint64) << np.uint64(32)) | d[1]
            # a place in the low bits makes the sort carry it along; where the other bits leave a tie, all of the digest decides
            packed = np.sort(((high >> bits) << bits) | places)
            if self.n > 1 and (np.diff(packed >> bits) == 0).any():
                yield np.lexsort((items, (d[2].astype(np.uint64) << np.uint64(32)) | d[3], high))
            else:
                yield (packed & mask).astype(np.int64)

    def draws(self, prefixes: list[str]) -> Iterator[np.ndarray]:
        """For each prefix the numbers that the first eight hexadecimal digits make."""
        yield from (d[0].astype(np.int64) for d in self.each(prefixes, 1))


def _any_length(rows: np.ndarray, words: int) -> np.ndarray:
    if rows.shape[1] > 55:
        return np.array([np.frombuffer(hashlib.md5(r.tobytes()).digest(), ">u4")[:words] for r in rows]).T  # noqa: S324
    return _one_block(np.zeros(0, np.uint8), rows, words)


def _one_block(head: np.ndarray, rows: np.ndarray, words: int) -> np.ndarray:
    """Digests of head + row, whose lengths are all alike and fit one block."""
    n, size = rows.shape
    total = len(head) + size
    fixed = np.zeros(64, np.uint8)
    fixed[: len(head)], fixed[total] = head, 0x80
    fixed[56:64] = np.frombuffer(np.uint64(8 * total).tobytes(), np.uint8)
    message: list = [int(v) for v in fixed.view("<u4")]
    first, last = len(head) // 4, (total - 1) // 4
    own = np.repeat(fixed[None, 4 * first : 4 * last + 4], n, axis=0)
    own[:, len(head) - 4 * first : len(head) - 4 * first + size] = rows
    for k, column in enumerate(own.view("<u4").T):
        message[first + k] = np.ascontiguousarray(column)
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = message[_PLACES[k]]
        if isinstance(word, int):
            np.add(f, np.uint32((word + _SINES[k]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, np.uint32(_SINES[k]), out=f)
        shift = int(_SHIFTS[k])
        np.left_shift(f, np.uint32(shift), out=g)
        np.right_shift(f, np.uint32(32 - shift), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    parts = (a, b, c, d)[:words]
    return np.stack([(p + np.uint32(s)).byteswap() for p, s in zip(parts, _START, strict=False)])
