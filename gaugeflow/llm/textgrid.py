"""Words and word shingles of whole batches of texts as arrays of 64-bit hashes.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased. A batch of texts is
hashed at once with numpy: polynomial sums over the bytes, in blocks, so that memory stays within a
few times the batch whatever the length of a text.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""

    def run(base: int) -> np.ndarray:
        out = np.full(BLOCK + 1, base & _MASK, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, n_bytes: int = 4 << 20):
    """(first row, part) of a string column, parts of about ``n_bytes`` or one row."""
    lengths = np.diff(utf8(column)[1])
    start = 0
    while start < len(column):
        total = np.cumsum(lengths[start:])
        n = max(1, int(np.searchsorted(total, n_bytes, side="right")))
        yield start, column.slice(start, n)
        start += n


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans follow each other in order. ``lower`` reads A-Z as a-z."""
    power, inverse = _powers()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + BLOCK, side="right"))
        if j <= i:  # a span longer than a block
            word = data[base : ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word.translate(_LOWER) if lower else word, digest_size=8).digest(), "little")
            i += 1
            continue
        part = data[base : ends[j - 1]]
        if lower:
            part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


class Words:
    """Words of a string column: hashes, byte spans, and the range of words of each row (``first[i]:first[i + 1]``)."""

    def __init__(self, column: pa.Array, separators: np.ndarray | None = None):
        """``separators``: which of the 256 bytes part words, if others than white space."""
        data, self.offsets = utf8(column)
        self.data = data
        space = (data == 0x20) | ((data >= 9) & (data <= 13)) if separators is None else separators[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = False
        edge[self.offsets] = True
        before = np.concatenate([[True], space[:-1]]) if len(data) else space
        after = np.concatenate([space[1:], [True]]) if len(data) else space
        self.starts = np.flatnonzero(~space & (before | edge[:-1]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, lower=True)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every run of ``n`` words within a row, in order."""
        h, count = self.hashes, len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(count, np.uint64)
        for k in range(n):
            total += h[k : k + count] * np.uint64(pow(_BASE, 2 * k + 3, 1 << 64))
        within = self.row[:count] == self.row[n - 1 :]
        return mix(total)[within], self.row[:count][within]

    def shingle_sets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of every row, one row after the other, and where each row's begin.

        A row with fewer than ``n`` words has its whole sequence as one shingle.
        """
        hashes, row = self.shingles(n)
        rows = len(self.offsets) - 1
        counts = np.bincount(row, minlength=rows)
        short = (counts == 0) & (np.diff(self.first) > 0)
        shift = np.cumsum(short) - short
        values = np.empty(len(hashes) + int(short.sum()), np.uint64)
        values[np.arange(len(hashes)) + shift[row]] = hashes
        first = np.concatenate([[0], np.cumsum(counts + short)])
        for i in np.flatnonzero(short):
            whole = self.hashes[self.first[i] : self.first[i + 1]].tobytes()
            values[first[i]] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little")
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            values[a:b].sort()
        fresh = np.ones(len(values), bool)
        fresh[1:] = values[1:] != values[:-1]
        fresh[first[:-1][first[:-1] < len(values)]] = True
        return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[first]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
