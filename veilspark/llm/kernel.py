"""Vectorised text kernel shared by the free-style operators.

Works on the buffers of an Arrow string column, a bounded number of bytes at a
time, so memory does not grow with the batch.  A word is a maximal run of bytes
outside 0x20 and 0x09-0x0D; A-Z are lower-cased, nothing else changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte but letters parts words here; bytes of other characters belong to words.
NOT_LETTER = np.arange(256) < 128
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over uint64, returned as a new array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of some consecutive documents: document i owns words first[i]:first[i + 1]."""

    low: int  # index of the first document in the batch
    data: np.ndarray  # the documents' bytes, A-Z folded
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return self.head_hashes([0])[0]

    def head_hashes(self, lengths: list[int]) -> list[np.ndarray]:
        """For each length, hashes of the words' first bytes; 0 stands for the whole word, as does a short word's length."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "p", n), out=total[1:])
        low, back = total[self.start], _power(_INVERSE, "i", n + 1)[self.start]
        return [mix((total[np.minimum(self.end, self.start + k) if k else self.end] - low) * back) for k in lengths]

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :]
    return at.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column: pa.Array, parts: np.ndarray = SPACE, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a string column's documents; a null or empty text has none. parts: the bytes between words."""
    if not len(column):
        return
    at, data = _buffers(column)
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        own = at[low : high + 1] - at[low]
        part = _FOLD[data[at[low] : at[high]]]
        space = parts[part]
        edge = np.ones(len(part) + 1, bool)  # before each byte, and after the last: does no word go on here?
        edge[1:-1] = space[:-1]
        edge[own] = True
        start = np.flatnonzero(edge[:-1] & ~space)
        edge[:-1] |= space
        stop = np.flatnonzero(edge[1:] & ~space) + 1
        yield Words(low, part, start, stop, np.searchsorted(start, own))
        low = high


def grams(words: Words, hashes: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word windows, and where each document's begin.

    short: a document with 1 to n - 1 words gets its whole sequence as one.
    """
    counts = words.counts
    if n == 1:
        return hashes.copy(), words.first
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        factor = np.uint64(pow(0xD1342543DE82EF95, j + 1, 1 << 64))
        total += hashes[j : len(hashes) - n + 1 + j] * factor
    total = mix(total)
    many = np.maximum(counts - n + 1, 0)
    whole = short & (counts > 0) & (counts < n)
    per = np.where(whole, 1, many)
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(first[-1], np.uint64)
    keep = np.ones(len(total), bool)
    for j in range(1, n):  # windows that begin in the last n - 1 words of a document cross its end
        tail = words.first[1:] - j
        tail = tail[(tail >= words.first[:-1]) & (tail < len(total))]
        keep[tail] = False
    full = np.repeat(many > 0, per)
    out[full] = total[keep]
    for i in np.flatnonzero(whole):
        lone = hashes[words.first[i] : words.first[i + 1]]
        value = np.uint64(len(lone))
        for x in lone:
            value = mix(np.array([value ^ x], np.uint64))[0] + np.uint64(len(lone))
        out[first[i]] = value
    return out, first
