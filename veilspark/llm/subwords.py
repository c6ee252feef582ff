"""Subword ids of words, by a fixed public byte-level vocabulary, with a bounded memory of words seen."""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np

from . import kernel

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Words, and pieces of words, that an encoder remembers; beyond it, it starts anew.
REMEMBERED, REMEMBERED_PIECES = 1 << 19, 1 << 23
_TABLE_BITS = 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: A worker's vocabulary and encoder.
_OWN: list = []


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoder(mergeable: dict[bytes, int]) -> Encoder:
    """The encoder of this worker process: it goes on from task to task with the words that it remembers."""
    if not _OWN or _OWN[0] is not mergeable:
        _OWN[:] = mergeable, Encoder(mergeable)
    return _OWN[1]


class Encoder:
    """Words to ids; " " before a word marks its beginning, so ids give the words back."""

    def __init__(self, mergeable: dict[bytes, int]):
        import tiktoken

        self.size = max(mergeable.values()) + 1
        # every word is one string without inner spaces: the pattern only has to match all of it
        self.own = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=mergeable, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        # an open hash table from word hashes to slots; 0 stands for an empty place
        self.keys, self.at = np.zeros(1 << _TABLE_BITS, np.uint64), np.zeros(1 << _TABLE_BITS, np.int32)
        self.hashes = np.zeros(0, np.uint64)
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the words, -1 for those not remembered."""
        place = (hashes * _SPREAD >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        while len(left):
            here = self.keys[place]
            hit = here == hashes[left]
            out[left[hit]] = self.at[place[hit]]
            more = ~hit & (here != 0)
            left, place = left[more], (place[more] + 1) & ((1 << _TABLE_BITS) - 1)
        return out

    def _insert(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        """Distinct hashes that aren't in the table. Of those that want one place one gets it, and the others go on."""
        place = (hashes * _SPREAD >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        while len(hashes):
            free = self.keys[place] == 0
            self.keys[place[free]] = hashes[free]
            won = self.keys[place] == hashes
            self.at[place[won]] = slots[won]
            hashes, slots, place = hashes[~won], slots[~won], (place[~won] + 1) & ((1 << _TABLE_BITS) - 1)

    def encode(self, word: bytes) -> list[int]:
        """A word is encoded as a whole, however long; the library's time grows as its length does."""
        return self.own._core_bpe.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def _encoded(self, words: kernel.Words, some: np.ndarray) -> list[list[int]]:
        """encode() of some of the words. They are cut from one string of bytes, and each is a whole already, which the pattern needn't find."""
        data, encode = words.data.tobytes(), self.own._core_bpe.encode_single_piece
        return [encode(b" " + data[a:b]) for a, b in zip(words.start[some].tolist(), words.end[some].tolist(), strict=True)]

    @property
    def full(self) -> bool:
        return len(self.hashes) > REMEMBERED or len(self.ids) > REMEMBERED_PIECES

    def slots(self, words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word its slot (pieces ids[first[slot]:first[slot + 1]]), and the words' hashes."""
        if self.full:
            self._forget()
        hashes = np.maximum(words.hashes(), np.uint64(1))
        slot = self._find(hashes)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            lists = self._encoded(words, missing[where])
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            self._insert(new, (len(self.hashes) + np.arange(len(new))).astype(np.int32))
            self.hashes = np.concatenate([self.hashes, new])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32, size.sum())])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
            slot[missing] = self._find(hashes[missing])
        return slot, hashes

    def pieces(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the words in turn, and where each word's begin."""
        size = self.first[slots + 1] - self.first[slots]
        first = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(first[-1]) + np.repeat(self.first[slots] - first[:-1], size)], first
