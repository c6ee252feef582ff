"""Alignment of two tokenizers over the same bytes, by a static interval index.

Both tokenizers cut the same bytes.  B's tokens are a static index of intervals, sorted
by place; for each A token two bisections stab it and give the first and the last B token
that overlap it.  A gap between two A tokens that no overlap spans becomes the boundary
of a group: there, and only there, tokens of both end.  Every A token of a group is
linked with every B token of it.

A pair of ids counts once a document.  Counts, and the highest count of every A id, cover
all documents.  Their table grows with the corpus, so it isn't broadcast whole: pairs are
dealt by their counts, the most frequent ones (at most HEAD of them) meet the documents
by broadcast, all others by a shuffle in which no pair is hot: more than HEAD pairs have at
least half the count of any of them.

Nulls and edge cases: a text that is null or empty, or whose joined A or B bytes differ
from a space and the text (as with U+2581 in it), has no tokens: zeros and ''.  Repeated
rows are documents of their own and count each.  Rows keep a null doc_id.  An empty table gives an empty result.  Other
columns are ignored.  Texts are taken whole; a long one is handled alone, and a group with
very many links is counted by distinct ids of both sides, not link by link.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import head_of_counts, stored

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that are broadcast at most, at 16 bytes each.
HEAD = 1 << 18
#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20
#: Links of a group that are written out one by one; beyond it, distinct ids with their numbers.
PLAIN_LINKS = 1 << 12
#: An A id and a B id in one integer: B's vocabulary has fewer ids than this.
SHIFT = 15

TOKENS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, doc_key long, pairs array<int>, times array<int>"


def path_of(name: str) -> str:
    """A tokenizer's file: a path, or the name of one of the public files."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Side:
    """One tokenizer: texts to lists of ids, and the bytes of every id."""

    encode: object
    pieces: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if printable, else from 256 on in turn."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(2)
def byte_side(name: str = A_FILE) -> Side:
    """A byte-level BPE file.  Its merges make ids in rank order, so the faster library gives the same ids from them."""
    import public_tokenizers
    import tiktoken

    with open(path_of(name), encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(merges)):
        raise ValueError(f"the ids of {name} are not in the order of its merges")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * len(ranks)
    for piece, i in ranks.items():
        pieces[i] = piece
    return Side(lambda texts: [own.encode_ordinary(" " + t) for t in texts], pieces)


@lru_cache(2)
def piece_side(name: str = B_FILE) -> Side:
    """A sentencepiece model, which adds the space itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path_of(name))
    n = own.get_piece_size()
    text = lambda i: bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
    return Side(lambda texts: own.encode(texts, num_threads=1), [text(i) for i in range(n)])


@dataclass
class Aligned:
    """Tokens of some texts one after another, cut into groups; text i owns groups first[i]:first[i + 1]."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray  # tokens of A, and of B, up to the end of each group
    b_end: np.ndarray
    first: np.ndarray


def groups_of(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, text_end: np.ndarray) -> Aligned:
    """Cut two tokenizations of the same bytes; text_end: the byte at which each text ends, and no token crosses it."""
    a_stop, b_stop = np.cumsum(a_size), np.cumsum(b_size)
    # stab the index with each A token: the last B token that begins before the A token ends
    last = np.searchsorted(b_stop - b_size, a_stop, "left") - 1
    # the gap behind an A token is spanned if that B token goes on beyond it
    a_end = np.flatnonzero(b_stop[last] <= a_stop) + 1 if len(a) else np.zeros(0, np.int64)
    b_end = last[a_end - 1] + 1
    return Aligned(a, b, a_end, b_end, np.concatenate([[0], np.searchsorted(a_stop[a_end - 1], text_end, "right")]))


def links_of(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of the linked pairs, each once a text; pair is a << SHIFT | b."""
    na, nb = np.diff(found.a_end, prepend=0), np.diff(found.b_end, prepend=0)
    text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    plain = na * nb <= PLAIN_LINKS
    keys, times = [], []
    # each A token of a group meets each B token of it
    group = np.repeat(np.arange(len(na)), na)
    keep = plain[group]
    group, a = group[keep], found.a[keep]
    width = nb[group]
    at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    b = found.b[np.repeat((found.b_end - nb)[group], width) + at]
    keys.append(np.repeat(text[group] << 32 | a.astype(np.int64) << SHIFT, width) | b)
    times.append(np.ones(len(keys[0]), np.int64))
    for g in np.flatnonzero(~plain):
        (x, nx), (y, ny) = (np.unique(s[e - n : e], return_counts=True) for s, e, n in ((found.a, found.a_end[g], na[g]), (found.b, found.b_end[g], nb[g])))
        keys.append((text[g] << 32 | (x.astype(np.int64)[:, None] << SHIFT | y[None])).ravel())
        times.append((nx[:, None] * ny[None]).ravel())
    if len(keys) == 1:
        key = np.sort(keys[0])
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[new], np.diff(np.append(new, len(key)))
    else:
        key, n = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[new], np.add.reduceat(n, new) if len(new) else n
    return key >> 32, key & 0xFFFFFFFF, n


_DIGITS = 5


def _decimals(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """ASCII of ids, each followed by a separator, as rows that are padded with zeros in front."""
    out = np.empty((len(ids), _DIGITS + 1), np.uint8)
    rest = ids.astype(np.int64)
    for k in range(_DIGITS - 1, -1, -1):
        out[:, k] = np.where((rest > 0) | (k == _DIGITS - 1), 48 + rest % 10, 0)
        rest //= 10
    out[:, _DIGITS] = ends
    return out


def written(found: Aligned) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of every text: ids of both sides, group after group."""
    na, nb = np.diff(found.a_end, prepend=0), np.diff(found.b_end, prepend=0)
    ends = np.full(len(found.a) + len(found.b), 44, np.uint8)
    ids = np.empty(len(ends), np.int64)
    ids[np.arange(len(found.a)) + np.repeat(found.b_end - nb, na)] = found.a
    ids[np.arange(len(found.b)) + np.repeat(found.a_end, nb)] = found.b
    ends[found.a_end + found.b_end - nb - 1] = 124
    stop = found.a_end + found.b_end
    ends[stop - 1] = 59
    rows = _decimals(ids, ends)
    filled = rows.ravel()
    own = filled != 0
    size = np.concatenate([[0], np.cumsum(own.reshape(rows.shape).sum(axis=1))])
    data = filled[own].tobytes()
    at = size[np.concatenate([[0], stop])[found.first]]
    return [data[low : max(low, high - 1)] for low, high in zip(at[:-1], at[1:])]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for k, t in enumerate(texts):
        if k > low and size + len(t or "") > CHUNK_BYTES:
            yield low, k
            low, size = k, 0
        size += len(t or "")
    if low < len(texts):
        yield low, len(texts)


def align(texts: list[str], a_side: Side, b_side: Side) -> Aligned:
    """Both tokenizations of every text and their groups; a text without tokens has none."""
    both = [side.encode(texts) for side in (a_side, b_side)]
    for k, text in enumerate(texts):
        want = b" " + text.encode() if text else b""
        if not text or any(b"".join(map(side.pieces.__getitem__, ids[k])) != want for side, ids in zip((a_side, b_side), both)):
            both[0][k] = both[1][k] = []
    a, b = (np.fromiter((i for ids in side for i in ids), np.int64) for side in both)
    a_size, b_size = a_side.sizes[a], b_side.sizes[b]
    count = np.cumsum([len(ids) for ids in both[0]])
    return groups_of(a, a_size, b, b_size, np.concatenate([[0], np.cumsum(a_size)])[count])


def tokens(docs: DataFrame, a_name: str = A_FILE, b_name: str = B_FILE) -> DataFrame:
    """A row a document: its figures, the sum of its groups, and its linked pairs with their numbers."""

    def run(batches):
        a_side, b_side = byte_side(a_name), piece_side(b_name)
        for batch in batches:
            text = batch.column("text").to_pylist()
            for low, high in _parts(text):
                found = align([t or "" for t in text[low:high]], a_side, b_side)
                n, first = high - low, found.first
                upto = lambda ends: np.diff(np.concatenate([[0], ends])[first])  # noqa: B023, E731
                na, nb = np.diff(found.a_end, prepend=0), np.diff(found.b_end, prepend=0)
                sums = [hashlib.sha256(w).hexdigest() if w else "" for w in written(found)]
                owner, pair, times = links_of(found)
                at = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                longs = lambda x: pa.array(np.asarray(x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, n).cast(pa.int64()),
                        longs(upto(found.a_end)),
                        longs(upto(found.b_end)),
                        longs(np.diff(first)),
                        longs(np.diff(np.concatenate([[0], np.cumsum(na * nb)])[first])),
                        pa.array(sums),
                        batch.column("doc_key").slice(low, n),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(pair.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "doc_key", "pairs", "times"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("doc_key"))
    return rows.mapInArrow(run, TOKENS)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (is n the highest of its A id?), from a stored tokens()."""
    counts = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a_id = F.shiftright("pair", SHIFT)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))  # a row an A id: the vocabulary bounds it
    best = F.col("n") == F.col("most")
    return stored(counts.withColumn("a_id", a_id).join(F.broadcast(most), "a_id").select("pair", "n", best.alias("best")))


def aligned(docs: DataFrame, a_name: str = A_FILE, b_name: str = B_FILE, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    found = stored(tokens(docs, a_name, b_name), "zstd")
    counts = pair_counts(found)
    least = head_of_counts(counts, "n", head)
    top = F.broadcast(counts.where(F.col("n") >= least))
    links = found.select("doc_key", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("doc_key", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0).cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    parts, rest = summed(links.join(top, "pair")), counts.where(F.col("n") < least)
    if not rest.isEmpty():
        parts = parts.unionByName(summed(links.join(top, "pair", "left_anti").join(rest, "pair")))
        parts = parts.groupBy("doc_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "doc_key")
    return rows.join(parts, "doc_key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
