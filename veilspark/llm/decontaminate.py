"""Benchmark decontamination by spaced-seed hashing.

A mask reads some of the words in a window and ignores the others, so a changed
word at an ignored place leaves the seed's hash as it is.  Seeds of benchmark
items and of documents are joined on mask and hash; each hit fixes an alignment
(document, item, offset), and an alignment is confirmed if, in some window of
WINDOW aligned words (the whole item if shorter), PERCENT of the words agree.
At a document's edge the window may reach beyond it; the words there count as
different.

A fixed-size bit map of the benchmark's seeds drops most document seeds before
the join; it only spares work, as the join is on the full hash.  An item with
fewer words than the longest mask spans is sought as a whole, with each of its words
ignored in turn where PERCENT allows a change.

A document's row carries its words to its alignments.  Seeds and items are broadcast
while there are few (BROADCAST_IDS seeds, ITEM_BYTES of text), so a phrase or an item
that very many documents share is no hot key; beyond that, joins shuffle the
alignments and Spark's skewed-join splitting deals hot ones.

Nulls and edge cases: items and documents without text match nothing; items of
fewer than min_words words are not sought (MIN_WORDS by default: shorter ones stand in clean documents); a null doc_id or item_id takes no
part; rows that share an id count as one, with the best overlap of any; repeated
hits count once; empty tables give an empty result; extra columns are ignored by
overlaps() and kept by clean().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import BROADCAST_IDS, stored, with_ids

#: 1: the word counts; 0: any word may stand there. In 10 to WINDOW words, however the changed ones that PERCENT allows
#: lie, some place of some mask has none of them.
MASKS = ("11111", "1101101", "11010011", "110010011", "1010011001")
WINDOW, PERCENT, MIN_WORDS = 20, 80, 5
MAP_BITS = 24
#: Items of at most so many bytes together are broadcast.
ITEM_BYTES = 1 << 24


def _mask_factors() -> list[list[tuple[int, np.uint64]]]:
    return [[(j, np.uint64(pow(0xDA942042E4DD58B5, 7 * m + j + 1, 1 << 64))) for j, c in enumerate(mask) if c == "1"] for m, mask in enumerate(MASKS)]


def _seeds(words: kernel.Words, hashes: np.ndarray):
    """(seed hashes, word positions) for each mask."""
    last = np.repeat(words.first[1:], words.counts)
    at = np.arange(len(hashes))
    for mask, factors in zip(MASKS, _mask_factors(), strict=True):
        pos = at[at + len(mask) <= last]
        total = np.zeros(len(pos), np.uint64)
        for j, factor in factors:
            total += hashes[pos + j] * factor
        yield kernel.mix(total), pos


def _short(hashes: np.ndarray, first: np.ndarray, n: int):
    """(hashes, word positions) of all n-word windows within documents, with one word ignored, each in turn, or none if all must agree."""
    last = np.repeat(first[1:], np.diff(first))
    pos = np.arange(len(hashes))
    pos = pos[pos + n <= last]
    for skipped in range(n) if -(-PERCENT * n // 100) < n else [n]:
        total = np.full(len(pos), n * 64 + skipped, np.uint64)
        for j in range(n):
            if j != skipped:
                total += hashes[pos + j] * np.uint64(pow(0x9FB21C651E98DF25, j + 1, 1 << 64))
        yield kernel.mix(total), pos


SPAN = max(map(len, MASKS))


def _bit(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _item_seeds(batches, min_words: int):
    for batch in batches:
        for words in kernel.chunks(batch.column("text")):
            h = words.hashes()
            ids = batch.column("item_id").slice(words.low, words.n_docs).to_numpy(zero_copy_only=False)
            counts, doc = words.counts, np.repeat(np.arange(words.n_docs), words.counts)
            found = [(s, p, np.zeros(len(p), np.int32)) for s, p in _seeds(words, h)]
            for n in range(min_words, SPAN):
                for s, p in _short(h, words.first, n):
                    whole = counts[doc[p]] == n
                    found.append((s[whole], p[whole], np.full(whole.sum(), n, np.int32)))
            seeds, pos, short = (np.concatenate(x) for x in zip(*found, strict=True))
            enough = counts[doc[pos]] >= min_words
            seeds, pos, short = seeds[enough], pos[enough], short[enough]
            at = (pos - words.first[doc[pos]]).astype(np.int32)
            columns = [seeds.view(np.int64), ids[doc[pos]].astype(np.int64), at, short]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["seed", "item_id", "at", "short"])


def _tokens(batches, key: str):
    for batch in batches:
        for words in kernel.chunks(batch.column("text")):
            lists = pa.ListArray.from_arrays(words.first.astype(np.int32), pa.array(words.hashes().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(key).slice(words.low, words.n_docs).cast(pa.int64()), lists], [key, "tokens"])


def best_overlap(item: np.ndarray, doc: np.ndarray, offset: int, min_words: int = MIN_WORDS) -> tuple[int, int, int]:
    """Agreeing words, window and document position of the best aligned window; item[i] stands at doc[offset + i].

    The window has WINDOW words, or as many as the item. Where the document begins or ends within it, the aligned words
    that are left, min_words at least, are held against the whole window.
    """
    low, high = max(0, -offset), min(len(item), len(doc) - offset)
    width = min(WINDOW, len(item))
    inside = min(width, high - low)
    if inside < min(min_words, width):
        return 0, width, 0
    same = np.concatenate([[0], np.cumsum(item[low:high] == doc[low + offset : high + offset])])
    total = same[inside:] - same[:-inside]
    best = int(total.argmax())
    return int(total[best]), width, low + offset + best


def overlaps(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, n_agree, n_window, word_at): each document with each benchmark item found in it."""
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    seeds = stored(items.mapInArrow(lambda b: _item_seeds(b, min_words), "seed long, item_id long, at int, short int").distinct())
    bits = spark.sparkContext.broadcast(_bit_map(seeds))
    short = [row[0] for row in seeds.select("short").where("short > 0").distinct().collect()]  # fewer than SPAN

    def hits(batches):
        present = bits.value
        for batch in batches:
            for words in kernel.chunks(batch.column("text")):
                h = words.hashes()
                found = [(s[k], p[k]) for s, p in _seeds(words, h) if (k := present[_bit(s)]).any()]
                for n in short:
                    found += [(s[k], p[k]) for s, p in _short(h, words.first, n) if (k := present[_bit(s)]).any()]
                if not found:
                    continue
                seed, pos = (np.concatenate(x) for x in zip(*found, strict=True))
                doc = np.searchsorted(words.first, pos, "right") - 1
                ids = batch.column("doc_id").slice(words.low, words.n_docs).to_numpy()
                columns = [pa.array(seed.view(np.int64)), pa.array(ids[doc]), pa.array(pos - words.first[doc])]
                yield pa.RecordBatch.from_arrays(columns, ["seed", "doc_id", "pos"])

    found = docs.mapInArrow(hits, "seed long, doc_id long, pos long")
    few = seeds.count() <= BROADCAST_IDS
    lines = found.join(F.broadcast(seeds) if few else seeds, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("offset"))
    lines = stored(lines.distinct())
    return _confirmed(docs, items, lines, min_words)


def _bit_map(seeds: DataFrame) -> np.ndarray:
    """Which slots hold a benchmark seed."""
    slot = F.shiftrightunsigned("seed", 64 - MAP_BITS).cast("int")
    rows = seeds.select(slot.alias("slot")).distinct().toArrow()  # at most 2 ** MAP_BITS slots
    out = np.zeros(1 << MAP_BITS, bool)
    out[rows.column("slot").to_numpy()] = True
    return out


def _confirmed(docs: DataFrame, items: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    wanted = lines.select("doc_id").distinct()
    texts = with_ids(docs, wanted, wanted.count(), "left_semi").mapInArrow(lambda b: _tokens(b, "doc_id"), "doc_id long, tokens array<long>")
    own = items.mapInArrow(lambda b: _tokens(b, "item_id"), "item_id long, tokens array<long>")
    if size[0] + 100 * size[1] <= ITEM_BYTES:
        own = F.broadcast(own)
    # an item's words go to the document's row, never the other way round
    rows = lines.join(texts, "doc_id").join(own.withColumnRenamed("tokens", "item"), "item_id").select("doc_id", "item_id", "offset", "item", _around("tokens").alias("part"), _low().alias("low"))

    def check(batches):
        for batch in batches:
            got = []
            for doc, item_id, offset, low, item, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "offset", "low")), batch.column("item"), batch.column("part"), strict=True):
                agree, width, at = best_overlap(item.values.to_numpy(), part.values.to_numpy(), offset - low, min_words)
                if 100 * agree >= PERCENT * width:
                    got.append((doc, item_id, agree, width, at + low))
            if got:
                columns = [pa.array(x, pa.int64()) for x in zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_agree", "n_window", "word_at"])

    schema = "doc_id long, item_id long, n_agree long, n_window long, word_at long"
    best = F.max(F.struct("n_agree", F.negative("word_at").alias("at"), "n_window")).alias("b")
    return (
        rows.mapInArrow(check, schema)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "b.n_agree", "b.n_window", F.negative("b.at").alias("word_at"))
    )


def _low():
    return F.greatest(F.col("offset"), F.lit(0))


def _around(tokens: str):
    """The document's words that an item at this offset can stand on."""
    length = F.least(F.size(tokens), F.col("offset") + F.size("item")) - _low()
    return F.slice(F.col(tokens), (_low() + 1).cast("int"), F.greatest(length, F.lit(0)).cast("int"))


def clean(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents in which no benchmark item was found; all columns stay. min_words as in overlaps(): 1 seeks items of any length."""
    found = stored(overlaps(docs, items, min_words).select("doc_id").distinct())
    return with_ids(docs, found, found.count(), "left_anti").select(*docs.columns)
