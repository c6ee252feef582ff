"""Packing of documents into sequences of a fixed length, by hierarchical best fit.

A document's tokens, with an end token behind them, are one piece; only a longer document
is cut, into full pieces that are sequences of their own, and a rest.  Rests are dealt to
nodes of about ITEMS pieces by a hash.  Each node packs best fit, longest first: a piece
goes where it leaves the least room.  Bins that are full but for NEAR tokens are done; the
others go, each as one item, to the node above, where FAN nodes meet, and best fit starts
again, up to the root.  A node sends its emptiest bins, ITEMS // FAN at most, so no node
gets more than ITEMS items at any size; what else is left there is done as it is.

Only keys and lengths are shuffled.  The places of a level are small tables that are joined
from the root down, and meet the pieces once.

Nulls and edge cases: a null text is empty, and an empty one has its end token only.
Rows with the same or a null doc_id are documents of their own.  An empty table gives an
empty result; other columns are ignored.  Texts are taken whole.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import byte_letters
from .common import stored

FILE, END, LENGTH = "word_bpe_49k.json", 1, 4096
ITEMS, FAN, NEAR = 1 << 13, 8, 32
#: Words that a worker remembers with their ids; beyond it, it starts anew. Longer words are not remembered.
REMEMBERED, REMEMBERED_BYTES = 1 << 19, 64
#: Rows of pieces in one Arrow batch.
ROWS = 1 << 12

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_key long, own_sequence long"
PLACES = "node long, item long, bin long, offset long, fill long, up boolean"


#: Words of these characters, which have no other composed or lower-case forms, are cut by _PARTS; others are left to the tokenizer's library.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Stands for a word's end, as no plain word has it.
_END_OF_WORD = "\0"


class WordIds:
    """Ids of a text whose tokenizer drops white space and never lets a token cross it: word by word, from memory.

    A plain word that isn't remembered is merged by a faster library from the same file's vocabulary: its pieces in
    the order of their merges, behind the letters that end a word, which come first.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        self.own = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        letters = byte_letters()
        with open(path, encoding="utf-8") as lines:
            vocabulary = json.load(lines)["model"]["vocab"]
        raw = {b"\0": vocabulary["Ā"]}
        for piece, i in vocabulary.items():
            stem, end = (piece[:-4], b"\0") if piece.endswith("</w>") else (piece, b"")
            data = bytes(letters.get(c, 0) for c in stem)
            if 0 not in data:
                raw[data + end] = i
        first = lambda data: (len(data) != 2 or data[1] != 0, raw[data])
        order = sorted(raw, key=first)
        self.of_rank = [raw[data] for data in order]
        self.merge = tiktoken.Encoding("own", pat_str="[^\0]+\0", mergeable_ranks={data: k for k, data in enumerate(order)}, special_tokens={}).encode_ordinary

    def _encoded(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ranks = self.merge(_END_OF_WORD.join([*_PARTS.findall(text.lower()), ""]))
        ids = [self.of_rank[k] for k in ranks]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit numbers."""
        words = text.encode().split()  # at 0x20 and 0x09-0x0D
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            if word not in known and len(word) <= REMEMBERED_BYTES:
                known[word] = self._encoded(word)
        return b"".join([known[w] if w in known else self._encoded(w) for w in words])


@lru_cache(1)
def word_ids(name: str) -> WordIds:
    return WordIds(name)


def pieces(docs: DataFrame, name: str = FILE, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row a piece; own_sequence is a number below 0 for a full piece, and null for one that is to be packed."""

    def run(batches):
        own = word_ids(name)
        tail = np.array([end], "<u4").tobytes()
        done = 0  # full pieces of this partition, whose rows alone have its doc_keys
        rows: list[tuple] = []

        def out():
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5] + [pa.list_(pa.int32())] * with_ids
        for batch in batches:
            for doc_id, text, key in zip(*(batch.column(c) for c in ("doc_id", "text", "doc_key"))):
                ids = own.ids(text.as_py() or "") + tail
                key = key.as_py()
                for piece, low in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[low : low + 4 * length]
                    row = (doc_id.as_py(), piece, low // 4, len(part) // 4, zlib.crc32(part), key)
                    if len(part) == 4 * length:
                        done += 1
                        row += (-(key >> 33 << 33) - done,)
                    else:
                        row += (None,)
                    rows.append(row + (np.frombuffer(part, "<i4"),) if with_ids else row)
                    if len(rows) >= (ROWS >> 6 if with_ids else ROWS):
                        yield out()
        if rows:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("doc_key"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item, longest first into the bin with the least room that suffices, and the bins' fills."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]  # by room
    rooms = 0  # bit r: there is an open bin with room r
    fills: list[int] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, chosen = length, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += size
        left = room - size
        if left:
            open_bins[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def packed_nodes(items: DataFrame, length: int, near: int, most_up: int) -> DataFrame:
    """items(node, item, size), each node by best fit; a bin has its first item's number; up: it goes on to the node above."""

    def node_of(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        item, size = (table.column(c).to_numpy() for c in ("item", "size"))
        bins, offsets, fills = best_fit(size, length)
        first = np.empty(len(fills), np.int64)
        first[bins[offsets == 0]] = item[offsets == 0]
        up = np.zeros(len(fills), bool)
        up[np.argsort(fills, kind="stable")[:most_up]] = True
        up &= fills < length - near
        columns = [table.column("node"), table.column("item"), first[bins], offsets, fills[bins], up[bins]]
        return pa.table(columns, names=["node", "item", "bin", "offset", "fill", "up"])

    return items.groupBy("node").applyInArrow(node_of, PLACES)


def placed(items: DataFrame, length: int = LENGTH, most: int = ITEMS, fan: int = FAN, near: int = NEAR) -> DataFrame:
    """items(item, size) with sequence_id and offset; a sequence has the number of one of its items."""
    nodes = max(1, -(-items.count() // most))
    level = items.select(F.pmod(F.xxhash64("item"), F.lit(nodes)).alias("node"), "item", "size")
    levels = []
    while True:
        found = stored(packed_nodes(level, length, near, most // fan if nodes > 1 else 0))
        levels.append(found.select("item", "bin", "offset"))
        if nodes == 1:
            break
        nodes = -(-nodes // fan)
        above = F.floor(F.col("node") / fan).cast("long").alias("node")
        level = found.where(F.col("up") & (F.col("item") == F.col("bin"))).select(above, "item", F.col("fill").alias("size"))
    final = levels.pop().withColumnRenamed("bin", "sequence_id")
    while levels:
        higher = final.select(F.col("item").alias("bin"), F.col("sequence_id").alias("_to"), F.col("offset").alias("_more"))
        own = levels.pop().join(higher, "bin", "left")
        final = own.select("item", F.coalesce("_to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("_more", F.lit(0))).alias("offset"))
    return final


def packed(docs: DataFrame, name: str = FILE, length: int = LENGTH, end: int = END, with_ids: bool = False, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, and its ids if asked for."""
    found = stored(pieces(docs, name, length, end, with_ids))
    rest = found.where("own_sequence is null")
    places = placed(rest.select(F.col("doc_key").alias("item"), F.col("length").alias("size")), length, **how)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    whole = found.where("own_sequence is not null").withColumn("sequence_id", F.col("own_sequence")).withColumn("offset", F.lit(0).cast("long"))
    return whole.select(keep).unionByName(rest.join(places, F.col("doc_key") == F.col("item")).select(keep))


def sequences(docs: DataFrame, **how) -> DataFrame:
    """A row a sequence: its ids, and the pieces in it with their places. A sequence holds `length` tokens at most."""
    rows = packed(docs, with_ids=True, **how)
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    rows = rows.groupBy("sequence_id").agg(inside.alias("inside"))
    return rows.select(
        "sequence_id",
        F.flatten("inside.ids").alias("ids"),
        F.transform("inside", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["piece"])).alias("pieces"),
    )
