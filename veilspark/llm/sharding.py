"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns VNODES points of a 32-bit ring; a key belongs to the first point
at or after its hash.  No shard takes more than its capacity: rows // shards, and
one more for the first rows % shards.  Keys that overflow a full shard continue
clockwise to the next shard with room, hop by hop, so counts differ by one at most
(the law "rows") and a change moves few rows beyond those it must.

All keys between two points meet the same shards in the same order, so the walk
needs only the number of rows in each arc: shards * VNODES counts, whatever the
number of rows.  Rows are then ranked inside their arc, which gives the shard and
a gapless slot at once, with one shuffle of ids and sizes and none of the texts.
Where columns are asked for, whole rows are written once and meet their places in one
join by row number, whose smaller side has the places only.

Nulls and edge cases: a null doc_id is placed by its text's checksum; a null text
has no bytes and checksum 0; equal rows are interchangeable and take slots of
their own; an empty table gives an empty result; extra columns are ignored by
placed() unless they are asked for.

Rows that share a doc_id have one key and stand side by side.  With `apart` the second,
third and further ones have keys of their own, so that repetitions of a document, as
mixing makes them, are spread over the ring.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS, VNODES = 40, 128
ROW_BYTES = 16


def points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; of equal positions the smallest shard's counts."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            p = int(hashlib.md5(f"{shard}/{v}".encode()).hexdigest()[:8], 16)
            at[p] = min(shard, at.get(p, shard))
    return sorted(at.items())


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], ring: list[tuple[int, int]], shards: int) -> list[dict]:
    """Pieces (arc, low, high, shard, slot): ranks low..high - 1 of an arc stand in a shard from a slot on.

    Hop by hop, arcs offer what is left of them to the next shard clockwise that they have not met.
    """
    room = capacities(sum(counts.values()), shards)
    used, left = [0] * shards, dict(counts)
    at, met = {a: a for a in counts}, {a: set() for a in counts}
    pieces = []
    while any(left.values()):
        for arc in sorted(a for a in left if left[a]):
            while (shard := ring[at[arc]][1]) in met[arc]:
                at[arc] = (at[arc] + 1) % len(ring)
            met[arc].add(shard)
            take = min(left[arc], room[shard] - used[shard])
            if take:
                low = counts[arc] - left[arc]
                pieces.append({"arc": arc, "low": low, "high": low + take, "shard": shard, "base": used[shard]})
                used[shard] += take
                left[arc] -= take
    return pieces


def placed(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, columns: list[str] = (), apart: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, then those of its columns that are asked for."""
    extra = [c for c in columns if c not in ("doc_id", "text")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in ["doc_id", "text", *extra]]).alias("_own"), F.monotonically_increasing_id().alias("_row"))
    if columns:
        whole = stored(whole)  # numbers and rows must stay together: places are found without the rows, which join them at the end
    text = F.col("_own.text")
    crc = F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    key = F.coalesce(F.col("_own.doc_id").cast("string"), F.concat(F.lit("crc/"), crc.cast("string")))
    rows = whole.select(F.col("_own.doc_id").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), key.alias("key"), F.xxhash64(text).alias("same"), "_row")
    if apart:
        # rows of one id and text are few: repetitions; without an id they count by text
        copy = F.row_number().over(Window.partitionBy("doc_id", "same").orderBy("_row")) - 1
        rows = rows.withColumn("copy", copy)
        rows = rows.withColumn("key", F.when(F.col("copy") > 0, F.concat("key", F.lit("/"), F.col("copy").cast("string"))).otherwise(F.col("key")))
    if not columns:
        rows = rows.drop("_row")
    rows = _ranked(rows.drop("same", "copy"), points(shards, vnodes), shards)
    if not columns:
        return rows
    own = [F.col("_own")[c].alias(c) for c in columns if c not in ("doc_id", "size", "text_crc32", "shard", "slot")]
    return rows.hint("shuffle_hash").join(whole, "_row").select("doc_id", "size", "text_crc32", "shard", "slot", *own)


def _ranked(rows: DataFrame, ring: list[tuple[int, int]], shards: int) -> DataFrame:
    """rows(key, doc_id, size, text_crc32, ...) with shard and slot in place of key."""
    # the first point at or after the key, past the last one the first
    ends = F.array(*[F.lit(p) for p, _ in ring])
    at = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long")
    arc = F.pmod(_first_at_least(ends, F.col("at"), len(ring)), F.lit(len(ring)))
    rows = rows.withColumn("at", at).withColumn("_ends", ends).withColumn("arc", arc).drop("_ends", "key")
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}  # a row an arc at most
    pieces = walk(counts, ring, shards)
    schema = "array<struct<arc int, low long, high long, shard int, base long>>"
    table = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(pieces)), schema)))
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("at", "doc_id", "text_crc32", "size")) - 1
    rows = rows.withColumn("rank", rank.cast("long"))
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    rows = rows.join(F.broadcast(table), "arc").where(inside).withColumn("slot", F.col("base") + F.col("rank") - F.col("low"))
    return rows.drop("arc", "at", "rank", "low", "high", "base")


def _first_at_least(ends, at, n: int):
    """How many of the n sorted ends lie before `at`: a binary search of a fixed number of steps."""
    steps = max(1, n.bit_length())
    probe = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(s, _):
        mid = probe(s)
        right = F.get(F.col("_ends"), mid) < F.col("at")
        return F.when(s["lo"] >= s["hi"], s).otherwise(
            F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]


def written(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents under path, a folder a shard, each with its slot and all its columns."""
    rows = placed(docs, shards, columns=[c for c in docs.columns if c != "doc_id"])
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
