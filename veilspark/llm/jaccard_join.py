"""N-gram Jaccard join with several global token orders.

Two sets of similarity at least t must share k tokens in the first
n - ceil(t * n) + k tokens of each set, whatever the global order of tokens.  So
a pair is verified only if it shares such prefix tokens under every one of several
orders.  The first order (tokens that are common in the corpus last, by a fixed-size
count sketch) deals documents into buckets over the cluster; within united buckets
all orders, the first again, and a size filter are intersected before sets are compared.

Equal sets form one class and only its smallest doc_id goes on.  A bucket holds one
token and one size class.  A document with fewer than k tokens in buckets of two or
more has no partner and goes no further (k is a fixed share of its size).  Buckets
of one leader (smallest doc_id in the bucket) are united, so each of the others
goes to few groups.  A group over GROUP_TOKENS
tokens is dealt into blocks, and pairs of blocks are joined apart.  A group emits a
spanning forest of its links, never its pairs; alternating stars over the forest
give the components.  No link between different sets is lost.

Nulls and edge cases: a null or empty text has an empty set, linked with nothing
(its component is its own doc_id); a null doc_id is returned with a null
component and linked with nothing; of rows that share a doc_id each gets its own
row, and they count as one document for the component; an empty table gives an
empty result; extra columns are ignored by components() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import BROADCAST_IDS, dropped, stored, with_ids

SHINGLE, PERCENT = 4, 85
#: Under the first order a pair must share one prefix token, and one more for so many tokens of the set.
EACH = 40
SKETCH_BITS = 18
#: Seeds of the further orders, in which tokens are ranked by a mixed hash.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Tokens and sets in a block; a task holds two blocks at most.
GROUP_TOKENS, GROUP_SETS = 1 << 20, 1 << 12


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index of a chunk's first document, its documents' distinct shingles in ascending order, and where each begins."""
    for words in kernel.chunks(batch.column("text")):
        grams, first = kernel.grams(words, words.hashes(), shingle, True)
        doc = np.repeat(np.arange(words.n_docs), np.diff(first))
        order = np.lexsort((grams, doc))
        grams = grams[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        yield words.low, grams[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=words.n_docs))])


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many (document, token) pairs fall in each of a fixed number of slots, over all documents."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, tokens, _ in _sets(batch, shingle):
                total += np.bincount(_slot(tokens), minlength=len(total))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = rows.toArrow()  # at most 2 ** SKETCH_BITS rows, however many documents
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix in which a partner must show."""
    return n - (-(-percent * n // 100)) + (n > 0)


def _prefixes(docs: DataFrame, sketch, shingle: int, percent: int) -> DataFrame:
    """doc_id, set size, 128-bit hash of the set, and its prefix under the first order."""

    def rows(batches):
        counts = sketch.value
        for batch in batches:
            for low, tokens, first in _sets(batch, shingle):
                size = np.diff(first)
                doc = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((tokens, counts[_slot(tokens)], doc))
                rank = np.arange(len(tokens)) - np.repeat(first[:-1], size)
                need = np.minimum(size, _need(size, percent) + size // EACH)
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernel.mix(tokens ^ np.uint64(s)))]) for s in ORDERS]
                sums = [(t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total]
                prefix = tokens[order][rank < np.repeat(need, size)].view(np.int64)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(need)]).astype(np.int32), pa.array(prefix))
                ids = batch.column("doc_id").slice(low, len(size)).cast(pa.int64())
                columns = [ids, pa.array(size.astype(np.int64)), *map(pa.array, sums), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "prefix"])

    schema = "doc_id long, n long, h1 long, h2 long, prefix array<long>"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def _groups(reps: DataFrame, percent: int) -> DataFrame:
    """(leader, doc_id, n): documents that may have a partner, under the leaders of their buckets."""
    rows = reps.select("doc_id", "n", F.explode("prefix").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    rows = stored(rows.join(shared, "token").select("token", "doc_id", "n"))
    # sizes of a pair differ by a factor of 100 / percent at most, so their classes by one at most
    level = F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9))).cast("int")
    rows = rows.select("token", "doc_id", "n", F.explode(F.array(level, level + 1)).alias("level"))

    def buckets(rows):
        many = rows.groupBy("token", "level").agg(F.count("*").alias("c"), F.min("doc_id").alias("leader"))
        return rows.join(many.where("c > 1").drop("c"), ["token", "level"])

    # the smallest partner's share is what must be met
    need = F.floor(F.ceil(F.col("n") * percent / 100) / EACH) + 1
    near = buckets(rows).select("doc_id", "n", "token").distinct().groupBy("doc_id", "n").agg(F.count("*").alias("c"))
    rows = rows.join(near.where(F.col("c") >= need).select("doc_id"), "doc_id", "left_semi")
    return buckets(rows).select("leader", "doc_id", "n").distinct()


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def tops(self, found: np.ndarray) -> np.ndarray:
        root = self.up[found]
        while True:
            above = self.up[root]
            if (above == root).all():
                return root
            root = above


def _lists(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, where each one's owners begin, and the owners."""
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    return tokens[at], np.concatenate([at, [len(tokens)]]), owner


def _gather(index: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """The owners of each of the given tokens, in one array."""
    keys, at, owner = index
    k = np.searchsorted(keys, tokens)
    k = k[(k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == tokens)] if len(keys) else k[:0]
    start, n = at[k], at[k + 1] - at[k]
    if not len(k):
        return owner[:0]
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return owner[np.arange(n.sum()) + shift]


def forest(sets: list[np.ndarray], side: np.ndarray, percent: int, counts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets, as pairs of positions.

    side: 0 or 1; where both occur, only links between the sides are looked for. counts: of the sketch's slots, which
    give the first order.
    """
    sizes = np.array([len(s) for s in sets])
    both = side.any() and not side.all()
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    own_prefix, prefix_index = [], []
    need = _need(sizes, percent)
    rank = np.arange(len(tokens)) - np.repeat(first[:-1], sizes)
    orders = [(kernel.mix(tokens ^ np.uint64(seed)), owner) for seed in ORDERS]
    if counts is not None:
        orders.insert(0, (tokens, counts[_slot(tokens)], owner))
    for keys in orders:
        order = np.lexsort(keys)
        head = order[rank < np.repeat(need, sizes)]
        prefix_index.append(_lists(tokens[head], owner[head]))
        own_prefix.append((tokens[head], np.concatenate([[0], np.cumsum(need)])))
    whole = _lists(tokens, owner)
    trees, out = _Forest(len(sets)), []
    for x in range(len(sets)):
        if both and side[x]:
            continue
        maybe = np.zeros(len(sets), bool)
        maybe[x + 1 :] = True
        if both:
            maybe = side.astype(bool)
        maybe &= (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
        for index, (heads, at) in zip(prefix_index, own_prefix, strict=True):
            if not maybe.any():
                break
            seen = np.zeros(len(sets), bool)
            seen[_gather(index, heads[at[x] : at[x + 1]])] = True
            maybe &= seen
        found = np.flatnonzero(maybe)
        found = found[trees.tops(found) != trees.top(x)]
        if not len(found):
            continue
        if len(found) < 4:
            common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in found])
        else:
            common = np.bincount(_gather(whole, sets[x]), minlength=len(sets))[found]
        for y in found[100 * common >= percent * (sizes[x] + sizes[found] - common)]:
            a, b = trees.top(x), trees.top(int(y))
            if a != b:
                trees.up[max(a, b)] = min(a, b)
                out.append((x, int(y)))
    return out


def _links(docs: DataFrame, groups: DataFrame, sketch, shingle: int, percent: int) -> DataFrame:
    """(u, v) with u > v: a spanning forest of each block's links."""

    def sets(batches):
        for batch in batches:
            for low, tokens, first in _sets(batch, shingle):
                lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(tokens.view(np.int64)))
                ids = batch.column("doc_id").slice(low, len(first) - 1).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "tokens"])

    def joined(batches):
        key, members = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j")), strict=True))
            ids, blocks, lists = (batch.column(c) for c in ("doc_id", "block", "tokens"))
            values, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for r, now in enumerate(keys):
                if now != key:
                    yield from solved(key, members)
                    key, members = now, []
                # a copy: the batch must not live on
                members.append((ids[r].as_py(), blocks[r].as_py(), values[at[r] : at[r + 1]].copy()))
        yield from solved(key, members)

    def solved(key, members):
        if len(members) < 2:
            return
        ids = np.array([m[0] for m in members])
        side = np.array([m[1] == key[2] and key[1] != key[2] for m in members])
        pairs = forest([m[2] for m in members], side, percent, sketch.value)
        if pairs:
            a, b = (ids[list(x)] for x in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    parts = F.greatest(F.ceil(F.sum("n") / GROUP_TOKENS), F.ceil(F.count("*") / GROUP_SETS))
    blocks = groups.groupBy("leader").agg(parts.cast("int").alias("k"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int")
    dealt = groups.join(blocks, "leader").select("leader", "doc_id", block.alias("block"), "k")
    pair = lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), pair)
    dealt = stored(dealt.select("leader", "doc_id", "block", F.inline(others)))
    n_dealt = dealt.count()
    found = with_ids(docs.select("doc_id", "text"), dealt.select("doc_id").distinct(), n_dealt, "left_semi")
    found = found.mapInArrow(sets, "doc_id long, tokens array<long>")
    rows = found.join(F.broadcast(dealt) if n_dealt <= BROADCAST_IDS // 2 else dealt, "doc_id")
    rows = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return rows.mapInArrow(joined, "u long, v long")


def components_of(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has a link, but the smallest of its component, with that smallest one.

    Alternating large and small stars: every round relinks nodes to their smallest
    neighbour, so rounds grow with the logarithm of a component's size. Each round's
    table is written to the shared folder.
    """
    edges, mark = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == mark or not now[0]:
            return edges
        mark = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(edges)
        edges = after


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of the equal sets) and component_id, a row a document."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs, shingle))
    rows = stored(_prefixes(docs, sketch, shingle, percent))
    real = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = real.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("c"))
    classes = stored(classes.where("c > 1").drop("c"))
    copies = real.join(classes, ["h1", "h2", "n"]).where("doc_id <> class_id").select("doc_id", "h1", "h2").distinct()
    copies = stored(copies)
    reps = real.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS // 2 else copies, ["doc_id", "h1", "h2"], "left_anti")
    groups = stored(_groups(reps, percent))
    links = _links(docs, groups, sketch, shingle, percent)
    # a doc_id that several different texts share is one node
    several = real.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("c")).where("c > 1").select("doc_id")
    same = real.join(several, "doc_id", "left_semi").join(classes, ["h1", "h2", "n"])
    same = same.select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")).where("u <> v")
    tops = components_of(links.unionAll(same)).select(F.col("u").alias("class_id"), F.col("v").alias("top"))
    out = rows.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id")).join(tops, "class_id", "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(linked, F.coalesce("top", "class_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, of its smallest doc_id (of several rows with that id the least by text); all columns stay.

    Rows without a doc_id are linked with nothing, so each of them stays.
    """
    found = stored(components(docs, shingle, percent))
    gone = stored(found.where("component_id < doc_id").select("doc_id").distinct())
    left = with_ids(docs, gone, gone.count(), "left_anti").select(*docs.columns)
    several = stored(found.where("doc_id IS NOT NULL AND component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    n = several.count()
    if not n:
        return left
    # only rows that share their id are dealt anew
    own = F.struct(*[F.col(c) for c in docs.columns])
    alike = with_ids(left, several, n, "left_semi")
    least = alike.groupBy("doc_id").agg(F.min_by(own.alias("_own"), F.struct("text", F.xxhash64(*docs.columns))).alias("_own"))
    return with_ids(left, several, n, "left_anti").select(*docs.columns).unionByName(least.select("_own.*"))
