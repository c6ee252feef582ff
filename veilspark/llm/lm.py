"""Language-model scoring of every text, beside a unigram base score.

Words are runs of characters outside 0x20 and 0x09-0x0D, A-Z lower-cased; a text
is its words and one end.  The base score is the sum of log10((c + 1) / (N + V + 1))
over them, with counts of all training documents.  The model (attention.py) scores
the same text as subword ids of a fixed public vocabulary.

All that the model knows is counted in all training documents, whole.  One pass counts
words, and pairs of neighbouring pieces; the pairs' counts fix which pieces have a table
row and a class of their own, the table's start, and the pairs of rows that get a row
of their own.  A second pass counts which classes follow those pairs, and which follow
rows at some distances; attention's values are made of the latter (attention.counted).
No token is left out and nothing is drawn; what the driver holds has a fixed size.

With a rate, attention is trained by gradients instead, on windows whose hash falls
under the rate: they are dealt over as many trainers as they fill (PART windows each); a
trainer makes a pass in numpy, the trainers' parameters are averaged, and the next
of attention.ROUNDS passes starts from there.  At a rate of 1 that is all windows.

Word counts stay distributed: the HEAD most frequent words are broadcast, and what a
document has besides them is joined with the whole vocabulary on the word's hash.

Nulls and edge cases: a null or empty text is the end alone; rows that share an id
are scored each; a null doc_id is no training document and not held out; without any
training document the base counts are 0 and the model's classes uniform; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention, kernel, subwords
from .common import stored

HEAD = 1 << 18
#: Windows a trainer has; pairs that a task counts before it passes them on; files of parameters that are averaged at once; counts handed on at once.
PART, PAIRS, MERGE, PLACES = 1 << 13, 1 << 20, 64, 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _gathered(train: DataFrame, mergeable, rate: float) -> DataFrame:
    """Of all training documents: kind 0, words by hash; 1, pairs of pieces; 2, windows drawn at a rate; with how often each occurs."""

    def gather(batches):
        encoder = subwords.encoder(mergeable.value)
        start = encoder.size + 1
        seen = np.zeros(0, np.int64)  # of each word that the encoder remembers, those of earlier tasks too
        pairs, n, new = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        for batch in batches:
            for words in kernel.chunks(batch.column("text")):
                if encoder.full:
                    yield _words(encoder, seen)
                    seen = np.zeros(0, np.int64)
                slots, _ = encoder.slots(words)
                ids, first = _with_ends(encoder, words, slots)
                if rate:
                    hashes, windows = attention.drawn(ids, first, rate, start)
                    if len(hashes):
                        yield _rows(2, hashes, np.ones(len(hashes), np.int64), windows)
                new.append(attention.before(ids, first, start) * (start + 1) + ids)
                if sum(map(len, new)) > PAIRS:
                    (pairs, n), new = _added(pairs, n, np.concatenate(new)), []
                    if len(pairs) > PAIRS:
                        yield _rows(1, pairs, n)
                        pairs, n = pairs[:0], n[:0]
                own = np.bincount(slots, minlength=len(encoder.hashes))
                own[: len(seen)] += seen
                seen = own
        yield _words(encoder, seen)
        if new:
            yield _rows(1, *_added(pairs, n, np.concatenate(new)))
        elif len(pairs):
            yield _rows(1, pairs, n)

    rows = train.select("text").mapInArrow(gather, "kind int, word long, n long, window binary")
    return stored(rows.groupBy("kind", "word", "window").agg(F.sum("n").alias("n")))


def _added(keys: np.ndarray, n: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with counts, and each of more counted in."""
    found, m = np.unique(more, return_counts=True)
    keys, n = np.concatenate([keys, found]), np.concatenate([n, m])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _words(encoder: subwords.Encoder, seen: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(seen)
    return _rows(0, encoder.hashes[some], seen[some])


def _rows(kind: int, keys: np.ndarray, n: np.ndarray, windows: np.ndarray | None = None) -> pa.RecordBatch:
    if windows is None:
        packed = pa.nulls(len(keys), pa.binary())
    else:
        at = np.arange(len(keys) + 1, dtype=np.int32) * (windows.shape[1] * 4)
        packed = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(windows))])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), packed], ["kind", "word", "n", "window"])


def _summed(rows: DataFrame, symbols: int, places, size: int) -> np.ndarray:
    """Counts of pairs of pieces, added up at places(first, second) of a table of a fixed size."""

    def add(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            code, n = batch.column("word").to_numpy(), batch.column("n").to_numpy()
            for at in places(code // symbols, code % symbols):
                np.add.at(total, at, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    found = rows.where("kind = 1").select("word", "n").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def _shape(rows: DataFrame, n_pieces: int) -> tuple[attention.Start, np.ndarray]:
    """Rows, classes and the table's start, and the counts of pieces, all from the counted pairs."""
    symbols = n_pieces + 1
    counts = _summed(rows, symbols, lambda a, b: [b], n_pieces)
    row, n_rows = attention.ranked(counts)
    around = _summed(rows, symbols, lambda a, b: attention.views(row, n_rows, a, b), 2 * n_rows * (attention.HEADS + 1))
    shape = attention.shaped(row, n_rows, counts, around)
    pairs = _summed(rows, symbols, lambda a, b: [shape.pairs(a, b)], shape.n_rows * shape.n_classes)
    return attention.Start.of(shape, counts, pairs), counts


def _pairs(rows: DataFrame, shape: attention.Shape) -> np.ndarray:
    """Codes of the attention.PAIRS most frequent pairs of rows, sorted."""
    symbols, row = shape.start + 1, np.append(shape.row, shape.n_rows - 1)

    def code(batches):
        for batch in batches:
            word = batch.column("word").to_numpy()
            codes = row[word // symbols] * shape.n_rows + row[word % symbols]
            yield pa.RecordBatch.from_arrays([pa.array(codes), batch.column("n")], ["code", "n"])

    found = rows.where("kind = 1").select("word", "n").mapInArrow(code, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return np.sort(found.orderBy(F.desc("n"), "code").limit(attention.PAIRS).select("code").toArrow().column("code").to_numpy())


def _counted(train: DataFrame, mergeable, rows: DataFrame, begin: attention.Start) -> attention.Model:
    """A model of the counts of all training documents, in a second pass over them."""
    shape, pairs = begin.shape, _pairs(rows, begin.shape)
    shared = train.sparkSession.sparkContext.broadcast((shape, pairs))
    n_near = len(pairs) * shape.n_classes

    def count(batches):
        encoder = subwords.encoder(mergeable.value)
        shape, pairs = shared.value
        places = attention.places_of(pairs, shape.n_rows)
        total = np.zeros(n_near + shape.n_rows * shape.n_classes, np.int64)
        for batch in batches:
            for words in kernel.chunks(batch.column("text")):
                ids, first = _with_ends(encoder, words, encoder.slots(words)[0])
                attention.contexts(shape, places, ids, first, total[:n_near], total[n_near:])
        some = np.flatnonzero(total)
        for few in np.split(some, range(PLACES, len(some), PLACES)):
            yield pa.RecordBatch.from_arrays([pa.array(few), pa.array(total[few])], ["at", "n"])

    found = train.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(n_near + shape.n_rows * shape.n_classes, np.int64)
    total[found.column("at").to_numpy()] = found.column("n").to_numpy()
    shared.destroy()
    return begin.counted(pairs, total[:n_near], total[n_near:])


def _trained(rows: DataFrame, begin: attention.Start) -> attention.Model:
    """Rounds of passes over all drawn windows, each trainer over its own; parameters are averaged after every pass."""
    spark = rows.sparkSession
    windows = rows.where("kind = 2").select("word", "window")
    parts = -(-windows.count() // PART)
    p = begin.parameters()
    shared = spark.sparkContext.broadcast(begin)
    for done in range(attention.ROUNDS if parts else 0):
        now = spark.sparkContext.broadcast(p)

        def train(batches, now=now, done=done, rounds=attention.ROUNDS):
            own = [np.frombuffer(b"".join(batch.column("window").to_pylist()), np.int32).reshape(-1, attention.SPAN + 1) for batch in batches]
            if own and sum(map(len, own)):
                own = np.concatenate(own)
                found = attention.learn(shared.value, now.value, own, done, rounds)
                yield _parameters(len(own), attention.to_bytes(found))

        found = windows.repartition(parts, "word").sortWithinPartitions("word").select("window").mapInArrow(train, "n long, p binary")
        found, left = stored(found), parts
        while left > MERGE:
            left = -(-left // MERGE)
            found = stored(found.coalesce(left).mapInArrow(_mean, "n long, p binary"))
        last = found.coalesce(8).mapInArrow(_mean, "n long, p binary").toArrow()  # 8 rows of a fixed size
        p = attention.from_bytes(p, next(_mean(last.sort_by("n").to_batches())).column("p")[0].as_py())
        now.destroy()
    return begin.model(p)


def _parameters(n: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["n", "p"])


def _mean(batches):
    """One row: the mean of parameters, weighted by the windows behind them."""
    total, weight = None, 0
    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("p"), strict=True):
            own = np.frombuffer(data.as_buffer(), np.float32).astype(np.float64) * n
            total, weight = own if total is None else total + own, weight + n
    if weight:
        yield _parameters(weight, (total / weight).astype(np.float32).tobytes())


def _with_ends(encoder: subwords.Encoder, words: kernel.Words, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target pieces of the documents, each document's end among them, and where each one's begin."""
    ids, at = encoder.pieces(slots)
    first = at[words.first] + np.arange(words.n_docs + 1)
    out = np.full(first[-1], encoder.size, np.int64)
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = ids
    return out, first


def _targets(encoder: subwords.Encoder, words: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _with_ends(), and the words' slots."""
    slots, _ = encoder.slots(words)
    return *_with_ends(encoder, words, slots), slots


def _places(hashes: np.ndarray, slots: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where in head each word stands, or -1. A word that occurs again isn't sought again. hashes: of slots."""
    used = np.flatnonzero(np.bincount(slots, minlength=len(hashes)))
    h, out = hashes[used].view(np.int64), np.full(len(hashes), -1, np.int32)
    if len(head):
        k = np.minimum(np.searchsorted(head, h), len(head) - 1)
        out[used] = np.where(head[k] == h, k, -1)
    return out[slots]


def scores(docs: DataFrame, vocabulary: str = subwords.VOCABULARY, rate: float = 0.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row a document.

    rate: of the windows that attention is trained on by gradients; 0 counts all documents instead.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    table = subwords.ranks(vocabulary)
    mergeable = context.broadcast(table)
    n_pieces = max(table.values()) + 2  # the last one is a text's end
    gathered = _gathered(train, mergeable, rate)
    begin, counts = _shape(gathered, n_pieces)
    vocabulary_ = gathered.where("kind = 0").select("word", "n")
    n_ends = int(counts[-1])
    total, distinct = vocabulary_.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_tokens, n_distinct = total + n_ends, distinct + (n_ends > 0)
    head = vocabulary_.orderBy(F.desc("n"), "word").limit(HEAD).toArrow().sort_by("word")
    known = (head.column("word").to_numpy(), head.column("n").to_numpy())
    model = _trained(gathered, begin) if rate else _counted(train, mergeable, gathered, begin)
    shared = context.broadcast((model, known))
    scale = np.log10(n_tokens + n_distinct + 1)

    def score(batches):
        encoder = subwords.encoder(mergeable.value)
        model, (head, count) = shared.value
        weight = np.log10(count + 1.0) - scale
        base, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for words in kernel.chunks(batch.column("text")):
                n = words.n_docs
                target, at, slots = _targets(encoder, words)
                logs = np.concatenate([[0], np.cumsum(model.log_probabilities(target, at))])
                doc = np.repeat(np.arange(n), words.counts)
                k = _places(encoder.hashes, slots, head)
                inside = k >= 0
                sums = np.bincount(doc[inside], weight[k[inside]], n) if inside.any() else np.zeros(n)
                sums += np.log10(n_ends + 1) - scale
                found = np.bincount(doc[inside], minlength=n) + (n_ends > 0)
                rest = np.searchsorted(np.flatnonzero(~inside), words.first)
                tail = pa.ListArray.from_arrays(rest.astype(np.int32), pa.array(encoder.hashes[slots[~inside]].view(np.int64)))
                columns = [
                    pa.array(base + row + np.arange(n)),
                    batch.column("doc_id").slice(words.low, n),
                    pa.array((words.counts + 1).astype(np.int64)),
                    pa.array(found.astype(np.int64)),
                    pa.array(sums),
                    pa.array((logs[at[1:]] - logs[at[:-1]]) / np.log(10)),
                    tail,
                ]
                row += n
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "known", "sums", "score", "tail"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, n_tokens long, known long, sums double, score double, tail array<long>"
    rows = stored(docs.mapInArrow(score, schema))  # written: a row number holds, whatever is computed again
    words = rows.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("m"))
    words = words.join(vocabulary_, "word", "left")
    term = F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(float(scale))
    tails = words.groupBy("row").agg(F.sum(term * F.col("m")).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("m"))).alias("found"))
    out = rows.drop("tail").join(tails, "row", "left")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
