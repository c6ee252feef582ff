"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words of letters and their first few bytes,
hashed into 2 ** BITS buckets, each with how often it occurs (LEVELS).  The ones
most associated with the label are kept; the score is sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>), so that a pair of terms
(an insult with a group's name) can weigh more, or less, than the two alone.

Learning uses a bounded sample of labelled rows (`per_label` of each label, those of the
smallest hashed ids, of texts up to `sample_bytes`); every document is scored, whole.

Nulls and edge cases: null and empty texts have no terms and score sigmoid(w0);
labels other than 0 and 1, and null ids, are not learned from; without rows of both
labels, or any term that tells them apart, every score is 0; repeated rows are scored each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import BROADCAST_IDS

BITS, FEATURES, FACTORS = 20, 2048, 8
HEADS = [0, 4, 5, 6, 7]
#: A term that occurs so often is a term of its own, beside that of fewer times.
LEVELS = (1, 2, 4)
SAMPLE, SAMPLE_BYTES = 4000, 1 << 16
#: How far a term's shares under the two labels must differ for it to be kept, so that few are there by chance.
CHI_SQUARE = 15.0
#: So many of the most common terms, but those in nearly all documents, are kept whatever they tell alone.
COMMON, COMMON_SHARE = 32, 0.6
STEPS, RATE, DECAY = 150, 0.05, 2e-3


@dataclass
class Machine:
    bias: float
    index: np.ndarray  # term -> feature, or -1
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """For n documents, given their distinct (row, feature) pairs."""
        total = self.bias + np.bincount(rows, self.weight[features], n)
        for column in self.factor.T:
            v = column[features]
            total += (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)) / 2
        return total


def _terms(words: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each term, with repeats."""
    doc = np.repeat(np.arange(words.n_docs), words.counts)
    long = words.end - words.start
    rows, buckets = [], []
    for k, h in zip(HEADS, words.head_hashes(HEADS), strict=True):
        use = long > k if k else long > 0
        buckets.append((kernel.mix(h[use] + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(doc[use])
    return np.concatenate(rows), np.concatenate(buckets)


def _leveled(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs from a document's buckets with repeats; a term is a bucket and a level."""
    code, n = np.unique(rows << BITS | buckets, return_counts=True)
    row, term = code >> BITS, (code & ((1 << BITS) - 1)) * len(LEVELS)
    found = [(row[n >= least], term[n >= least] + k) for k, least in enumerate(LEVELS)]
    row, term = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((term, row))
    return row[order], term[order]


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """label and the distinct buckets of each sampled document."""
    marks = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select("doc_id", "label").distinct()
    sizes = docs.where("text IS NOT NULL").select("doc_id", (F.octet_length("text") > sample_bytes).alias("_long"))
    # shorter texts first; of a long one the start is learned from
    order = Window.partitionBy("label").orderBy("_long", F.xxhash64("doc_id"), "doc_id")
    marks = sizes.join(marks, "doc_id").distinct().withColumn("_r", F.row_number().over(order)).where(f"_r <= {per_label}").drop("_r")

    def terms(batches):
        for batch in batches:
            for words in kernel.chunks(batch.column("text"), kernel.NOT_LETTER):
                rows, buckets = _leveled(*_terms(words))
                at = np.searchsorted(rows, np.arange(words.n_docs + 1))
                lists = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(buckets.astype(np.int32)))
                own = batch.column("label").slice(words.low, words.n_docs)
                yield pa.RecordBatch.from_arrays([own, lists], ["label", "buckets"])

    long = F.octet_length("text") > sample_bytes
    text = F.when(long, F.substring("text", 1, sample_bytes // 4)).otherwise(F.col("text"))  # a character has 4 bytes at most
    texts = docs.where("text IS NOT NULL").select("doc_id", long.alias("_long"), text.alias("text"))
    near = F.broadcast(marks) if 2 * per_label <= BROADCAST_IDS else marks
    rows = texts.join(near, ["doc_id", "_long"]).select(F.col("label").cast("int").alias("label"), "text")
    return rows.mapInArrow(terms, "label int, buckets array<int>")


def learn(rows: pa.Table) -> Machine | None:
    """A machine from a table of label and buckets; None without both labels or any term that tells. Rows are sorted first."""
    labels = rows.column("label").to_numpy().astype(np.float64)
    lists = rows.column("buckets").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    term = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    # an order that doesn't depend on how the rows came in: by label and the sum of the terms' hashes
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernel.mix(term.astype(np.uint64)))])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    order = np.lexsort((total[edge[1:]] - total[edge[:-1]], labels))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    y, doc = labels[order], place[doc]
    if not 0 < y.sum() < len(y):
        return None
    pos, neg = (np.bincount(term[y[doc] == v], minlength=len(LEVELS) << BITS) for v in (1, 0))
    p, q = (pos + 0.5) / (y.sum() + 1), (neg + 0.5) / ((1 - y).sum() + 1)
    share = (pos + neg + 1) / (len(y) + 2)
    sure = (p - q) ** 2 / (share * (1 - share) * (1 / y.sum() + 1 / (1 - y).sum())) >= CHI_SQUARE
    gain = np.abs(np.log(p / q)) * np.abs(p - q) * sure
    chosen = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = chosen[gain[chosen] > 0]
    # terms that tell nothing alone may tell something in pairs; only common ones have pairs enough to learn from
    common = np.where(share < COMMON_SHARE, pos + neg, 0)
    common = np.argsort(-common, kind="stable")[:COMMON]
    chosen = np.union1d(chosen, common[(pos + neg)[common] >= 3])
    if not len(chosen):
        return None
    index = np.full(len(LEVELS) << BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    use = index[term] >= 0
    x = np.zeros((len(order), len(chosen)), np.float32)
    x[doc[use], index[term[use]]] = 1
    rng = np.random.default_rng(9)
    params = [np.zeros(1), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS))]
    first, second = ([np.zeros_like(a) for a in params] for _ in range(2))
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both labels weigh the same
    for step in range(1, STEPS + 1):
        bias, w, v = params
        sums = x @ v.astype(np.float32)
        squares = x @ (v * v).astype(np.float32)
        margin = bias[0] + x @ w.astype(np.float32) + ((sums * sums - squares) / 2).sum(1)
        error = (share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)).astype(np.float32)
        back = x.T @ error
        grads = [np.array([error.sum()]), back + DECAY * w, x.T @ (error[:, None] * sums) - v * back[:, None] + DECAY * v]
        for a, g, m, s in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            a -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), index, params[1], params[2])


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of every document."""
    if machine is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of a fixed size

    def rows(batches):
        m = shared.value
        known = (m.index.reshape(-1, len(LEVELS)) >= 0).any(1)  # buckets of which some level counts
        for batch in batches:
            for words in kernel.chunks(batch.column("text"), kernel.NOT_LETTER):
                doc, bucket = _terms(words)
                use = known[bucket]
                doc, term = _leveled(doc[use], bucket[use])
                feature = m.index[term]
                margin = m.margins(doc[feature >= 0], feature[feature >= 0], words.n_docs)
                value = pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(words.low, words.n_docs), value], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Learn from labels (doc_id, label) and score every document.

    per_label documents of each label are learned from, of up to sample_bytes each.
    """
    return score(docs, learn(sample(docs, labels, per_label, sample_bytes).toArrow()))
