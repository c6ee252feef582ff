"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A
word's likelihood is the sum, over all ways to cut it into pieces, of the product
of the pieces' probabilities; the forward algorithm gives it in one pass over the
word.  A text's score is the sum of its words' log likelihoods, and the language
with the largest wins, with its posterior under equal priors.

Piece probabilities are learned by a few rounds of expectation maximisation on the
words of a bounded sample of every language (`sample` documents each, those of the
smallest hashed ids, of texts up to `sample_bytes`; where these are fewer, the first
`sample_bytes` characters of longer ones).  No language is left out: they are learned
and scored in blocks of BLOCK.  The vocabulary is never trained; its file is a
parameter, read on the driver.

Nulls and edge cases: a null text, or one without a letter, is `und` with score 0;
rows with a null lang or text are not learned from; without any language all is
`und`; repeated rows are judged each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import BROADCAST_IDS, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pieces of up to so many bytes are keyed by their bytes, longer ones by a hash of 56 bits; the length is in both.
EXACT = 7
SAMPLE, SAMPLE_BYTES = 300, 1 << 15
#: Languages learned, or scored, at once.
BLOCK = 64
ROUNDS, SMOOTH = 3, 0.05
#: Distinct words whose likelihoods a task remembers, and bytes handled at once, fewer with more languages than BLOCK; beyond it, it starts anew.
CACHE = 1 << 18
CHUNK = 1 << 21
#: Words of more bytes are scored alone, in windows of so many; for learning they are cut into stretches.
LONG, WINDOW, STRETCH = 512, 1 << 13, 64


_BASE = np.uint64(0xD6E8FEB86659FD93)


def _hashed(total: np.ndarray, length: int) -> np.ndarray:
    """Keys of pieces of more than EXACT bytes, from sums of (byte + 1) * _BASE ** (bytes after it)."""
    return kernel.mix(total) << np.uint64(8) | np.uint64(length)


def key(piece: bytes) -> int:
    if len(piece) <= EXACT:
        return int.from_bytes(piece, "big") << 8 | len(piece)
    total = 0
    for byte in piece:
        total = (total * int(_BASE) + byte + 1) % (1 << 64)
    return int(_hashed(np.array([total], np.uint64), len(piece))[0])


def pieces(path: str = VOCABULARY) -> np.ndarray:
    """Sorted keys of all pieces of the vocabulary that are of letters, lower case, and of all single bytes."""
    found = {bytes([b]) for b in range(256)}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0]).lower()
            piece = piece[1:] if piece[:1] == b" " else piece
            if 0 < len(piece) < 256 and not any(kernel.NOT_LETTER[list(piece)]):
                found.add(piece)
    keys = {key(p) for p in found}
    assert len(keys) == len(found)
    return np.array(sorted(keys), np.uint64)


@dataclass
class Table:
    """A hash table over piece keys with a row of probabilities a piece; row 0 is for no piece."""

    slots: np.ndarray
    rows: np.ndarray
    shift: int
    chance: np.ndarray  # (1 + pieces, languages)
    names: list[str]
    longest: int  # piece, in bytes

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    @classmethod
    def of(cls, keys: np.ndarray, chance: np.ndarray, names: list[str]) -> Table:
        bits = int(np.ceil(np.log2(len(keys) * 4)))
        slots, rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        for row, key in enumerate(keys.tolist(), 1):
            at = key * int(cls.FACTOR) % (1 << 64) >> 64 - bits
            while rows[at]:
                at = (at + 1) % (1 << bits)
            slots[at], rows[at] = key, row
        return cls(slots, rows, 64 - bits, chance, names, int((keys & np.uint64(255)).max()))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys, 0 for what is no piece."""
        at = (keys * self.FACTOR >> np.uint64(self.shift)).astype(np.int64)
        out = np.zeros(keys.shape, np.int32)
        open_ = np.arange(keys.size)
        flat, at, found = keys.ravel(), at.ravel(), out.ravel()
        while len(open_):
            here = at[open_]
            hit = self.slots[here] == flat[open_]
            found[open_[hit]] = self.rows[here[hit]]
            open_ = open_[~hit & (self.rows[here] > 0)]
            at[open_] = (at[open_] + 1) % len(self.rows)
        return found.reshape(keys.shape)


def _cut(words: np.ndarray, table: Table) -> np.ndarray:
    """For words of one length, as a byte matrix: rows of the piece that ends after byte j and has l bytes, at [j][l - 1]."""
    n, length = words.shape
    most = min(length, table.longest)
    out = np.zeros((length, most, n), np.int32)
    exact = np.zeros((min(most, EXACT), n), np.uint64)
    before = np.zeros((length + 1, n), np.uint64)  # sums of the bytes up to each place
    power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(most + 1)]
    for j in range(length):
        byte = words[:, j].astype(np.uint64)
        before[j + 1] = before[j] * _BASE + byte + np.uint64(1)
        for k in range(min(j + 1, len(exact)), 1, -1):
            exact[k - 1] = exact[k - 2] << np.uint64(8) | byte
        exact[0] = byte
        m = min(j + 1, len(exact))
        out[j, :m] = table.find(exact[:m] << np.uint64(8) | np.arange(1, m + 1, dtype=np.uint64)[:, None])
        longer = range(EXACT + 1, min(j + 1, most) + 1)
        if longer:
            out[j, EXACT : longer[-1]] = table.find(np.stack([_hashed(before[j + 1] - before[j + 1 - k] * power[k], k) for k in longer]))
    return out


def _forward(rows: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Logs of the forward sums at every position, (length + 1, words, languages)."""
    length, most, n = rows.shape
    scale = np.zeros((length + 1, n, chance.shape[1]))
    for j in range(1, length + 1):
        total = np.zeros_like(scale[0])
        for k in range(1, min(j, most) + 1):
            row = rows[j - 1, k - 1]
            use = np.flatnonzero(row)
            if len(use):
                total[use] += chance[row[use]] * np.exp(np.minimum(scale[j - k, use] - scale[j - 1, use], 700))
        scale[j] = scale[j - 1] + np.log(total)
    return scale


def _of_long(word: np.ndarray, table: Table) -> np.ndarray:
    """Natural logs of a long word's likelihood, a language each.

    Its pieces are looked up for all places of a window at once, one piece length after another, and of the forward sums
    only those that a piece can reach back to are kept, so time grows as the word does and memory doesn't.
    """
    most = table.longest
    sums = np.zeros((most + WINDOW, table.chance.shape[1]))  # the last `most` ones of the windows before come first
    for low in range(0, len(word), WINDOW):
        from_ = max(0, low - most + 1)
        byte = word[from_ : low + WINDOW].astype(np.uint64)
        skip, n = low - from_, min(WINDOW, len(word) - low)
        exact, total = np.zeros(len(byte), np.uint64), np.zeros(len(byte), np.uint64)
        found = np.zeros((most, n), np.int32)
        for k in range(1, most + 1):  # pieces of k bytes, by the byte that they end with
            exact[1:], total[1:] = exact[:-1].copy(), total[:-1].copy()
            exact[0] = total[0] = 0
            exact, total = exact << np.uint64(8) | byte, total * _BASE + byte + np.uint64(1)
            keys = (exact << np.uint64(8) | np.uint64(k)) if k <= EXACT else _hashed(total, k)
            first = max(skip, k - 1 - from_)  # a piece doesn't begin before the word
            if first < len(byte):
                found[k - 1, first - skip :] = table.find(keys[first:])
        place, size = np.nonzero(found.T)
        chance = table.chance[found.T[place, size]]
        edge = np.searchsorted(place, np.arange(n + 1)).tolist()
        for j in range(n):
            at, own = most + j, slice(edge[j], edge[j + 1])
            before = sums[at - 1]
            sums[at] = before + np.log((chance[own] * np.exp(np.minimum(sums[at - 1 - size[own]] - before, 700))).sum(0))
        sums[:most] = sums[n : n + most].copy()
    return sums[most - 1]


def log_likelihoods(words: list[np.ndarray], table: Table) -> list[np.ndarray]:
    """For each byte matrix of words of one length: (words, languages) natural logs."""
    out = []
    for w in words:
        if w.shape[1] > LONG:
            out.append(np.stack([_of_long(word, table) for word in w]))
            continue
        rows = _cut(w, table)
        blocks = range(0, len(table.names), BLOCK)
        out.append(np.concatenate([_forward(rows, table.chance[:, b : b + BLOCK])[-1] for b in blocks], 1))
    return out


def _by_length(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(indices, byte matrix) of the words of each length; few words at a time if they are long."""
    sizes = end - start
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(part):
            size = sizes[part[0]]
            for few in np.split(part, range(step := max(1, (1 << 18) // size), len(part), step)):
                yield few, data[start[few][:, None] + np.arange(size)]


def _stretches(word: bytes) -> list[bytes]:
    """A word to learn from, cut into STRETCH bytes or a little more, at the beginning of a character."""
    out, low = [], 0
    while len(word) - low > LONG:
        high = low + STRETCH
        while word[high] & 0xC0 == 0x80:
            high += 1
        out.append(word[low:high])
        low = high
    return [*out, word[low:]]


def _sample(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """lang, word and n of the sampled documents."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("_long", F.octet_length("text") > sample_bytes)
    order = Window.partitionBy("lang").orderBy("_long", F.xxhash64("doc_id"), "doc_id")
    ids = known.select("lang", "doc_id", "_long").withColumn("_r", F.row_number().over(order)).where(f"_r <= {sample}")
    ids = stored(ids.drop("_r").distinct())
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    text = F.when(F.col("_long"), F.substring("text", 1, sample_bytes // 4)).otherwise(F.col("text"))  # a character has 4 bytes at most
    rows = known.join(near, ["lang", "doc_id", "_long"], "left_semi").select("lang", text.alias("text"))

    def counted(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for words in kernel.chunks(pc.utf8_lower(batch.column("text")), kernel.NOT_LETTER):
                for i in range(words.n_docs):
                    own = [part for j in range(words.first[i], words.first[i + 1]) for part in _stretches(words.word(j))]
                    yield pa.RecordBatch.from_arrays([pa.array([langs[words.low + i]] * len(own), pa.string()), pa.array(own, pa.binary())], ["lang", "word"])

    return rows.mapInArrow(counted, "lang string, word binary").groupBy("lang", "word").agg(F.count("*").alias("n"))


def learn(words: pa.Table, keys: np.ndarray) -> Table | None:
    """Piece probabilities from a table of lang, word and n."""
    names = sorted(set(words.column("lang").to_pylist()))
    if not names:
        return None
    chance = np.zeros((1 + len(keys), len(names)))
    table = Table.of(keys, chance, names)
    for k, name in enumerate(names):
        own = words.filter(pc.equal(words.column("lang"), name))
        texts = own.column("word").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: texts[i])
        count = own.column("n").to_numpy()[order].astype(float)
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        end = np.cumsum([len(texts[i]) for i in order])
        start = end - np.array([len(texts[i]) for i in order])
        groups = [(matrix, count[few]) for few, matrix in _by_length(data, start, end)]
        size = len(chance)
        seen = np.zeros(size)
        for matrix, n in groups:  # to begin with, every piece that occurs anywhere
            rows = _cut(matrix, table)  # cut anew each time: all cuts together would be many times the words
            seen += np.bincount(rows.ravel(), np.broadcast_to(n, rows.shape).ravel(), size)
        for _ in range(ROUNDS + 1):
            seen[0] = 0
            own_chance = (seen + SMOOTH) / (seen[1:].sum() + SMOOTH * (size - 1))
            own_chance[0] = 0
            seen = np.zeros(size)
            for matrix, n in groups:
                seen += _expected(_cut(matrix, table), n, own_chance, size)
        chance[:, k] = own_chance
    return table


def _expected(rows: np.ndarray, n: np.ndarray, chance: np.ndarray, size: int) -> np.ndarray:
    """How often each piece is used, summed over all segmentations of the words."""
    length, most, _ = rows.shape
    log_a = _forward(rows, chance[:, None])[:, :, 0]
    flipped = np.zeros_like(rows)
    for j in range(length):  # the piece of l bytes that starts before byte j, seen from the end
        for k in range(1, min(length - j, most) + 1):
            flipped[length - 1 - j, k - 1] = rows[j + k - 1, k - 1]
    log_b = _forward(flipped, chance[:, None])[:, :, 0][::-1]
    seen = np.zeros(size)
    for j in range(length):
        for k in range(1, min(j + 1, most) + 1):
            row = rows[j, k - 1]
            weight = n * chance[row] * np.exp(log_a[j + 1 - k] + log_b[j + 1] - log_a[-1])
            seen += np.bincount(row, weight, size)
    return seen


def identify(docs: DataFrame, table: Table | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    if table is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # of a fixed number of pieces, for each language

    def rows(batches):
        t = shared.value
        cache, chunk = (size * BLOCK // max(BLOCK, len(t.names)) for size in (CACHE, CHUNK))
        known, value = np.zeros(0, np.uint64), np.zeros((0, len(t.names)))
        for batch in batches:
            lower = pc.utf8_lower(batch.column("text"))
            for words in kernel.chunks(lower, kernel.NOT_LETTER, chunk):
                keys, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
                at = np.searchsorted(known, keys)
                old = (known[np.minimum(at, len(known) - 1)] == keys) if len(known) else np.zeros(len(keys), bool)
                logs = np.empty((len(keys), len(t.names)))
                logs[old] = value[at[old]]
                new = np.flatnonzero(~old)
                for few, matrix in _by_length(words.data, words.start[first[new]], words.end[first[new]]):
                    logs[new[few]] = log_likelihoods([matrix], t)[0]
                if len(known) + len(new) > cache:
                    known, value, new = known[:0], value[:0], np.arange(min(len(keys), cache))
                order = np.argsort(joined := np.concatenate([known, keys[new]]))
                known, value = joined[order], np.concatenate([value, logs[new]])[order]
                total = np.zeros((words.n_docs, len(t.names)))
                doc = np.repeat(np.arange(words.n_docs), words.counts)
                for k in range(len(t.names)):
                    total[:, k] = np.bincount(doc, logs[back, k], words.n_docs)
                best = total.argmax(1)
                score = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
                lettered = _lettered(words, lower)
                names = [t.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                ids = batch.column("doc_id").slice(words.low, words.n_docs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(names), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, lang_pred string, score double")


def _lettered(words: kernel.Words, texts: pa.Array) -> np.ndarray:
    """Which documents have a letter; only those with words but without an ASCII letter are read by character."""
    ascii_ = np.concatenate([[0], np.cumsum(~kernel.NOT_LETTER[words.data] & (words.data < 128))])
    out = np.zeros(words.n_docs, bool)
    for i in np.flatnonzero(words.counts):
        own = slice(words.first[i], words.first[i + 1])
        low, high = words.start[own][0], words.end[own][-1]
        out[i] = ascii_[high] > ascii_[low] or any(c.isalpha() for c in texts[words.low + int(i)].as_py())
    return out


def learned(words: DataFrame, keys: np.ndarray) -> Table | None:
    """learn() from words (lang, word, n), a block of languages at a time."""
    words = stored(words)
    names = sorted(row[0] for row in words.select("lang").distinct().collect())  # the table has a column of each
    parts = []
    for low in range(0, len(names), BLOCK):
        parts.append(learn(words.where(F.col("lang").isin(names[low : low + BLOCK])).toArrow(), keys))
    if not parts:
        return None
    return replace(parts[0], chance=np.concatenate([p.chance for p in parts], 1), names=names)


def classify(docs: DataFrame, train: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Learn from train (doc_id, text, lang) and name the language of every document of docs.

    sample documents a language are learned from, of up to sample_bytes each.
    """
    return identify(docs, learned(_sample(train, sample, sample_bytes), pieces(vocabulary)))
