"""A small causal self-attention model over subword ids, counted or trained, and run in numpy.

The next piece's class is predicted from the current piece, or the last two where
they are a frequent pair (a table row), and from attention over the pieces before it
in a context window; the piece then follows from its class by corpus counts.  So
every piece of the vocabulary has a probability, and all of them sum to one.

Start.counted() makes all parameters from counts.  learn() fits them by gradients
instead, without pairs.

Sequences are read in windows of OVERLAP + STRIDE inputs.  A window scores only its
last STRIDE targets, so each is scored once, with OVERLAP pieces of context at least
(fewer where the sequence begins).  Windows of many documents form one batch, under
a causal mask and a mask of what lies outside the document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from . import kernel

STRIDE, OVERLAP = 32, 16
SPAN = STRIDE + OVERLAP
#: Dimensions of attention and of the table's trained part; classes of pieces; pieces with a row of their own.
ATTEND, WIDE, CLASSES, ROWS = 16, 24, 256, 4096
#: Classes that hold one frequent piece each; frequent rows by which the others' surroundings are compared.
SINGLE, HEADS = 176, 128
#: Windows a step, and rounds over all drawn windows.
BATCH, ROUNDS, RATE = 64, 4, 0.01
#: A row's counts are smoothed by so many of the classes' own shares, those of a pair of rows by so many of its second row's.
SMOOTH, OWN = 30, 100
#: Pairs of rows with a table row of their own; distances at which it is counted what stands before a class.
PAIRS, FARS = 1 << 14, (4, 8, 16, 32)
#: Of counted parameters: how strongly values count, how much attention falls with the distance, and with how alike two rows' values are.
STRENGTH, FALL, ALIKE = 1.3, 0.2, 0.5
#: Windows whose attention is computed at once; targets whose classes are weighed at once, so that a core's cache holds them.
TOGETHER, TARGETS = 128, 256
#: Windows whose targets are taken in the order of their table rows, of which a cache then holds those in use.
SORTED = 8 * TOGETHER

_FAR = np.arange(STRIDE)[:, None] + OVERLAP - np.arange(SPAN)[None, :]  # of a query from a key
_CAUSAL = _FAR >= 0
_ALL = np.arange(TARGETS)
_WEIGHT = np.array([pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) for k in range(STRIDE)], np.uint64)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first target and number of targets of every window, for documents of first[i]:first[i + 1] targets."""
    size = np.diff(first)
    many = -(-size // STRIDE)
    doc = np.repeat(np.arange(len(size)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    low = first[doc] + k * STRIDE
    return doc, low, np.minimum(STRIDE, first[doc + 1] - low)


def inputs(rows: np.ndarray, first: np.ndarray, doc: np.ndarray, low: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each input of each window, and whether it lies in the document. rows: of the targets; an input is the target before."""
    at = low[:, None] - OVERLAP + np.arange(SPAN)
    begin, end = first[doc][:, None], first[doc + 1][:, None]
    valid = (at >= begin) & (at < end)
    ids = rows[np.clip(at - 1, 0, max(0, len(rows) - 1))]
    return np.where(at == begin, start, ids), valid


def packed(pieces: np.ndarray, first: np.ndarray, doc: np.ndarray, low: np.ndarray, size: np.ndarray, start: int) -> np.ndarray:
    """Each window as SPAN + 1 pieces: an input and, one further, its target. start: before a text; -1: outside the document or window."""
    at = low[:, None] - OVERLAP - 1 + np.arange(SPAN + 1)
    begin, end = first[doc][:, None], (low + size)[:, None]
    out = pieces[np.clip(at, 0, max(0, len(pieces) - 1))].astype(np.int32)
    out[at == begin - 1] = start
    out[(at < begin - 1) | (at >= end)] = -1
    return out


def drawn(pieces: np.ndarray, first: np.ndarray, rate: float, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and packed() form of the windows whose targets' hash falls under a rate, whatever document they are in."""
    doc, low, size = windows(first)
    if not len(low):
        return np.zeros(0, np.uint64), np.zeros((0, SPAN + 1), np.int32)
    value = (pieces.astype(np.uint64) + np.uint64(1)) * _WEIGHT[np.arange(len(pieces)) - np.repeat(low, size)]
    hashes = kernel.mix(np.add.reduceat(value, low))
    few = np.flatnonzero(hashes <= np.uint64(min(1.0, rate) * (2**64 - 2**11)))
    return hashes[few], packed(pieces, first, doc[few], low[few], size[few], start)


_BITS = 127 << 23


def weights(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """What classes are weighed by: exp(x) to 1 %, of float32 numbers between -170 and 170, which are overwritten.

    2 ** (y / 2) / 2 ** (-y / 2), y = x / ln 2, each power linear between whole exponents: so a number's bits, read as a
    whole number, are the power's exponent and fraction. It is positive and increasing, and takes a fifth of np.exp's
    time. room: an array like x to work in; no other is made, so that both stay in a core's cache.
    """
    room = np.empty_like(x) if room is None else room
    up, down = room.view(np.int32), x.view(np.int32)
    x *= np.float32((1 << 22) / np.log(2))
    x += np.float32(_BITS)
    np.copyto(up, x, casting="unsafe")
    np.subtract(np.int32(2 * _BITS), up, out=down)
    return np.divide(room, x, out=x)


@dataclass
class Model:
    row: np.ndarray  # piece -> table row; the last piece is the end of a text
    group: np.ndarray  # piece -> class
    inside: np.ndarray  # piece -> natural log of its share of its class
    start: int  # the row of a text's beginning
    table: np.ndarray  # (rows, classes)
    query: np.ndarray  # (rows, ATTEND)
    key: np.ndarray
    value: np.ndarray
    far: np.ndarray  # bias by distance
    out: np.ndarray  # (ATTEND, classes)
    pairs: np.ndarray | None = None  # sorted codes of pairs of rows, whose table rows come after those of single rows

    @cached_property
    def places(self) -> np.ndarray:
        return places_of(self.pairs, len(self.query))

    @property
    def moderate(self) -> bool:
        """Whether no score can overflow, or vanish for all keys, in float32."""
        length = lambda a: float(np.sqrt((a.astype(np.float64) ** 2).sum(1).max()))
        return length(self.query) * length(self.key) + float(np.abs(self.far).max()) < 60

    def log_probabilities(self, pieces: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each target piece, given those before it in its document."""
        rows, groups = self.row[pieces], self.group[pieces]
        out = self.inside[pieces].astype(np.float64)
        now = before(rows, first, self.start)
        own = now if self.pairs is None else paired(self.places, len(self.query), before(now, first, -1), now)
        doc, low, size = windows(first)
        moderate = self.moderate
        bias = np.where(_CAUSAL, self.far[np.abs(_FAR)], -1e9).astype(np.float32)
        value = np.concatenate([self.value, np.ones((len(self.value), 1), self.value.dtype)], 1)  # the last column adds up the weights
        every = np.ones(self.table.shape[1], np.float32)
        size_ = (TARGETS, self.table.shape[1])
        room = np.empty(size_, np.float32), np.empty(size_, np.float32)
        sums = np.empty((min(SORTED, len(doc)), STRIDE, ATTEND + 1), np.float32)
        for begin in range(0, len(doc), SORTED):
            end = min(begin + SORTED, len(doc))
            for i in range(begin, end, TOGETHER):
                few = slice(i, min(i + TOGETHER, end))
                ids, valid = inputs(rows, first, doc[few], low[few], self.start)
                ids[~valid] = self.start
                # a copy: small products of transposed views take longer
                score = np.matmul(np.take(self.query, ids[:, OVERLAP:], 0), np.ascontiguousarray(np.take(self.key, ids, 0).transpose(0, 2, 1)))
                score += bias
                edge = np.flatnonzero(~valid.all(1))  # windows at a document's ends
                score[edge] += np.where(valid[edge], np.float32(0), np.float32(-1e9))[:, None, :]
                if not moderate:
                    score -= score.max(2, keepdims=True)
                np.exp(score, out=score)
                np.matmul(score, np.take(value, ids, 0), out=sums[few.start - begin : few.stop - begin])
            use = np.flatnonzero((np.arange(STRIDE) < size[begin:end, None]).ravel())
            at = (low[begin:end, None] + np.arange(STRIDE)).ravel()[use]
            order = np.argsort(own[at].astype(np.uint16), kind="stable")  # ROWS and PAIRS together are fewer than 2 ** 16
            at, mixed = at[order], np.take(sums[: end - begin].reshape(-1, ATTEND + 1), use[order], 0)
            mixed, row, group = mixed[:, :-1] / mixed[:, -1:], own[at], groups[at]
            found = np.empty(len(at), np.float32)
            for i in range(0, len(at), TARGETS):
                part = slice(i, i + TARGETS)
                n = len(row[part])
                logits = np.matmul(mixed[part], self.out, out=room[0][:n])
                # rows are all inside the table; in any other mode take() copies through a buffer
                logits += np.take(self.table, row[part], 0, out=room[1][:n], mode="clip")
                # logits are of moderate size: the table's rows are normalised
                weight = weights(logits, room[1][:n])
                np.divide(weight[_ALL[:n], group[part]], weight @ every, out=found[part])
            out[at] += np.log(found)
        return out


@dataclass
class Shape:
    """Which row and class a piece has. The last piece is the end of a text; one more, `start`, stands before it."""

    row: np.ndarray
    group: np.ndarray
    n_rows: int
    n_classes: int

    @property
    def start(self) -> int:
        return len(self.row)

    def pairs(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """row * n_classes + class of each piece and the one before it."""
        return np.append(self.row, self.n_rows - 1)[before] * self.n_classes + self.group[pieces]


def before(pieces: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The piece before each one, `start` before a document's first."""
    out = np.empty_like(pieces)
    out[1:] = pieces[:-1]
    out[first[:-1][np.diff(first) > 0]] = start
    return out


def places_of(pairs: np.ndarray, n_rows: int) -> np.ndarray:
    """For each two rows, left * n_rows + right, the place of the pair in pairs, or -1. Its size is that of ROWS squared at most."""
    out = np.full(n_rows * n_rows, -1, np.int16)
    out[pairs] = np.arange(len(pairs))
    return out


def paired(places: np.ndarray, n_rows: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The table row of each two rows in turn: the pair's own, or else that of the right one.

    left is -1 where nothing stands, before a text's beginning; there places has its last element, of a pair that never is.
    """
    k = places[left * n_rows + right]
    return np.where(k >= 0, k + n_rows, right)


def contexts(shape: Shape, places: np.ndarray, pieces: np.ndarray, first: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
    """Count documents into near (pairs, classes) and far (rows, classes), both flat, of which counted() makes a model. places: places_of() the pairs."""
    rows, group = shape.row[pieces], shape.group[pieces]
    now = before(rows, first, shape.n_rows - 1)
    own = paired(places, shape.n_rows, before(now, first, -1), now) - shape.n_rows
    np.add.at(near, (own * shape.n_classes + group)[own >= 0], 1)
    place = np.arange(len(pieces)) - np.repeat(first[:-1], np.diff(first))
    rows *= shape.n_classes
    for d in FARS:
        np.add.at(far, (rows[: -1 - d] + group[1 + d :])[place[1 + d :] > d], 1)


def ranked(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Row of each piece by its count in the corpus, and the number of rows; pieces beyond ROWS share the last one."""
    top = np.argsort(-counts, kind="stable")[:ROWS]
    row = np.full(len(counts), len(top))
    row[top] = np.arange(len(top))
    return row, len(top) + 1


def views(row: np.ndarray, n_rows: int, before: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in a table of (2, n_rows, HEADS + 1) a pair of pieces counts: what stands before a row, and what after it."""
    left = np.append(row, n_rows - 1)[before]
    right = row[pieces]
    head = lambda r: np.minimum(r, HEADS)
    return right * (HEADS + 1) + head(left), (n_rows + left) * (HEADS + 1) + head(right)


def shaped(row: np.ndarray, n_rows: int, counts: np.ndarray, around: np.ndarray) -> Shape:
    """Classes of rows that are used alike: frequent rows alone, the others by what stands around them (k-means).

    counts: of pieces; around: the counts at the places that views() gives. Both are of all training documents.
    """
    total = np.bincount(row, counts, n_rows)
    order = np.argsort(-total, kind="stable")
    own = np.zeros(n_rows, np.int64)
    single, rest = order[:SINGLE], order[SINGLE:]
    own[single] = np.arange(len(single))
    if len(rest):
        around = around.reshape(2, n_rows, HEADS + 1)
        view = np.concatenate([around[0], around[1]], 1)[rest].astype(np.float64)
        view = np.sqrt(view / np.maximum(view.sum(1, keepdims=True), 1))
        k = min(CLASSES - SINGLE, len(rest))
        centre = view[:: max(1, len(rest) // (4 * k))][:k].copy()
        k = len(centre)
        for _ in range(8):
            near = ((centre**2).sum(1) - 2 * view @ centre.T).argmin(1)
            weight = total[rest] + 1e-3
            sums = np.bincount(near, weight, k)
            for c in range(k):
                if sums[c]:
                    centre[c] = weight[near == c] @ view[near == c] / sums[c]
        own[rest] = SINGLE + near
    group = own[row]
    return Shape(row.astype(np.int64), group, n_rows + 1, int(group.max()) + 1)


@dataclass
class Start:
    """What all trainers share: the shape, log probabilities of classes by counted pairs, and shares inside classes."""

    shape: Shape
    table: np.ndarray
    inside: np.ndarray

    @classmethod
    def of(cls, shape: Shape, counts: np.ndarray, pairs: np.ndarray) -> Start:
        smooth = counts + 0.5
        inside = np.log(smooth / np.bincount(shape.group, smooth, shape.n_classes)[shape.group])
        pair = pairs.reshape(shape.n_rows, shape.n_classes)
        base = pair.sum(0) + 0.5
        base /= base.sum()
        table = np.log((pair + SMOOTH * base) / (pair.sum(1, keepdims=True) + SMOOTH)).astype(np.float32)
        return cls(shape, table, inside)

    def parameters(self, seed: int = 4) -> dict[str, np.ndarray]:
        rng, f = np.random.default_rng(seed), np.float32
        return {
            "e": rng.normal(0, 0.3, (self.shape.n_rows, WIDE)).astype(f),
            "q": rng.normal(0, 0.2, (WIDE, ATTEND)).astype(f),
            "k": rng.normal(0, 0.2, (WIDE, ATTEND)).astype(f),
            "v": rng.normal(0, 0.2, (WIDE, ATTEND)).astype(f),
            "far": np.linspace(0, -1, SPAN).astype(f),
            "o": rng.normal(0, 0.1, (ATTEND, self.shape.n_classes)).astype(f),
            "u": np.zeros((WIDE, self.shape.n_classes), f),
        }

    def counted(self, pairs: np.ndarray, near: np.ndarray, far: np.ndarray) -> Model:
        """A model all of whose parameters are counted: near and far are those of contexts() over all training documents.

        A pair of rows has the classes that followed it.  A row's value is how much more often classes came some way after it
        than the class before led to expect, as far as ATTEND dimensions hold it.  Attention turns to rows unlike the current one,
        which the table speaks for; the current one itself is looked at only where nothing else is.
        """
        shape, f = self.shape, np.float32
        near = near.reshape(len(pairs), shape.n_classes)
        prior = np.exp(self.table[pairs % shape.n_rows].astype(np.float64))
        two = np.log((near + OWN * prior) / (near.sum(1, keepdims=True) + OWN))
        far = far.reshape(shape.n_rows, shape.n_classes).astype(np.float64)
        base = far.sum(0) + 0.5
        base /= base.sum()
        weight = far.sum(1)
        own = np.zeros(shape.n_rows, np.int64)
        own[shape.row] = shape.group
        step = np.zeros((shape.n_classes, shape.n_classes))
        np.add.at(step, own, (weight + 1e-3)[:, None] * np.exp(self.table.astype(np.float64)))
        step /= np.maximum(step.sum(1, keepdims=True), 1e-9)
        lift = np.log((far + base) / (far @ step + base))
        lift -= (lift @ base)[:, None]
        size, share = np.sqrt(weight + 1)[:, None], np.sqrt(base)
        left, scale, right = np.linalg.svd(lift * size * share, full_matrices=False)
        dims = min(ATTEND, len(scale))
        value, out = np.zeros((shape.n_rows, ATTEND), f), np.zeros((ATTEND, shape.n_classes), f)
        value[:, :dims] = STRENGTH * left[:, :dims] * scale[:dims] / size
        out[:dims] = right[:dims] / share
        like = value / np.maximum(np.sqrt((value**2).sum(1, keepdims=True)), f(1e-6))
        away = -FALL * np.log(1 + np.arange(SPAN))
        away[0] = -30
        table = np.concatenate([self.table, two.astype(f)])
        return Model(shape.row, shape.group, self.inside, shape.n_rows - 1, table, f(-ALIKE) * like, like, value, away.astype(f), out, pairs)

    def model(self, p: dict[str, np.ndarray]) -> Model:
        table = self.table + p["e"] @ p["u"]
        table -= np.log(np.exp(table).sum(1, keepdims=True))
        query = (p["e"] @ p["q"]) * np.float32(ATTEND**-0.5)
        return Model(self.shape.row, self.shape.group, self.inside, self.shape.n_rows - 1, table, query, p["e"] @ p["k"], p["e"] @ p["v"], p["far"], p["o"])


def learn(begin: Start, p: dict[str, np.ndarray], windows: np.ndarray, done: int, rounds: int, seed: int = 4) -> dict[str, np.ndarray]:
    """Parameters after one pass over packed() windows, in an order by chance. done: rounds before this one."""
    shape, f = begin.shape, np.float32
    p = {name: x.copy() for name, x in p.items()}
    moments = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in p.items()}
    row = np.append(shape.row, [shape.n_rows - 1, shape.n_rows - 1])  # of `start`, and of -1
    group = np.append(shape.group, [0, 0])
    order = np.random.default_rng(seed + done).permutation(len(windows))
    scale = f(ATTEND**-0.5)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    steps = -(-len(windows) // BATCH)
    for step in range(1, steps + 1):
        few = windows[order[(step - 1) * BATCH : step * BATCH]]
        ids, valid = row[few[:, :-1]], few[:, :-1] >= 0
        target, use = group[few[:, OVERLAP + 1 :]], few[:, OVERLAP + 1 :] >= 0
        valid[:, OVERLAP:] |= ~use  # a query beyond the end has at least itself to look at
        x = p["e"][ids]
        now = x[:, OVERLAP:]
        q, k, v = now @ p["q"], x @ p["k"], x @ p["v"]
        s = np.matmul(q, k.transpose(0, 2, 1)) * scale + p["far"][np.abs(_FAR)]
        s = np.where(_CAUSAL & valid[:, None, :], s, f(-1e9))
        s = np.exp(s - s.max(2, keepdims=True))
        s /= s.sum(2, keepdims=True)
        z = np.matmul(s, v)
        logits = begin.table[ids[:, OVERLAP:]] + now @ p["u"] + z @ p["o"]
        logits = np.exp(logits - logits.max(2, keepdims=True))
        logits /= logits.sum(2, keepdims=True)
        d = logits  # the gradient of the mean loss
        d[np.arange(len(few))[:, None], np.arange(STRIDE), target] -= 1
        d *= (use / use.sum()).astype(f)[:, :, None]
        g = {"u": flat(now).T @ flat(d), "o": flat(z).T @ flat(d)}
        dz = d @ p["o"].T
        dv = np.matmul(s.transpose(0, 2, 1), dz)
        ds = np.matmul(dz, v.transpose(0, 2, 1))
        ds = s * (ds - (ds * s).sum(2, keepdims=True))
        g["far"] = np.bincount(np.abs(_FAR).ravel(), ds.sum(0).ravel(), SPAN).astype(f)
        dq, dk = np.matmul(ds, k) * scale, np.matmul(ds.transpose(0, 2, 1), q) * scale
        g["q"], g["k"], g["v"] = flat(now).T @ flat(dq), flat(x).T @ flat(dk), flat(x).T @ flat(dv)
        dx = dk @ p["k"].T + dv @ p["v"].T
        dx[:, OVERLAP:] += dq @ p["q"].T + d @ p["u"].T
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], ids.ravel(), flat(dx))
        rate = RATE * min(1, 2 * (1 - (done + (step - 1) / steps) / rounds))
        for name, grad in g.items():
            m, w = moments[name]
            m += f(0.1) * (grad - m)
            w += f(0.01) * (grad * grad - w)
            p[name] -= f(rate) * (m / f(1 - 0.9**step)) / (np.sqrt(w / f(1 - 0.99**step)) + f(1e-8))
    return p


def to_bytes(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[name].tobytes() for name in sorted(p))


def from_bytes(like: dict[str, np.ndarray], data: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name in sorted(like):
        size = like[name].nbytes
        out[name] = np.frombuffer(data[at : at + size], np.float32).reshape(like[name].shape).copy()
        at += size
    return out
