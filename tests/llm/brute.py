"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np


def tokens(text: str | None) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in folded + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def components(rows: list[tuple], n: int = 4, percent: int = 85) -> dict:
    """(doc_id, text) rows with distinct ids to doc_id: (set size, component)."""
    sets = {}
    for doc, text in rows:
        w = tokens(text)
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n") if tokens(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def ring(ids: list, shards: int, vnodes: int) -> dict:
    """Shard of each row, in rows' order: arcs offer their rows hop by hop, clockwise, to shards with room."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            p = int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:8], 16)
            points[p] = min(s, points.get(p, s))
    points = sorted(points.items())
    ends = [p for p, _ in points]
    arcs = defaultdict(list)
    for doc in ids:
        at = int(hashlib.md5(str(doc).encode()).hexdigest()[:8], 16)
        arcs[int(np.searchsorted(ends, at)) % len(ends)].append((at, doc))
    room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    queue = {a: sorted(x) for a, x in arcs.items()}
    seen = {a: [] for a in arcs}
    out = {}
    while any(queue.values()):
        for a in sorted(queue):
            if queue[a]:
                k = a
                while points[k][1] in seen[a]:
                    k = (k + 1) % len(points)
                shard = points[k][1]
                seen[a].append(shard)
                while queue[a] and room[shard]:
                    out[queue[a].pop(0)[1]] = shard
                    room[shard] -= 1
    return out


def deleted_lines(rows: list[tuple], least: int) -> dict:
    """(doc_id, text) rows to doc_id: numbers of the lines in runs of `least` words that stand earlier in the corpus, and end there before."""
    docs = []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        docs.append((doc, [(i, x, len(tokens(x))) for i, x in enumerate((text or "").split("\n")) if tokens(x)]))
    first, runs = {}, []
    for d, (_, lines) in enumerate(docs):
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += lines[j][2]
                if total >= least:
                    key = tuple(x for _, x, _ in lines[i : j + 1])
                    first.setdefault(key, (d, i))
                    runs.append((key, d, i, j))
    gone = defaultdict(set)
    for key, d, i, j in runs:
        if first[key][0] < d or first[key][0] == d and first[key][1] + j - i < i:
            gone[docs[d][0]] |= {docs[d][1][k][0] for k in range(i, j + 1)}
    return {doc: sorted(gone[doc]) for doc, _ in docs}


def leaks(rows: list[tuple], items: list[tuple], window: int, percent: int, least: int) -> set:
    """(doc_id, item_id) for which some window of aligned words agrees enough."""
    out = set()
    for doc, text in rows:
        w = tokens(text)
        for item, passage in items:
            p = tokens(passage)
            k = min(window, len(p))
            if len(p) < least:
                continue
            for i in range(len(p) - k + 1):
                for j in range(len(w) - k + 1):
                    if 100 * sum(a == b for a, b in zip(p[i : i + k], w[j : j + k], strict=True)) >= percent * k:
                        out.add((doc, item))
    return out


def base_scores(rows: list[tuple]) -> dict:
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    count = Counter()
    for d, text in rows:
        if not held[d]:
            count.update([*tokens(text), None])
    n, v = sum(count.values()), len(count)
    out = {}
    for d, text in rows:
        own = [*tokens(text), None]
        out[d] = (held[d], len(own), sum(count[t] > 0 for t in own), n, sum(np.log10((count[t] + 1) / (n + v + 1)) for t in own))
    return out
