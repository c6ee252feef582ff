import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import jaccard_join

from . import brute
from .helpers import ODD, docs_of, prose


def _found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def _corpus(seed=1):
    rng = random.Random(seed)
    rows, shared = [], prose(rng, 60)
    for d in range(60):
        kind = d % 4
        if kind == 0 or not rows:
            words = prose(rng, rng.randrange(1, 200))
        elif kind == 1:
            words = (rng.choice(rows)[1] or "").split()
        else:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(1, 5)):
                if words:
                    words[rng.randrange(len(words))] = "edit" + str(rng.randrange(99))
        if kind == 3:
            words = shared + words
        rows.append((d * 3 + 1, " ".join(words)))
    return rows


def test_equals_all_pairs(spark):
    rows = _corpus() + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, t) for i, t in enumerate(ODD)]
    assert _found(jaccard_join.components(docs_of(spark, rows, {"n": 1, "token": "x"}))) == brute.components(rows)


def test_blocks_and_group_sizes_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = []
    for d in range(150):  # one group whose pairs lie on both sides of the threshold
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    want = brute.components(rows)
    assert _found(jaccard_join.components(docs_of(spark, rows))) == want
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", 20)
    assert _found(jaccard_join.components(docs_of(spark, rows))) == want


def test_null_ids_repeated_rows_and_shared_ids(spark):
    rng = random.Random(7)
    a, b = " ".join(prose(rng, 50)), " ".join(prose(rng, 50))
    rows = [(None, a), (5, a), (5, a), (3, a), (9, a), (9, b), (11, b)]
    out = [(r.doc_id, r.component_id) for r in jaccard_join.components(docs_of(spark, rows)).collect()]
    assert sorted(out, key=str) == sorted([(None, None), (5, 3), (5, 3), (3, 3), (9, 3), (9, 3), (11, 3)], key=str)
    docs = docs_of(spark, [*rows, (3, a), (3, a + " more"), (70, None), (70, None)], {"_own": 1})
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(3, a), (70, None)]
    assert sum(r.doc_id is None for r in kept) == 1


def test_empty_table(spark):
    docs = docs_of(spark, [(1, "x")]).limit(0)
    assert jaccard_join.components(docs).count() == 0
    assert jaccard_join.keep_one(docs).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=40), min_size=2, max_size=12), st.booleans())
def test_forest_has_all_links(sets, two_sides):
    counts = np.arange(1 << jaccard_join.SKETCH_BITS) * 7919 % 13
    arrays = [np.sort(np.array([x * 0x9E3779B97F4A7C15 % 2**64 for x in s], np.uint64)) for s in sets]
    side = np.array([two_sides and i % 2 == 1 for i in range(len(sets))])

    def groups(pairs):
        top = list(range(len(sets)))
        for a, b in pairs:
            x, y = top[a], top[b]
            top = [x if t == y else t for t in top]
        return [top.index(t) for t in top]

    both = side.any() and not side.all()
    all_links = [(a, b) for a in range(len(sets)) for b in range(a) if (not both or side[a] != side[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert groups(jaccard_join.forest(arrays, side, 85, counts)) == groups(all_links)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 300), (300, 500)], "u long, v long")
    got = {r.u: r.v for r in jaccard_join.components_of(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 300}
