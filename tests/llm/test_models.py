"""Decontamination, language identification, toxicity and language-model scoring."""

import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import attention, decontaminate, kernel, language, lm, subwords, toxicity

from . import brute
from .helpers import ODD, docs_of, prose


# -- the kernel


def test_words_and_grams_equal_plain_versions():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [t for t in ODD] + [" ".join(prose(rng, rng.randrange(0, 30))) for _ in range(50)] + ["Á B\x0bc\x1cd\tE"]
    for size in (1, 100, 1 << 20):
        seen = {}
        for words in kernel.chunks(pa.array(texts), size=size):
            h = words.hashes()
            grams, first = kernel.grams(words, h, 4, True)
            for i in range(words.n_docs):
                want = brute.tokens(texts[words.low + i])
                assert [words.word(j).decode() for j in range(words.first[i], words.first[i + 1])] == want
                windows = [tuple(want[k : k + 4]) for k in range(len(want) - 3)] if len(want) > 3 else ([tuple(want)] if want else [])
                own = grams[first[i] : first[i + 1]].tolist()
                assert len(own) == len(windows)
                for w, g in zip(windows, own, strict=True):
                    assert seen.setdefault(w, g) == g
        assert len(set(seen.values())) == len(seen)


# -- decontamination


def _bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_equals_plain_version(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng, n, 1500))) for i, n in enumerate([40, 25, 20, 15, 9, 7, 5, 3, 60])] + [(50, None), (51, "")]
    rows = []
    for d in range(80):
        words = prose(rng, rng.randrange(0, 80), 1500)
        if d % 2:
            part = items[d % 9][1].split()
            if d % 4 == 1:
                for k in range(3, len(part), 9):
                    part[k] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part if d % 6 else part[: len(part) // 2]
        rows.append((d, " ".join(words)))
    rows += [(400 + i, t) for i, t in enumerate(ODD) if len(t or "") < 1000]
    docs, want = docs_of(spark, rows, {"item_id": 5, "tokens": 1}), {}
    for least in (decontaminate.MIN_WORDS, 1):
        got = decontaminate.overlaps(docs, _bench(spark, items), least).collect()
        want[least] = brute.leaks(rows, [i for i in items if i[1]], decontaminate.WINDOW, decontaminate.PERCENT, least)
        assert {(r.doc_id, r.item_id) for r in got} == want[least] and len(got) == len(want[least])
    assert len(want[1]) > len(want[decontaminate.MIN_WORDS]) > 20
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", 1)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, _bench(spark, items)).collect()} == want[decontaminate.MIN_WORDS]


def test_decontamination_of_long_texts(spark):
    rng = random.Random(5)
    item, other = prose(rng, 30, 10**5), prose(rng, 60_000)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20, " ".join(other)), (21, " ".join(other[:55_555] + item[3:] + other[55_555:]))]
    got = decontaminate.overlaps(docs_of(spark, rows), _bench(spark, [(1, " ".join(item))])).collect()
    assert [(r.doc_id, r.n_agree, r.word_at) for r in got] == [(21, 20, 55_555)]


def test_no_allowed_change_escapes_the_masks():
    for n in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        changed = n - math.ceil(n * decontaminate.PERCENT / 100)
        places = [sum(1 << p + j for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(n - len(m) + 1)]
        for which in itertools.combinations(range(n), changed):
            bits = sum(1 << i for i in which)
            assert not all(bits & p for p in places)
    for n in range(decontaminate.MIN_WORDS, decontaminate.SPAN):
        assert n - math.ceil(n * decontaminate.PERCENT / 100) == 1


def test_every_exact_or_lightly_edited_passage_is_found(spark):
    rng = random.Random(6)
    item = prose(rng, 20, 1500)
    rows = [(0, " ".join(item))]
    for d, gone in enumerate(itertools.islice(itertools.combinations(range(20), 2), 0, 190, 3), 1):
        rows.append((d, " ".join("other" if k in gone else w for k, w in enumerate(item))))
    got = decontaminate.overlaps(docs_of(spark, rows), _bench(spark, [(1, " ".join(item))])).collect()
    assert {r.doc_id for r in got} == {d for d, _ in rows}


def test_passages_cut_by_a_documents_edge_are_found(spark):
    rng = random.Random(8)
    item, other = [f"i{k}" for k in range(40)], prose(rng, 50)
    docs = [item[10:29], other + item[:19], item[-19:] + other, item[3:19], other + item[:16], item[:9] + ["x"] + item[10:17]]
    few = [item[3:18], other + item[:15], item[:8] + ["x", "y"] + item[10:17]]  # 15 words of 20
    rows = [(d, " ".join(w)) for d, w in enumerate(docs + few)]
    got = {r.doc_id: (r.n_agree, r.n_window) for r in decontaminate.overlaps(docs_of(spark, rows), _bench(spark, [(1, " ".join(item))])).collect()}
    assert got == {0: (19, 20), 1: (19, 20), 2: (19, 20), 3: (16, 20), 4: (16, 20), 5: (16, 20)}
    short = [(0, " ".join(item[:8])), (1, " ".join(item[:7])), (2, " ".join(other + item[:8]))]
    got = decontaminate.overlaps(docs_of(spark, short), _bench(spark, [(1, " ".join(item[:9]))])).collect()
    assert {r.doc_id for r in got} == {0, 2}


def test_decontamination_odd_rows(spark):
    text = " ".join(prose(random.Random(2), 30))
    rows = [(None, text), (3, text), (3, text), (3, "short"), (4, None)]
    docs, bench = docs_of(spark, rows), _bench(spark, [(None, text), (7, text), (7, text), (8, text)])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()) == [(3, 7), (3, 8)]
    assert sorted(decontaminate.clean(docs, bench).select("doc_id").toPandas().doc_id.dropna()) == [4]
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == 5


# -- language identification


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"aba", b"bab", b"c"]
    keys = np.array(sorted(int.from_bytes(p, "big") << 8 | len(p) for p in pieces), np.uint64)
    chance = np.random.default_rng(0).random((1 + len(keys), 2))
    chance[0] = 0
    table = language.Table.of(keys, chance, ["x", "y"])
    value = {p: chance[1 + list(keys).index(int.from_bytes(p, "big") << 8 | len(p))] for p in pieces}

    def total(word):
        if not word:
            return np.ones(2)
        return sum((value[word[:k]] * total(word[k:]) for k in range(1, min(3, len(word)) + 1) if word[:k] in value), np.zeros(2))

    for word in (b"a", b"ab", b"ababab", b"cabbabaabc"):
        got = language.log_likelihoods([np.frombuffer(word, np.uint8)[None, :]], table)[0][0]
        assert got == pytest.approx(np.log(total(word)))


def _languages(n=40, seed=3):
    rng = random.Random(seed)
    parts = {"en": ["th", "er", "on", "and", "re", "ing"], "de": ["sch", "ei", "ung", "keit", "ver", "ü"], "fr": ["eau", "oi", "é", "tion", "aux", "ai"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(rng.randrange(3, 60))), lang, "s") for i, lang in enumerate(rng.choices(list(parts), k=n * 3))]


def test_long_words_are_scored_as_short_ones_are(monkeypatch):
    rng = random.Random(2)
    value = {language.key(bytes([b])): rng.random() for b in range(256)}
    value |= {language.key(w): rng.random() for w in (b"ab", b"aba", b"babab", b"abababababab", "中文".encode(), "文中文中文中文".encode())}
    keys = np.array(sorted(value), np.uint64)
    table = language.Table.of(keys, np.array([[0, 0], *([value[k], value[k] / 3] for k in keys.tolist())]), ["x", "y"])
    for text in ("ab" * 40, "中文" * 30, "aba" * 33 + "x", "a"):
        word = np.frombuffer(text.encode(), np.uint8)
        want = language.log_likelihoods([word[None, :]], table)[0][0]
        for window in (1 << 13, 7, 40):
            monkeypatch.setattr(language, "WINDOW", window)
            assert language._of_long(word, table) == pytest.approx(want)


def test_time_of_an_unspaced_text_grows_as_it_does(spark):
    train = docs_of(spark, [*_languages(), *[(900 + k, "中文字" * 4000, "zh", "s") for k in range(3)]])
    table = language.learned(language._sample(train), language.pieces())
    began = time.time()
    word = np.frombuffer(("中文字" * 12_000).encode(), np.uint8)
    logs = language._of_long(word, table)
    assert table.names[logs.argmax()] == "zh" and time.time() - began < 30
    assert all(len(p) <= language.LONG for p in language._stretches(("é" * 9000).encode())) and b"".join(language._stretches(("aé" * 9000).encode())) == ("aé" * 9000).encode()


def test_language_on_unseen_documents(spark):
    rows = _languages()
    docs = docs_of(spark, rows)
    out = {r.doc_id: r for r in language.classify(docs.drop("lang"), docs.where("doc_id % 2 = 0")).collect()}
    unseen = [r for r in rows if r[0] % 2]
    assert sum(out[r[0]].lang_pred == r[2] for r in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_cache_changes_nothing(spark, monkeypatch):
    docs = docs_of(spark, _languages())
    want = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.classify(docs, docs).collect())
    table = language.learn(language._sample(docs).toArrow(), language.pieces())
    monkeypatch.setattr(language, "CACHE", 10)
    monkeypatch.setattr(language, "CHUNK", 200)
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.identify(docs, table).collect()) == want


def test_language_odd_rows(spark):
    odd = [None, "", " \n", "123 !!", "٣٤٥ …", "中文", "ß", "x" * 50_000, "the and " * 9000]
    rows = [(i, t, None, "s") for i, t in enumerate(odd)] + [(None, "thering onand", None, "s")] * 2
    train = docs_of(spark, _languages())
    out = language.classify(docs_of(spark, rows, {"lang_pred": "z"}), train).collect()
    found = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == len(rows)
    assert [found[i] for i in range(5)] == ["und"] * 5 and "und" not in [found[i] for i in (5, 6, 7, 8)]
    assert {r.lang_pred for r in language.classify(docs_of(spark, rows), train.limit(0)).collect()} == {"und"}
    assert language.classify(train.limit(0), train).count() == 0


def test_no_language_is_dropped(spark):
    """More languages than a block, and one that has long texts only."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    lang = lambda k: f"l{k:02d}"
    word = lambda k: letters[k % 26] + letters[k // 26] + "q"
    rows = [(k * 4 + i, " ".join([word(k)] * (200 if k == 69 else 9 + i)), lang(k), "s") for k in range(70) for i in range(4 if k < 60 else 2)]
    docs = docs_of(spark, rows)
    out = {r.doc_id: r.lang_pred for r in language.classify(docs, docs, sample_bytes=400).collect()}
    assert out == {r[0]: r[2] for r in rows}


def test_long_pieces_take_part():
    words = [b"internationalization", "международный".encode(), b"interna", b"internat"]
    value = {language.key(bytes([b])): 1e-9 for b in range(256)} | {language.key(w): 0.25 for w in words}
    keys = np.array(sorted(value), np.uint64)
    table = language.Table.of(keys, np.array([0, *(value[k] for k in keys.tolist())])[:, None], ["x"])
    for w, n in [*((w, 1) for w in words), (words[3] + words[1], 2)]:
        assert language.log_likelihoods([np.frombuffer(w, np.uint8)[None, :]], table)[0][0, 0] == pytest.approx(n * np.log(0.25), abs=1e-4)
    every = set(language.pieces().tolist())
    assert language.key(b"international") in every and len(every) > 38_000


# -- toxicity


def _toxic_rows(n=400, seed=5):
    """Toxic only where an insult meets a group's name: no additive weights can tell."""
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        words = prose(rng, rng.randrange(5, 60))
        insult, group = d % 2 == 0, d // 2 % 2 == 0
        words += (["Insult,"] if insult else ["praise"]) + (["GROUP"] if group else ["chair"])
        rng.shuffle(words)
        rows.append((d, " ".join(words)))
        labels.append((d, int(insult and group or not insult and not group)))
    return rows, labels


def test_machine_learns_a_pair(spark):
    rows, labels = _toxic_rows()
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, label int")
    out = {r.doc_id: r.score for r in toxicity.classify(docs_of(spark, rows), known).collect()}
    unseen = [x for x in labels if x[0] % 5 == 0]
    assert sum((out[d] >= 0.5) == bool(y) for d, y in unseen) >= 0.9 * len(unseen)


def test_samples_are_what_the_caller_asks_for(spark):
    rows, labels = _toxic_rows(60)
    known = spark.createDataFrame(labels, "doc_id long, label int")
    docs = docs_of(spark, rows)
    of = lambda *a: sorted((r.label for r in toxicity.sample(docs, known, *a).collect()))
    assert of(5) == [0] * 5 + [1] * 5 == of(5, 10) and len(of()) == len(labels) == len(of(600_000))
    langs = docs_of(spark, [(k, "zzz" * (k + 1), "l", "s") for k in range(9)])
    words = language._sample(langs, 4).collect()
    assert sum(r.n for r in words) == 4 and {len(r.word) for r in language._sample(langs, 9, 12).collect()} == {3, 6, 9, 12}


def test_machine_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.3, np.zeros(1), rng.random(6), rng.random((6, 3)))
    got = m.margins(np.array([0, 0, 0, 1]), np.array([1, 2, 5, 4]), 3)
    pairs = sum(m.factor[a] @ m.factor[b] for a, b in ((1, 2), (1, 5), (2, 5)))
    assert got == pytest.approx([0.3 + m.weight[[1, 2, 5]].sum() + pairs, 0.3 + m.weight[4], 0.3])


def test_long_labelled_texts_are_learned_from(spark):
    rng = random.Random(4)
    rows = [(k, ("insult " if k % 2 else "praise ") + " ".join(prose(rng, 12_000))) for k in range(24)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, label int")
    assert min(len(t.encode()) for _, t in rows) > toxicity.SAMPLE_BYTES
    out = {r.doc_id: r.score for r in toxicity.classify(docs_of(spark, rows), labels).collect()}
    assert len(set(out.values())) > 1 and sum((out[k] >= 0.5) == bool(k % 2) for k in out) >= 20


def test_toxicity_odd_rows(spark):
    rows, labels = _toxic_rows(60)
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(None, "Insult GROUP")] * 2
    known = spark.createDataFrame([*labels, (None, 1), (900, None), (901, 7)], "doc_id long, label int")
    out = toxicity.classify(docs_of(spark, rows, {"label": 1, "score": 2}), known).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (900, 901, 902)}) == 1
    assert {r.score for r in toxicity.classify(docs_of(spark, rows), known.limit(0)).collect()} == {0.0}
    assert toxicity.classify(docs_of(spark, rows).limit(0), known).count() == 0


# -- language-model scoring


def test_base_score_and_counts_equal_plain_version(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(d, " ".join(prose(rng, rng.randrange(0, 60)))) for d in range(80)] + [(400 + i, t) for i, t in enumerate(ODD)]
    want = brute.base_scores(rows)
    monkeypatch.setattr(attention, "ROUNDS", 1)
    for head in (lm.HEAD, 20):
        monkeypatch.setattr(lm, "HEAD", head)
        out = {r.doc_id: r for r in lm.scores(docs_of(spark, rows, {"row": 1, "score": "x"})).collect()}
        for d, (held, n, known, total, base) in want.items():
            r = out[d]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert math.isfinite(r.score) and r.score < 0


def _model(seed=0, n_pieces=300, n_docs=40):
    rng = np.random.default_rng(seed)
    docs = [np.append(rng.integers(0, n_pieces - 1, rng.integers(0, 150)) ** 2 % (n_pieces - 1), n_pieces - 1) for _ in range(n_docs)]
    pieces, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    return pieces, first, n_pieces


def _begun(pieces, first, n_pieces):
    """The shape and table that the corpus's pairs give, and all its windows."""
    counts = np.bincount(pieces, minlength=n_pieces)
    row, n_rows = attention.ranked(counts)
    before = attention.before(pieces, first, n_pieces)
    around = np.zeros(2 * n_rows * (attention.HEADS + 1))
    for at in attention.views(row, n_rows, before, pieces):
        np.add.at(around, at, 1)
    shape = attention.shaped(row, n_rows, counts, around)
    pairs = np.bincount(shape.pairs(before, pieces), minlength=shape.n_rows * shape.n_classes)
    return attention.Start.of(shape, counts, pairs), attention.drawn(pieces, first, 1.0, n_pieces)[1]


def _trained(pieces, first, n_pieces, rounds=4):
    begin, windows = _begun(pieces, first, n_pieces)
    p = begin.parameters()
    for done in range(rounds):
        p = attention.learn(begin, p, windows, done, rounds)
    return begin.model(p)


def _plain_log_probability(model, pieces, k):
    """Of target k of one document, by loops over its window."""
    low = k // attention.STRIDE * attention.STRIDE
    ids = [model.start if j == 0 else model.row[pieces[j - 1]] for j in range(max(0, low - attention.OVERLAP), k + 1)]
    score = [model.query[ids[-1]] @ model.key[x] + model.far[len(ids) - 1 - j] for j, x in enumerate(ids)]
    weight = np.exp(np.array(score) - max(score))
    mixed = sum(w * model.value[x] for w, x in zip(weight / weight.sum(), ids, strict=True))
    logits = model.table[ids[-1]] + mixed @ model.out
    power = lambda y: 2 ** np.floor(y) * (1 + y - np.floor(y))
    half = logits / math.log(4)
    weight = power(half) / power(-half)
    return np.log(weight[model.group[pieces[k]]] / weight.sum()) + model.inside[pieces[k]]


def test_class_weights_are_close_to_exp():
    x = np.linspace(-60, 60, 100_001).astype(np.float32)
    got = attention.weights(x.copy())
    assert np.abs(got / np.exp(x.astype(np.float64)) - 1).max() < 0.0125 and (np.diff(got) >= 0).all()


def test_scores_equal_a_plain_forward_pass():
    pieces, first, n_pieces = _model(3, n_docs=6)
    model = _trained(pieces, first, n_pieces)
    got = model.log_probabilities(pieces, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        want = [_plain_log_probability(model, pieces[a:b], k) for k in range(b - a)]
        assert got[a:b] == pytest.approx(want, abs=2e-4)


def test_targets_are_weighed_in_the_order_of_their_rows(monkeypatch):
    """Table rows are taken in order within SORTED windows, and scores don't depend on how many those are."""
    pieces, first, n_pieces = _model(3, n_docs=6)
    model, seen, take = _trained(pieces, first, n_pieces), [], np.take
    monkeypatch.setattr(attention.np, "take", lambda a, ids, *more, **named: (seen.append(ids) if a is model.table else None, take(a, ids, *more, **named))[1])
    got = model.log_probabilities(pieces, first)
    assert len(seen) > 1 and (np.diff(np.concatenate(seen)) >= 0).all()
    monkeypatch.setattr(attention, "SORTED", 3)
    monkeypatch.setattr(attention, "TOGETHER", 2)
    assert model.log_probabilities(pieces, first) == pytest.approx(got, abs=1e-4)


def test_gradient_is_that_of_the_loss(monkeypatch):
    """One step of learn() changes parameters by the gradient's sign where that is the same in a numeric derivative."""
    pieces, first, n_pieces = _model(5, n_docs=3)
    begin, windows = _begun(pieces, first, n_pieces)
    p = begin.parameters()
    p["u"] += np.random.default_rng(1).normal(0, 0.1, p["u"].shape).astype(np.float32)
    monkeypatch.setattr(attention, "BATCH", len(windows))
    after = attention.learn(begin, p, windows, 0, 1)
    monkeypatch.setattr(attention, "weights", lambda x, room=None: np.exp(x))
    loss = lambda q: -begin.model(q).log_probabilities(pieces, first).mean()
    rng = np.random.default_rng(0)
    for name in p:
        flat = np.abs(after[name] - p[name]).ravel()
        for at in rng.choice(np.flatnonzero(flat > 0), min(6, (flat > 0).sum()), replace=False):
            low, high = ({n: x.astype(np.float64) for n, x in p.items()} for _ in range(2))
            low[name].flat[at] -= 1e-3
            high[name].flat[at] += 1e-3
            slope = (loss(high) - loss(low)) / 2e-3
            if abs(slope) > 2e-5:
                assert np.sign(after[name].flat[at] - p[name].flat[at]) == -np.sign(slope), name


def test_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(attention, "ROWS", 100)
    pieces, first, n_pieces = _model()
    model = _trained(pieces, first, n_pieces)
    head = pieces[:37]
    total = sum(np.exp(model.log_probabilities(np.append(head, p), np.array([0, 38]))[-1]) for p in range(n_pieces))
    assert total == pytest.approx(1, abs=1e-4)


def test_windows_score_each_target_once_and_causally():
    pieces, first, n_pieces = _model(1)
    model = _trained(pieces, first, n_pieces)
    doc, low, size = attention.windows(first)
    seen = np.concatenate([np.arange(a, a + n) for a, n in zip(low, size, strict=True)])
    assert sorted(seen) == list(range(len(pieces)))
    whole = model.log_probabilities(pieces, first)
    for i in (0, 3, 7):  # a document alone, or with another end, has the same scores up to there
        own = pieces[first[i] : first[i + 1]]
        assert model.log_probabilities(own, np.array([0, len(own)])) == pytest.approx(whole[first[i] : first[i + 1]], abs=1e-4)
        cut = own[: len(own) // 2]
        assert model.log_probabilities(cut, np.array([0, len(cut)])) == pytest.approx(whole[first[i] : first[i] + len(cut)], abs=1e-4)


def test_training_reduces_the_loss():
    pieces, first, n_pieces = _model(2)
    few, many = (_trained(pieces, first, n_pieces, n).log_probabilities(pieces, first).mean() for n in (0, 12))
    assert many > few


def test_what_is_learned_from_grows_with_the_corpus(spark, monkeypatch):
    """Windows come from documents of any length, at a rate; several trainers, and averages in two steps, change no class."""
    import pyarrow as pa

    rng = random.Random(3)
    docs = docs_of(spark, [(d, " ".join(prose(rng, 30_000 if d < 3 else 40))) for d in range(300)]).select("text")
    context = spark.sparkContext
    table = subwords.ranks()
    mergeable = context.broadcast(table)
    found = {r: lm._gathered(docs, mergeable, r).cache() for r in (1.0, 0.25)}
    n = {r: x.where("kind = 2").count() for r, x in found.items()}
    assert 0.2 < n[0.25] / n[1.0] < 0.3
    counts = lm._shape(found[1.0], max(table.values()) + 2)[1]
    encoder, total = subwords.Encoder(table), np.zeros(max(table.values()) + 2, np.int64)
    for words in kernel.chunks(pa.array([r.text for r in docs.collect()])):
        total += np.bincount(lm._targets(encoder, words)[0], minlength=len(total))
    assert (counts == total).all()
    begin = lm._shape(found[0.25], len(total))[0]
    monkeypatch.setattr(lm, "PART", n[0.25] // 5)
    monkeypatch.setattr(lm, "MERGE", 2)
    monkeypatch.setattr(attention, "ROUNDS", 1)
    model = lm._trained(found[0.25], begin)
    assert np.abs(model.out - begin.parameters()["o"]).max() > 0.01 and np.isfinite(model.table).all()


def test_subword_ids_give_words_back():
    import pyarrow as pa

    encoder = subwords.Encoder(subwords.ranks())
    texts = [t for t in ODD if t] + ["Über naïve  x " + "y" * 500]
    for words in kernel.chunks(pa.array(texts)):
        slots, _ = encoder.slots(words)
        ids, first = encoder.pieces(slots)
        for j in range(min(len(slots), 3000)):
            assert encoder.own.decode(ids[first[j] : first[j + 1]].tolist()).encode() == b" " + words.word(j)
    long = ("international" * 9).encode()  # a word's ids are the vocabulary's, however long it is
    assert encoder.encode(long) == encoder.own.encode_ordinary(" " + long.decode())


def test_new_words_are_encoded_in_bulk_as_one_by_one(monkeypatch):
    import pyarrow as pa

    encoder = subwords.Encoder(subwords.ranks())
    texts = [t for t in ODD if t] + ["Über naïve  x\u00a0y 'tis 12345 \u2028 日本語 e\u0301 🙂🙂 " + "z" * 300, "a\0b \0"]
    plain = [[encoder.encode(w.word(j)) for j in range(len(w.start))] for w in kernel.chunks(pa.array(texts))]
    monkeypatch.setattr(kernel.Words, "word", None)  # no word is cut out alone
    for words, want in zip(kernel.chunks(pa.array(texts)), plain, strict=True):
        ids, first = encoder.pieces(encoder.slots(words)[0])
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


def test_a_word_is_sought_once_among_the_frequent_ones(monkeypatch):
    hashes, sought = np.array([9, 2**63 + 5, 4, 7], np.uint64), []
    head, slots = np.sort(hashes[:3].view(np.int64)), np.array([0, 3, 0, 1, 1, 3, 0], np.int32)
    search = np.searchsorted
    monkeypatch.setattr(lm.np, "searchsorted", lambda a, v: (sought.append(len(v)), search(a, v))[1])
    found = lm._places(hashes, slots, head)
    assert sought == [3] and [int(head[k]) if k >= 0 else None for k in found] == [9, None, 9, 5 - 2**63, 5 - 2**63, None, 9]
    assert (lm._places(hashes, slots, head[:0]) == -1).all() and len(lm._places(hashes[:0], slots[:0], head)) == 0


def test_model_beats_the_base_on_unseen_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    out = [r for r in lm.scores(docs).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in out)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_empty_table_and_no_training_documents(spark):
    docs = docs_of(spark, [(2, "a b"), (None, "c")])
    assert lm.scores(docs.limit(0)).count() == 0
    held = [d for d in range(50) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    out = lm.scores(docs_of(spark, [(held[0], "a b"), (held[1], None)])).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in out} == {(3, 0, 0), (1, 0, 0)}


def test_counted_parameters_come_from_all_documents(spark):
    """Pairs and counts over several tasks equal plain loops over every training document, and any one document changes them."""
    rng = random.Random(11)
    rows = [(d, " ".join(prose(rng, 2000 if d < 2 else rng.randrange(60)))) for d in range(120)]
    docs, table = docs_of(spark, rows).select("text"), subwords.ranks()
    mergeable, encoder = spark.sparkContext.broadcast(table), subwords.Encoder(table)
    gathered = lm._gathered(docs, mergeable, 0.0).cache()
    assert gathered.where("kind = 2").count() == 0
    begin = lm._shape(gathered, max(table.values()) + 2)[0]
    shape, start = begin.shape, begin.shape.n_rows - 1
    plain = [[*(i for w in t.lower().split() for i in encoder.encode(w.encode())), encoder.size] for _, t in rows]
    stood = [[start, *(int(shape.row[i]) for i in own)] for own in plain]
    seen = Counter(a * shape.n_rows + b for own in stood for a, b in zip(own[:-2], own[1:-1], strict=True))
    pairs = lm._pairs(gathered, shape)
    assert set(seen) <= set(pairs.tolist()) and len(pairs) <= attention.PAIRS
    near, far = Counter(), Counter()
    for own, row in zip(plain, stood, strict=True):
        for k, piece in enumerate(own):
            c = int(shape.group[piece])
            if k:
                near[row[k - 1] * shape.n_rows + row[k], c] += 1
            for d in attention.FARS:
                if k > d:
                    far[row[k - d], c] += 1
    want = begin.counted(
        pairs,
        np.array([near[int(p), c] for p in pairs for c in range(shape.n_classes)]),
        np.array([far[r, c] for r in range(shape.n_rows) for c in range(shape.n_classes)]),
    )
    got = lm._counted(docs.repartition(5), mergeable, gathered, begin)
    assert (got.table == want.table).all() and (got.value == want.value).all() and (got.out == want.out).all()
    short = min((t for _, t in rows if len(t.split()) > 9), key=len)
    less = lm._counted(docs.where(docs.text != short), mergeable, gathered, begin)
    assert (less.table != got.table).any()


def test_counted_scores_equal_a_plain_forward_pass():
    pieces, first, n_pieces = _model(6, n_docs=8)
    begin, _ = _begun(pieces, first, n_pieces)
    shape = begin.shape
    rows = np.split(shape.row[pieces], first[1:-1])
    codes = np.unique(np.concatenate([r[:-2] * shape.n_rows + r[1:-1] for r in rows if len(r) > 2]))[::2]
    near, far = np.zeros(len(codes) * shape.n_classes, np.int64), np.zeros(shape.n_rows * shape.n_classes, np.int64)
    attention.contexts(shape, attention.places_of(codes, shape.n_rows), pieces, first, near, far)
    model = begin.counted(codes, near, far)
    assert near.sum() and far.sum() and model.moderate
    got, single = model.log_probabilities(pieces, first), model.table[: shape.n_rows].copy()
    for a, b, own in zip(first[:-1], first[1:], rows, strict=True):
        own = [shape.n_rows - 1, *own]
        for k in range(b - a):
            at = np.flatnonzero(codes == own[k - 1] * shape.n_rows + own[k]) if k else []
            model.table[own[k]] = model.table[shape.n_rows + at[0]] if len(at) else single[own[k]]
            assert got[a + k] == pytest.approx(_plain_log_probability(model, pieces[a:b], k), abs=2e-4)
            model.table[own[k]] = single[own[k]]
