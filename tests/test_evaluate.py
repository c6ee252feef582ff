"""Evaluation against plain versions."""

import random
import re

import pytest

from veilspark.operators import evaluate as E
from veilspark.operators import review as V

WORDS = ["Directeur", "Chef", "Paul", "de", "Dubois", "Siège", "Le", "France", "Corp", "Nous", "avec", "Banque", "Me", "M.", "Région", "x", "Directeur,", "Paul,", "Anne", "Mais", "horizon"]


def _gold(seed=4, n=400):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 8))), rng.choice(["PERSON", "ORG", "LOCATION"]), 0, 9) for k in range(n)]


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame(_gold(), "doc_id long, entity_text string, entity_type string, start_pos int, end_pos int")


def _has(text, words):
    return any(w in text for w in words)


def _starts(text, words):
    return text.startswith(tuple(words))


def _reasons(text, kind):
    words, out = text.split(), []
    if kind == "PERSON":
        if "," in text and text.split(",")[0].strip()[:1].isupper():
            return []
        named = any(w[0].isupper() and w not in E.JOB_TITLES for w in words[1:])
        checks = [("job_title", _has(text, E.JOB_TITLES) and not named), ("site", _has(text, E.SITE_WORDS)), ("fragment", _starts(text, E.FRAGMENT_STARTS)), ("organisation", _has(text, ("Corp", "France")))]
        out = [name for name, wrong in checks if wrong]
    if kind == "ORG":
        out = [name for name, wrong in (("too_long", len(words) > 5), ("sentence", _starts(text, E.SENTENCE_STARTS))) if wrong]
    return out


def test_suspicious(gold):
    want = {k: _reasons(t, kind) for k, t, kind, _, _ in _gold()}
    got = {r.doc_id: list(r.reasons) for r in E.suspicious(gold).collect()}
    assert got == {k: r for k, r in want.items() if r} and len(got) > 50


def _wrong(text, kind):
    words = text.split()
    if kind == "PERSON":
        titled = re.match(r"^(?:Dr\.|Pr\.|M\.|Mme|Me|Professeur|Docteur)\s+[A-ZÀ-Ö]", text)
        proper = [w for w in words if w[0].isupper() and w not in E.COMPANY_WORDS and len(w) > 2]
        company = _has(text, E.COMPANY_WORDS) and not titled and len(proper) < 2
        title = "," in text and text.split(",")[0].strip() in E.STANDALONE_TITLES
        return title or _has(text, E.PLACE_WORDS) or _starts(text, (*E.FRAGMENT_STARTS, "En ")) or company or _has(text, E.FRAGMENTS) or len(text) < 3
    if kind == "ORG":
        return len(words) > 6 or _starts(text, (*E.SENTENCE_STARTS, "Ensuite", "Avec ")) or _has(text.lower(), E.VERBS)
    return False


def test_false_positives(gold):
    want = {k for k, t, kind, _, _ in _gold() if not _wrong(t, kind)}
    got = {r.doc_id for r in E.without_false_positives(gold).collect()}
    assert got == want and 50 < len(got) < 350


def test_matches_are_one_to_one(spark):
    rng = random.Random(1)
    p = [(rng.randrange(5), rng.choice(["A", "a ", "B"]), rng.choice(["PERSON", "ORG"]), k, k + 1) for k in range(60)]
    g = [(rng.randrange(5), rng.choice(["a", "B", "C"]), rng.choice(["PERSON", "ORG"]), k, k + 1) for k in range(40)]
    predicted = spark.createDataFrame(p, "doc_id long, text string, entity_type string, start_pos int, end_pos int")
    gold_ = spark.createDataFrame(g, "doc_id long, entity_text string, entity_type string, start_pos int, end_pos int")
    pairs = E.nearest_matches(predicted, gold_).collect()
    assert len({(r.doc_id, r.start_pos) for r in pairs}) == len({(r.doc_id, r.gold_start) for r in pairs}) == len(pairs)
    total = E.text_matches(predicted, gold_).where("entity_type IS NULL").first()
    assert total.tp == len(pairs) and total.tp + total.fp == 60 and total.tp + total.fn == 40


def test_nearest_matches_equal_plain_version(spark):
    rng = random.Random(6)
    places = rng.sample(range(500), 200)
    p = [(rng.randrange(6), rng.choice(["A  b", "a\nb ", "C"]), "PERSON", k, k + 1, rng.choice(["ner", "regex"]), rng.choice([0.6, 0.8, 0.95])) for k in places[:120]]
    g = [(rng.randrange(6), rng.choice(["a b", "c"]), "PERSON", k, k + 1) for k in places[120:]]
    p += [(9, "x", "PERSON", 5, 6, "ner", 0.6), (9, "x", "PERSON", 100, 101, "regex", 0.95)]
    g += [(9, "X", "PERSON", 100, 101)]
    norm, free, want = lambda t: " ".join(t.lower().split()), sorted(p, key=lambda x: x[3]), set()
    for own in sorted(g, key=lambda x: x[3]):
        fit = [x for x in free if x[0] == own[0] and norm(x[1]) == norm(own[1])]
        if fit:
            best = min(fit, key=lambda x: abs(x[3] - own[3]))
            free.remove(best)
            want.add((best[0], best[3], own[3]))
    predicted = spark.createDataFrame(p, "doc_id long, text string, entity_type string, start_pos int, end_pos int, source string, confidence double")
    gold_ = spark.createDataFrame(g, "doc_id long, entity_text string, entity_type string, start_pos int, end_pos int")
    assert {(r.doc_id, r.start_pos, r.gold_start) for r in E.nearest_matches(predicted, gold_).collect()} == want
    assert {(r.source, r.tp, r.fp) for r in E.source_scores(predicted, gold_).collect()} == {
        (k, sum(x[5] == k and x not in free for x in p), sum(x[5] == k for x in free)) for k in ("ner", "regex")
    }
    assert sum(r.tp for r in E.bucket_precision(predicted, gold_).collect()) == E.text_matches(predicted, gold_).where("entity_type IS NULL").first().tp == len(want)


def test_scores_without_entities(spark):
    none = spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int")
    row = E.with_scores(none).first()
    assert (row.precision, row.recall, row.f1) == (0, 0, 0)


def test_percentiles_by_index(spark):
    rng = random.Random(2)
    rows = [(k, rng.random()) for k in range(4) for _ in range(rng.randrange(1, 60))]
    got = {r.k: (r.p50, r.p95, r.p99) for r in E.index_percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    for k in range(4):
        v = sorted(x for g, x in rows if g == k)
        assert got[k] == (v[len(v) // 2], v[min(int(len(v) * 0.95), len(v) - 1)], v[min(int(len(v) * 0.99), len(v) - 1)])


def test_decisions(spark):
    spans = spark.createDataFrame([(1, "a", "X", "PERSON", 0, 1), (1, "b", "Y", "PERSON", 2, 3), (1, "c", "Z", "PERSON", 4, 5)], "doc_id long, span_id string, text string, entity_type string, start_pos int, end_pos int")
    schema = "doc_id long, span_id string, seq int, action string, new_text string, new_pseudonym string, entity_type string, start_pos int, end_pos int"
    made = [(1, "a", 1, "MODIFY", "X1", None), (1, "a", 2, "MODIFY", "X2", None), (1, "b", 1, "CONFIRM", None, None), (1, "b", 2, "REJECT", None, None), (1, "n", 1, "ADD", "W", None)]
    decisions = spark.createDataFrame([(*m, "ORG" if m[3] == "ADD" else None, 7, 8) for m in made], schema)
    out = {r.span_id: (r.text, r.added) for r in V.validated(spans, decisions).collect()}
    assert out == {"a": ("X2", False), "n": ("W", True)}
    states = {r.state: r.n for r in V.summary(spans, decisions).collect()}
    assert states == {"MODIFY": 1, "REJECT": 1, "PENDING": 1, "ADD": 1}


def test_decisions_are_not_sent_to_all_tasks(spark):
    from veilspark.operators import review

    spans = spark.createDataFrame([(1, "a", "Jean", "PERSON", 0, 4)], "doc_id long, span_id string, text string, entity_type string, start_pos int, end_pos int")
    decisions = spark.createDataFrame([(1, "a", 1, "MODIFY", "Luc", None, None, None, None)], "doc_id long, span_id string, seq int, action string, new_text string, new_pseudonym string, entity_type string, start_pos int, end_pos int")
    found = review.validated(spans, decisions)
    assert [r.text for r in found.collect()] == ["Luc"]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
