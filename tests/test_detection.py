"""Patterns against Python's re, the merge, grouping and rewriting against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions import text as T
from veilspark.operators import grouping as G
from veilspark.operators import rewrite as R
from veilspark.operators import spans as S

PARTS = ["M.", "Mme", "Dr.", "Maître", "Me", " ", "  ", "\n", " ", "Dubois", "Éric", "Jean-Pierre", ",", ", ", "à", "en", "près de", "Paris", "Aix-en-Provence",
         "Société", "Cabinet", "SARL", "SA", "Groupe", "Horizon", "&", "\U0001f600", "é", "d'", "l'Oise", ".", "et", "de", "le", "La Rochelle", "x", "-"]


def _texts(n=250, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 30))) for _ in range(n)] + [None, "", "a" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")


def test_native_and_arrow_spans_equal_re(spark, docs):
    rules = [*P.PATTERNS, P.FULL_NAME, P.GEOGRAPHY]
    want = {(d, m.start(), m.end(), m.group(0), r.name) for d, t in enumerate(_texts()) if t for r in rules for m in re.finditer(r.regex, t)}
    for engine in ("native", "arrow"):
        got = S.regex_spans(docs, rules, engine=engine).collect()
        assert {(r.doc_id, r.start_pos, r.end_pos, r.text, r.pattern) for r in got} == want
        assert len(got) == len(want)


def test_titles_equal_re(spark, docs):
    def plain(text):
        while True:
            bare = re.sub(P.TITLE, "", text, flags=re.IGNORECASE).strip()
            if bare == text:
                return bare
            text = bare

    got = docs.where("text IS NOT NULL").select("text", T.strip_titles("text").alias("t"), T.strip_prepositions("text").alias("p")).collect()
    for r in got:
        assert r.t == plain(r.text)
        assert r.p == re.sub(P.PREPOSITION, "", r.text, flags=re.IGNORECASE).strip()


def test_yaml_patterns(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("patterns:\n  a: {enabled: true, confidence: 0.5, entity_type: ORG, patterns: [{pattern: 'X+'}, {pattern: '('}]}\n  b: {enabled: false, entity_type: ORG, patterns: ['Y']}\n")
    with pytest.warns(UserWarning):
        found = P.load_patterns(str(path))
    assert [(p.name, p.regex) for p in found] == [("a", "X+")]


def test_merge_without_a_model_keeps_all(spark, docs):
    alone = S.dedup_spans(S.regex_spans(docs))
    merged = S.detected(docs)
    kept = S.without_labels(S.without_bare_titles(alone))
    assert merged.count() == kept.count()
    assert merged.where("is_ambiguous OR source <> 'regex'").count() == 0


def test_detector_plug_in(spark, docs):
    found = S.detector_spans(docs, lambda: lambda text: [(0, 1, text[:1], "per", 0.5), (0, 1, text[:1], "MISC", 0.5)])
    assert {r.entity_type for r in found.collect()} == {"PERSON"}


def _union_find(names):
    """Variant classes of person names by pairs, with the guard for last names of several bearers."""
    forms = {n: n.split() for n in names}
    bearers = {}
    for w in forms.values():
        if len(w) > 1:
            bearers.setdefault(w[-1].lower(), set()).add(w[0].lower())
    top = {n: n for n in names}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a in names:
        for b in names:
            x, y = forms[a], forms[b]
            if not x or not y:
                continue
            same = False
            if len(x) > 1 and len(y) > 1:
                same = (x[0].lower(), x[-1].lower()) == (y[0].lower(), y[-1].lower())
            elif len(x) == 1 and len(y) == 1:
                same = x[0].lower() == y[0].lower() and len(bearers.get(x[0].lower(), ())) < 2
            else:
                one, two = (x, y) if len(x) == 1 else (y, x)
                same = one[0].lower() == two[-1].lower() and len(bearers[one[0].lower()]) == 1
            if same:
                top[find(a)] = find(b)
    return {frozenset(m for m in names if find(m) == find(n)) for n in names}


def test_person_groups_equal_union_find(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(60):
        names = sorted({" ".join(rng.choice(["Ana", "ana", "Bea", "Cal", "Dan"]) for _ in range(rng.randrange(1, 4))) for _ in range(6)})
        want[doc] = _union_find(names)
        rows += [(doc, n, "PERSON", k * 20, k * 20 + len(n)) for k, n in enumerate(names)]
    spans = spark.createDataFrame(rows, "doc_id long, text string, entity_type string, start_pos int, end_pos int")
    got = {}
    for r in G.groups(spans).collect():
        got.setdefault(r.doc_id, set()).add(frozenset(r.variants))
    assert got == want


def _rewrite(text, spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if all(s[0] >= k[1] or k[0] >= s[1] for k in kept):
            kept.append(s)
    for a, b, r in sorted(kept, reverse=True):
        text = text[:a] + r + text[b:]
    return text, len(kept)


@pytest.mark.parametrize("partitions", [1, 7])
def test_rewrite_equals_plain_version(spark, partitions):
    rng = random.Random(9)
    docs, rows, want = [], [], {}
    for d in range(80):
        text = "".join(rng.choice("abc é\U0001f600\n") for _ in range(rng.randrange(0, 60)))
        spans = {(a, a + rng.randrange(1, 6)) for a in (rng.randrange(0, max(1, len(text) - 6)) for _ in range(rng.randrange(0, 6)))} if len(text) > 8 else set()
        docs.append((d, text))
        made = [(a, b, f"<{a}-{b}>") for a, b in spans]
        rows += [(d, *s) for s in made]
        want[d] = _rewrite(text, made)
    out = R.rewritten(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions),
        spark.createDataFrame(rows, "doc_id long, start_pos int, end_pos int, replacement string").repartition(partitions),
    )
    assert {r.doc_id: (r.text, r.n_replaced) for r in out.collect()} == want


def test_pruned_annotations_equal_plain_version(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for d in range(50):
        spans = sorted({(a := rng.randrange(30), a + rng.randrange(1, 9), rng.choice(["PERSON", "ORG"])) for _ in range(7)})
        rows += [(d, a, b, k, f"{a}{k}") for a, b, k in spans]
        kept = []
        for s in sorted(spans, key=lambda s: (s[0], s[1] - s[0], s[1], s[2])):
            hit = next((k for k in kept if s[0] < k[1] and k[0] < s[1]), None)
            if hit is None:
                kept.append(s)
            elif s[1] - s[0] < hit[1] - hit[0] and s[2] == hit[2]:
                kept.remove(hit)
                kept.append(s)
        want[d] = sorted(kept)
    found = R.pruned_annotations(spark.createDataFrame(rows, "doc_id long, start_pos int, end_pos int, entity_type string, entity_text string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos, r.entity_type))
    assert {d: sorted(x) for d, x in got.items()} == want


def test_column_letters(spark):
    got = spark.range(1, 20000, 7).select("id", T.column_letter("id").alias("x")).collect()
    from veilspark.sources.files import letters

    assert all(r.x == letters(r.id) for r in got)


def test_column_letters_of_large_numbers(spark):
    from veilspark.sources.files import letters

    edges = [sum(26**k for k in range(n)) + more for n in range(2, 15) for more in (-1, 0, 1)] + [702, 703, 18_278, 18_279, 900_000, 2**53 + 1, 2**63 - 1]
    got = spark.createDataFrame([(i,) for i in edges], "id long").select("id", T.column_letter("id").alias("x")).collect()
    assert [r.x for r in got] == [letters(i) for i in edges] and letters(475_255) == "AAAAA"


def test_empty_inputs(spark, docs):
    none = docs.limit(0)
    assert S.detected(none).count() == 0
    assert R.rewritten(none, spark.createDataFrame([], "doc_id long, start_pos int, end_pos int, replacement string")).count() == 0
    assert docs.select(F.size(S.matches("text", "zzz")).alias("n")).where("n > 0").count() == 0


def test_dictionaries_take_part_in_detection(spark):
    text = "Marie  Dubois et M. Luc Martin sont à Lille; Paris attend Zoé Inconnue."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for engine in ("native", "arrow"):
        got = {(r.text, r.entity_type, r.confidence, text[r.start_pos : r.end_pos]) for r in S.all_detected(docs, engine=engine).collect()}
        want = {("Marie Dubois", "PERSON", 0.65, "Marie  Dubois"), ("Luc Martin", "PERSON", 0.65, "Luc Martin"), ("M. Luc Martin", "PERSON", 0.85, "M. Luc Martin")}
        want |= {("à Lille", "LOCATION", 0.65, "à Lille"), ("Lille", "LOCATION", 0.6, "Lille"), ("Paris", "LOCATION", 0.6, "Paris")}
        assert got == want
    at = text.index("Paris")
    tokens = spark.createDataFrame([(1, at, at + 5, "NOUN", "PER")], "doc_id long, start_pos int, end_pos int, pos string, ent_type string")
    assert "Paris" not in {r.text for r in S.all_detected(docs, tokens=tokens).collect()}
    names = spark.createDataFrame([("first", "Zoé"), ("last", "Inconnue")], "kind string, value string")
    assert {"Zoé Inconnue", "Paris"} <= {r.text for r in S.all_detected(docs, names=names).collect()}


def test_no_known_full_name_or_place_stays_in_clear(spark, sf):
    from veilspark.functions import lookup
    from veilspark.plans import queries

    texts = "\n".join(r.text for r in queries.queries()["r2_all_patterns_rewritten"](spark, sf).collect())
    first = [n for kind in lookup.GENDERS.values() for n in kind]
    places = [v for kind in lookup.PLACES.values() for v in kind]
    # after a hyphen it is the rest of a name that the title pattern cuts ("M. Jean-Pierre Martin"), which isn't the dictionaries' matter
    full = rf"(?<!-)\b({'|'.join(first)})\s+({'|'.join(lookup.LAST_NAMES)})\b"
    assert re.findall(full, texts) == []
    assert re.findall(rf"\b(?:{'|'.join(places)})\b", texts) == []


def test_many_terms_equal_a_brute_force_and_passes_change_nothing(spark):
    import random

    rng = random.Random(6)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    terms = sorted({w for w in words} | {f"{a} {b}" for a, b in zip(words, words[1:])})
    texts = [(k, "".join(rng.choice([*words, " ", "aaaa", "\U0001f600"]) for _ in range(rng.randrange(0, 80)))) for k in range(60)] + [(None, "ab"), (61, None), (62, "")]
    want = []
    for d, t in texts:
        for term in terms:
            at = (t or "").find(term)
            while at >= 0:
                want.append((d, term, "X", at, at + len(term)))
                at = t.find(term, at + len(term))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame([(t, "X") for t in [*terms, terms[0], ""]], "term string, entity_type string")
    for at_once in (S.TERMS_AT_ONCE, 17):
        assert sorted(map(tuple, S.term_spans(docs, table, at_once=at_once).collect()), key=repr) == sorted(want, key=repr)
    assert S.term_spans(docs, table.limit(0)).count() == 0


def test_time_of_a_long_document_grows_as_it_does(spark):
    """100,000 spans in a text of over 5 MB are found, and replaced, in well under a minute."""
    import time

    from veilspark.operators import rewrite as R

    n = 50_000
    text = " ".join(f"Voir M. Luc Dubois{'abcdefghij'[k % 10]} puis Mme Anne Petit et encore {'x' * 50}" for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = S.all_detected(docs)
    rewritten = R.rewritten(docs, found.where("entity_type = 'PERSON' AND text LIKE 'M%'").withColumn("replacement", F.lit("X"))).first()
    assert len(text) > 5_000_000 and rewritten.n_replaced == 2 * n and time.time() - began < 120
    assert rewritten.text == " ".join(f"Voir X puis X et encore {'x' * 50}" for _ in range(n))
    native = S.regex_spans(docs, [P.PATTERNS[0]])
    assert native.exceptAll(S.regex_spans(docs, [P.PATTERNS[0]], engine="arrow")).count() == 0 and native.count() == 2 * n
    assert R.without_overlaps(native, ["doc_id"]).count() == 2 * n


def test_suffix_organisations_are_those_of_the_pattern():
    import random
    import re

    rule = next(p for p in P.PATTERNS if p.ending)
    rng = random.Random(4)
    words = ["Alpha", "Delta Conseil", "SA", "SARL", "SAS", " ", "\n", ".", ",", "1", ";", "é", "Été", "X", "a", "&", "SAx", "-SA", "SA-", "'", "B SA"]
    for _ in range(5000):
        text = "".join(rng.choice(words) + rng.choice([" ", "", ". "]) for _ in range(rng.randrange(1, 25)))
        assert [m.span() for m in S._finder(rule)(text)] == [m.span() for m in re.finditer(rule.regex, text)]


def test_spans_meet_across_stretches(spark, monkeypatch):
    import random

    rng = random.Random(3)
    span = lambda k: (1, f"T{k}", "PERSON", (a := rng.randrange(3000)), a + rng.choice([0, 1, 5, 40, 900]), 0.5)
    schema = "doc_id long, text string, entity_type string, start_pos int, end_pos int, confidence double"
    ner, regex = (spark.createDataFrame([span(k) for k in range(150)], schema) for _ in range(2))
    rows = []
    for stretch in (1 << 30, 7, 512):
        monkeypatch.setattr(S, "STRETCH", stretch)
        rows.append(sorted(map(tuple, S.merged(ner, regex).collect())))
    assert rows[0] == rows[1] == rows[2]


def test_patterns_over_whole_documents_equal_plain_matches(spark, sf):
    """The suffix pattern is held against its own expression above, on short texts, where that is fast."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = [p for p in (*P.PATTERNS, P.FULL_NAME, P.GEOGRAPHY) if p.ending is None]
    got = sorted((r.doc_id, r.start_pos, r.end_pos, r.text, r.pattern) for r in S.regex_spans(docs, rules, engine="arrow").collect())
    want = [(r.doc_id, m.start(), m.end(), m.group(0), p.name) for r in docs.collect() for p in rules for m in re.finditer(p.regex, r.text or "")]
    assert got == sorted(want) and len(got) > 100


def test_spans_of_one_pass_are_handed_on_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "SPANS", 10)
    texts = ["Voir M. Jean Dubois et Mme Petit. " * 20, None, "", "Dr. Luc Martin"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["doc_id", "text"])
    out = list(S._arrow([P.PATTERNS[0]], ["doc_id"])(iter([batch])))
    assert max(b.num_rows for b in out) == 10 and sum(b.num_rows for b in out) == 41
    assert out[-1].column("doc_id").to_pylist() == [3] and out[-1].column("text").to_pylist() == ["Dr. Luc Martin"]


def test_spans_are_not_sent_to_all_tasks_for_rewriting(spark, docs):
    spans = spark.createDataFrame([(1, 0, 1, "x")], "doc_id long, start_pos int, end_pos int, replacement string")
    found = R.rewritten(docs, spans)
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_spans_are_sorted_by_as_many_tasks_as_their_documents_fill(spark):
    """The number grows with the documents, and the windows of all_detected() take that one exchange."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Mme Marie Dubois à Paris, no. "), "id").alias("text"))
    assert S.by_document(docs, docs, 25).rdd.getNumPartitions() == 80
    assert S.by_document(docs.limit(10), docs.limit(10)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    found = S.all_detected(docs)
    assert len(found.collect()) >= 2000
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "REPARTITION_BY_NUM" in plan
