"""Assignment against a sequential model, and the invariants of names from a library."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import crypto, lookup
from veilspark.operators import assign as A
from veilspark.operators import store as M
from veilspark.sources.tables import kept


def _sequential(docs, mappings=()):
    """docs: lists of (span_ord, text, type) in order of document; single words take what the rules give in turn."""
    full, counters = {}, {"PERSON": 0, "LOCATION": 0, "ORG": 0}
    role_of = []
    for name, pseudonym in mappings:
        full[name] = pseudonym
        kind = {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORG"}[pseudonym[:3]]
        counters[kind] = max(counters[kind], int(pseudonym[4:]))
    out = {}
    for d, spans in enumerate(docs):
        here, cache = [], {}
        for span_ord, text, kind in spans:
            if text in cache:
                out[d, span_ord] = cache[text]
                continue
            words = text.split()
            if text in full:
                p = full[text]
            elif kind == "PERSON" and len(words) == 1 and (hit := _bearer(here, words[0])):
                p = hit
                cache[text] = p
                out[d, span_ord] = p
                continue
            elif kind == "PERSON" and len(words) == 1 and (hit := _bearer(role_of, words[0])):
                p = full[text] = hit
            else:
                counters[kind] += 1
                p = full[text] = f"{A.PREFIX[kind]}-{counters[kind]:03d}"
                if kind == "PERSON" and len(words) > 1:
                    here.append((words, p))
                    role_of.append((words, p))
            cache[text] = p
            out[d, span_ord] = p
    return out


def _bearer(bearers, word):
    for words, p in bearers:
        if words[0] == word:
            return p + "-P"
    for words, p in bearers:
        if words[-1] == word:
            return p + "-N"
    return None


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("partitions", [1, 5])
def test_neutral_ids_equal_the_sequential_model(spark, seed, partitions):
    rng = random.Random(seed)
    names = ["Ana", "Bea", "Cal", "Dan"]
    docs, rows = [], []
    for d in range(40):
        spans = []
        for k in range(rng.randrange(0, 6)):
            kind = rng.choice(["PERSON", "PERSON", "PERSON", "LOCATION"])
            text = f"Ville{rng.randrange(5)}" if kind == "LOCATION" else " ".join(x + str(rng.randrange(3)) for x in rng.sample(names, rng.choice([1, 2])))
            spans.append((k + 1, text, kind))
        docs.append(spans)
        rows += [(d, d, *s) for s in spans]
    old = [("Ana0 Bea0", "PER-041"), ("Ville1", "LOC-007")] if seed % 2 else []
    df = spark.createDataFrame(rows, "doc_id long, doc_ord long, span_ord int, text string, entity_type string").repartition(partitions)
    mappings = None
    if old:
        mappings = spark.createDataFrame([(n, p, "PERSON" if p[0] == "P" else "LOCATION", None, None, None, None) for n, p in old], "full_name string, pseudonym_full string, entity_type string, first_name string, last_name string, pseudonym_first string, pseudonym_last string")
    found = kept(A.neutral_ids(df, mappings))
    got = found.collect()
    assert {(r.doc_id, r.span_ord): r.pseudonym for r in got} == _sequential(docs, old)
    assert all(r.doc_ord == r.doc_id for r in got)
    by_id = A.neutral_ids(df.drop("doc_ord"), mappings).collect()
    assert sorted((r.doc_id, r.span_ord, r.pseudonym, r.is_new) for r in by_id) == sorted((r.doc_id, r.span_ord, r.pseudonym, r.is_new) for r in got)
    assert sum(r.is_new for r in got) == len({r.key for r in got if r.is_new})
    new = kept(A.new_mappings(found))
    assert new.groupBy("full_name").count().where("count > 1").count() == 0
    again = A.neutral_ids(df, new) if not old else None
    if again is not None:
        stored = {r.full_name for r in new.collect()}
        assert not [r for r in again.collect() if r.is_new and r.key in stored]


def test_library_names_keep_the_invariants(spark):
    rng = random.Random(1)
    first = [n for kind in lookup.GENDERS.values() for n in kind] + [f"Nom{k}" for k in range(40)]
    rows = [(d, d, k, f"{rng.choice(first)} {rng.choice(lookup.LAST_NAMES)}{rng.randrange(9)}", "PERSON") for d in range(30) for k in range(4)]
    rows += [(d, d, 9, f"Cabinet {d}", "ORG") for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, doc_ord long, span_ord int, text string, entity_type string")
    library = lookup.made_up_library()
    pool = lookup.pool(spark, lookup.pool_rows(library))
    genders = lookup.genders(spark)
    df = kept(df)
    out = A.library_names(df, pool, "plain", "secret", genders).collect()
    people = [r for r in out if r.entity_type == "PERSON"]
    for real, made in ((0, "pseudonym_first"), (1, "pseudonym_last")):
        pairs = {(r.key.split()[real], r[made]) for r in people}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    for r in people:
        for g in ("male", "female"):
            if r.key.split()[0] in lookup.GENDERS[g]:
                assert r.pseudonym_first in library["first_names"][g]
    assert len({r.pseudonym_full for r in out}) == len(out)
    assert sum(r.pseudonym_full.startswith("Org-") for r in out) == 20  # 40 names for 60 organisations
    assert sorted(A.library_names(df.repartition(9), pool, "plain", "secret", genders).collect()) == sorted(out)
    other = {r.key: r.pseudonym_full for r in A.library_names(df, pool, "plain", "another", genders).collect()}
    assert any(other[r.key] != r.pseudonym_full for r in out)


def test_library_names_are_remembered(spark):
    """Three runs on one mapping table: parts keep their names, nobody shares one, a surname alone is its bearer's."""
    rng = random.Random(4)
    pool, genders = lookup.pool(spark, lookup.pool_rows(lookup.made_up_library())), lookup.genders(spark)
    firsts, lasts = ["Jean", "Paul", "Marie", "Claude", "Nom", "Autre"], ["Dupont", "Martin", "Petit", "Noir"]
    mappings = spark.createDataFrame([], A.STORED + ", id string, theme string")
    seen = {}
    for run in range(3):
        docs = [[f"{rng.choice(firsts)} {rng.choice(lasts)}" for _ in range(3)] + [rng.choice(lasts), f"Cabinet {run} {d}"] for d in range(4 + run)]
        if run == 0:
            docs[0] = ["Jean Dupont", "Dupont", "Jean", "Seul"]
        if run == 1:
            docs[0] = ["Paul Dupont", "Jean Martin", "Martin", "Dupont", "Jean  Dupont"]
        rows = [(d, d, k, t, "ORG" if t.startswith("Cabinet") else "PERSON") for d, own in enumerate(docs) for k, t in enumerate(own)]
        df = kept(spark.createDataFrame(rows, "doc_id long, doc_ord long, span_ord int, text string, entity_type string"))
        found, new = A.library_ids(df, pool, "plain", "s", genders, mappings)
        found = {(r.doc_id, r.span_ord): r.pseudonym for r in found.collect()}
        assert len(found) == len(rows) and all(found.values()) and not any(x.startswith("~") for x in found.values())
        mappings = kept(mappings.unionByName(new))
        full = {r.full_name: r for r in mappings.collect()}
        assert len(full) == mappings.count()
        two = [r for r in full.values() if r.last_name and r.pseudonym_first]
        for real, made in (("first_name", "pseudonym_first"), ("last_name", "pseudonym_last")):
            pairs = {(r[real], r[made]) for r in two}
            assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        whole = [r.pseudonym_full for r in full.values() if r.last_name or r.entity_type == "ORG"]
        assert len(whole) == len(set(whole))
        for name, r in seen.items():
            assert full[name] == r
        seen = full
        for d, own in enumerate(docs):  # with no more than one bearer before it in the document, a surname is that one's
            bearers = {t for t in own[:3] if t.endswith(" " + own[3])} if len(own) == 5 and run != 1 else set()
            if len(bearers) == 1 and own[3] not in full:
                assert found[d, 3] == full[bearers.pop()].pseudonym_last
        if run == 0:
            assert found[0, 1] == full["Jean Dupont"].pseudonym_last and found[0, 2] == full["Jean Dupont"].pseudonym_first
            assert len(found[0, 3].split()) == 2
        if run == 1:
            assert found[0, 3] == full["Jean Dupont"].pseudonym_last and found[0, 0] != full["Jean Dupont"].pseudonym_full
            assert found[0, 1].split()[0] == full["Jean Dupont"].pseudonym_first and found[0, 4].startswith("Person-")
    # a rerun makes no name: a word that had its document's bearer may now be stored with the bearer's part
    parts = {x for r in seen.values() for x in (r.pseudonym_first, r.pseudonym_last)}
    assert {r.pseudonym_full for r in A.library_ids(df, pool, "plain", "s", genders, mappings)[1].collect()} <= parts


def test_numbered_names_never_meet(spark):
    """Without a pool each part has a number of its own, also after earlier runs."""
    pool = spark.createDataFrame([], "theme string, kind string, category string, ord int, value string")
    mappings = spark.createDataFrame([("PERSON", "X", "Y", "X Y", "Person-007", "Person-003", "Person-007 Person-003")], A.STORED)
    rows = [(1, 1, k, t, "PERSON") for k, t in enumerate(["Jean Dupont", "Paul Noir", "Jean Noir"])]
    df = spark.createDataFrame(rows, "doc_id long, doc_ord long, span_ord int, text string, entity_type string")
    out = A.library_names(df, pool, "plain", "s", lookup.genders(spark), False, mappings).collect()
    parts = {(r.key.split()[0], r.pseudonym_first) for r in out} | {(r.key.split()[1], r.pseudonym_last) for r in out}
    assert sorted(b for _, b in parts) == ["Person-008", "Person-009", "Person-010", "Person-011"]
    with pytest.raises(ValueError):
        A.library_names(df, pool, "plain", "s", lookup.genders(spark), True, mappings)


def test_library_is_checked():
    with pytest.raises(ValueError):
        lookup.pool_rows(lookup.made_up_library(n=100))
    with pytest.raises(ValueError):
        lookup.pool_rows(lookup.made_up_library(), "another theme")


def test_encryption(spark):
    keys = crypto.derive("correct horse battery", b"s" * 32, 100)
    df = spark.createDataFrame([(1, "Marie"), (2, "Marie"), (3, ""), (4, None), (5, "é\U0001f600")], "id int, full_name string")
    secret = M.encrypted(df, keys)
    found = {r.id: r.full_name for r in secret.collect()}
    assert found[1] == found[2] != "Marie" and found[4] is None and found[3]
    assert {r.id: r.full_name for r in M.decrypted(secret, keys).collect()} == {r.id: r.full_name for r in df.collect()}
    wrong = crypto.derive("another", b"s" * 32, 100)
    assert crypto.decrypted(secret, ["full_name"], wrong, strict=False).where("full_name IS NOT NULL").count() == 0
    assert crypto.fits(spark, crypto.canary(spark, keys), keys) and not crypto.fits(spark, crypto.canary(spark, keys), wrong)
    assert "cipher" not in repr(keys)
    for rows in (secret, M.decrypted(secret, keys), crypto.with_keyed_hashes(df, {"h": F.col("full_name")}, keys)):
        plan = rows._jdf.queryExecution().toString().lower()
        pads = [bytes(b ^ x for b in keys.nonce.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
        assert not any(secret_bytes in plan for secret_bytes in (keys.cipher.hex(), keys.nonce.hex(), *pads))


def test_store(spark):
    base = spark.createDataFrame([("a1", "X Y", "P1"), ("a2", "Z", "P2")], "id string, full_name string, pseudonym_full string")
    new = spark.createDataFrame([("b1", "Z", "P3"), ("b2", "W", "P4"), ("b3", "W", "P5")], "id string, full_name string, pseudonym_full string")
    assert sorted(r.id for r in M.saved(base, new).collect()) == ["a1", "a2", "b2"]
    with pytest.raises(ValueError):
        M.saved(base, new, strict=True)
    assert sorted((r.id, r.pseudonym_full) for r in M.replaced(base, new).collect()) == [("a1", "P1"), ("a2", "P3"), ("b2", "P4")]
    with pytest.raises(KeyError):
        M.deleted(base, "a")
    left, gone = M.deleted(base, "X Y")
    assert [r.id for r in gone.collect()] == ["a1"] and [r.id for r in left.collect()] == ["a2"]
    meta = spark.createDataFrame([("k", "1", 1), ("l", "1", 1)], "key string, value string, updated_at int")
    change = spark.createDataFrame([("k", "2", 2), ("l", None, 2)], "key string, value string, updated_at int")
    assert [(r.key, r.value) for r in M.upserted(meta, change).collect()] == [("k", "2")]


def test_erasure_row_has_no_names(spark):
    from veilspark.operators import audit as U

    goes = spark.createDataFrame([("a1", "Marie Dubois")], "id string, full_name string")
    row = U.erasure(goes, F.to_timestamp(F.lit("2024-01-01"))).first()
    assert "Marie" not in str(row) and row.entity_count == 1
    assert U.erasure(goes.limit(0), F.current_timestamp()).count() == 0


def test_numbers_by_ranges_equal_one_window(spark):
    import random

    from veilspark.operators.numbering import numbered

    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(5)) for k in range(2000)]
    df = spark.createDataFrame(rows, "k long, kind string, v int").repartition(7)
    for by in (None, "kind"):
        got = {r.k: r.n for r in numbered(df, ["v", "k"], by).collect()}
        want, seen = {}, {}
        for k, kind, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            group = kind if by else None
            seen[group] = want[k] = seen.get(group, 0) + 1
        assert got == want
    plan = numbered(df, ["v", "k"], "kind")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and numbered(df.limit(0), ["v"], "kind").count() == 0


def test_json_export_is_one_document_in_many_pieces(spark, sf):
    import json

    from veilspark.operators import audit as U
    from veilspark.plans import fixtures

    log = fixtures.load(spark, sf, "operations").select("id", "ts", "operation_type", "entity_count")
    lines = U.exported_json(log, {"success": "all"}, F.lit("2024-03-01T00:00:00"))
    assert lines.count() == log.count() + 2 and lines.agg(F.max(F.length("json"))).first()[0] < 300
    found = json.loads("\n".join(r.json for r in lines.orderBy("piece").collect()))
    rows = log.collect()
    assert found["export_metadata"] == {"exported_at": "2024-03-01T00:00:00", "filters": {"success": "all"}, "total_results": len(rows)}
    want = [(r.id, r.entity_count) for r in sorted(rows, key=lambda r: (-r.ts.timestamp(), r.id))]
    assert [(o["id"], o["entity_count"]) for o in found["operations"]] == want and len(want) > 0
    none = U.exported_json(log.limit(0), {}, F.lit("now")).orderBy("piece").collect()
    assert json.loads("".join(r.json for r in none))["operations"] == []


def test_patterns_run_once_for_each_text_and_type(spark):
    """Not on each mention, also where rows are kept by what the patterns give."""
    rows = [(k, 1, ["M. Jean Petit", "à Lyon", "Mme", None][k % 4], ["PERSON", "LOCATION", "PERSON", None][k % 4]) for k in range(40)]
    spans = spark.createDataFrame(rows, "doc_id long, span_ord int, text string, entity_type string")
    found = A.mentions(spans).where("key <> ''")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "regexp_replace" in plan and "regexp_replace" not in plan[plan.index("Aggregate") :]
    assert sorted((r.doc_id, r.key, r.first, r["last"], r.n_words) for r in found.collect()) == [
        (k, *(("Jean Petit", "Jean", "Petit", 2) if k % 4 == 0 else ("Lyon", "à", "Lyon", 1))) for k in range(40) if k % 4 < 2
    ]
    assert A.mentions(spans).count() == 40  # rows without a text, or a type, stay
