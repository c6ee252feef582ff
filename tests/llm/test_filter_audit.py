"""The filter audit against a plain simulation of every order, and its marks of copies."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from veilspark.llm import filter_audit

from .helpers import ODD, docs_of, prose


def plain_fails(rows):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    out = []
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = ""
        bad += "A" * (len(words) < 200)
        bad += "B" * (100 * len(set(words)) < 50 * len(words))
        bad += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        bad += "D" * bool(re.search("[#$%&*|]", text))
        bad += "E" * (r[0] is not None and r[0] > first[text])
        out.append(bad)
    return out


def plain_report(rows, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    fails, out, shapley = plain_fails(rows), {}, defaultdict(int)
    for part in {r[2] or "" for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [(r[0], bad) for r, bad in zip(rows, fails) if (r[2] or "") == part]
            whole = left
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                failing = [x for x in whole if letter in x[1]]
                out[part, order, step] = [len(left), len(removed), len(failing) - len(removed), sum(x[1] == letter for x in whole), sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed)]
                shapley[part, letter] += len(removed)
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def rows_and_labels():
    rng = random.Random(11)
    texts = [" ".join(prose(rng, rng.choice([3, 150, 210, 400]), rng.choice([30, 400]))) for _ in range(60)]
    texts += [t.upper() for t in texts[:9]] + [t + " a|b" for t in texts[9:20]] + [t[:-1] + "Q" for t in texts[20:40]] + ODD
    texts += texts[5:25] + [texts[50]] * 30 + [None, ""]
    rows = [(k * 3 % 151 if k % 13 else None, t, rng.choice(["en", "fr", None]), "s") for k, t in enumerate(texts)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(140)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize(("bits", "head"), [(64, 1 << 18), (1, 1 << 18), (64, 0), (2, 3)])
def test_equals_the_plain_version(spark, bits, head):
    """Also with hashes that many unlike texts share, and with classes beyond the broadcast."""
    rows, labels = rows_and_labels()
    docs = docs_of(spark, rows, {"part": "x", "fails": 7, "n": 1})
    out = filter_audit.audit(docs, labels_of(spark, labels), bits=bits, head=head).select(COLUMNS).collect()
    assert sorted(map(tuple, out)) == plain_report(rows, labels)


def test_marks_of_every_row(spark):
    rows, _ = rows_and_labels()
    out = filter_audit.marked(docs_of(spark, rows)).collect()
    as_bits = lambda bad: sum(1 << "ABCDE".index(c) for c in bad)
    want = sorted(((r[0], r[2] or "", as_bits(bad)) for r, bad in zip(rows, plain_fails(rows))), key=repr)
    assert sorted(map(tuple, out), key=repr) == want


def test_empty_tables(spark):
    docs, labels = docs_of(spark, [(1, "x")]), labels_of(spark, [(1, 1, 1)])
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    out = filter_audit.audit(docs, labels.limit(0)).collect()
    assert len(out) == 600 and {r.good_lost for r in out} == {0}
