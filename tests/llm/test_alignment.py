"""Alignment of two tokenizers against a plain version over whole library encodings."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from veilspark.llm import alignment

from .helpers import ODD, docs_of, prose

MORE = ["<|endoftext|> <s></s> <0x0A>", "▁x marks", "a\x00b", "中文中文 ไทย ﬁ", "  two  spaces \n\n\n ", "!?.,;" * 300, "1234567890 é é"]


def plain(rows):
    """{position of the row: the query's columns} by cuts at shared ends, tokenized by the file's own library."""
    import sentencepiece

    a_own = Tokenizer.from_file(alignment.path_of(alignment.A_FILE))
    a_own.encode_special_tokens = True
    b_own = sentencepiece.SentencePieceProcessor(model_file=alignment.path_of(alignment.B_FILE))
    a_letter = alignment.byte_letters()
    a_bytes = lambda i: bytes(a_letter[c] for c in a_own.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_own.id_to_piece(i)[3:5], 16)]) if b_own.is_byte(i) else b_own.id_to_piece(i).replace("▁", " ").encode()
    groups = []
    for _, text in rows:
        a, b = ([], []) if not text else (a_own.encode(" " + text, add_special_tokens=False).ids, b_own.encode(text))
        ends = []
        for ids, size in ((a, a_bytes), (b, b_bytes)):
            ends.append([0])
            for i in ids:
                ends[-1].append(ends[-1][-1] + len(size(i)))
        if not text or any(b"".join(map(f, ids)) != b" " + text.encode() for ids, f in ((a, a_bytes), (b, b_bytes))):
            groups.append([])
            continue
        cuts = sorted(set(ends[0]) & set(ends[1]))
        place = [{e: k for k, e in enumerate(side)} for side in ends]
        groups.append([(a[place[0][low] : place[0][high]], b[place[1][low] : place[1][high]]) for low, high in zip(cuts, cuts[1:])])
    held = [Counter((x, y) for ga, gb in found for x in ga for y in gb) for found in groups]
    counts = Counter(pair for one in held for pair in one)
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), found, links in zip(rows, groups, held):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in found)
        best = sum(n for (x, y), n in links.items() if counts[x, y] == most[x])
        total = sum(n * counts[pair] for pair, n in links.items())
        sizes = (sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), sum(links.values()))
        out.append((doc_id, *sizes, best, total, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [" ".join(prose(rng, rng.randrange(1, 200))) for _ in range(60)] + MORE + ODD[:6] + ["x " * 3_000, "a" * 5_000, "same text"] * 2
    return [(None if k % 9 == 4 else k, t) for k, t in enumerate(texts)]


def test_equals_the_plain_version(spark, rows):
    docs = docs_of(spark, rows, {"pair": 1, "n": 2, "doc_key": 3})
    assert rows_of(alignment.aligned(docs)) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("head", [0, 40])
def test_pairs_beyond_the_broadcast_are_shuffled(spark, rows, head):
    assert rows_of(alignment.aligned(docs_of(spark, rows), head=head)) == sorted(plain(rows), key=repr)


def test_large_groups_are_counted_by_distinct_ids(monkeypatch, spark, rows):
    a, b = alignment.byte_side(), alignment.piece_side()
    texts = [t or "" for _, t in rows]
    whole = [x.tolist() for x in alignment.links_of(alignment.align(texts, a, b))]
    monkeypatch.setattr(alignment, "PLAIN_LINKS", 1)
    assert [x.tolist() for x in alignment.links_of(alignment.align(texts, a, b))] == whole


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(alignment.aligned(docs)) == sorted(plain(rows), key=repr)


def test_empty_table(spark):
    assert alignment.aligned(docs_of(spark, [(1, "x")]).limit(0)).count() == 0
    assert rows_of(alignment.aligned(docs_of(spark, [(1, None), (None, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
