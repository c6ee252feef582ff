"""The pipeline and the registered queries."""

import duckdb
import pytest

import corpus_pipeline
from veilspark.llm import decontaminate, mixing, queries

from . import brute


def _tables(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_stages_equal_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "sharding"]
    steps = dict(corpus_pipeline.STAGES)
    one = steps["quality_rules"](spark, docs, sf)
    assert one.columns == docs.columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert not any(brute.quality_counts(t)[-1] for t in kept.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(d in kept for d, t in rows if labels.get(d) == 1 and not brute.quality_counts(t)[-1])
    assert not any(labels.get(d) == 0 for d in kept)
    two = steps["ngram_jaccard_join"](spark, one, sf)
    want = {d for d, (_, c) in brute.components(sorted(kept.items())).items() if c == d}
    assert {r.doc_id for r in two.collect()} == want and two.columns == docs.columns
    three = steps["benchmark_decontamination"](spark, two, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    short = [(d, kept[d]) for d in want if len(kept[d].split()) < 400]
    leaks = {d for d, _ in brute.leaks(short, items, decontaminate.WINDOW, decontaminate.PERCENT, decontaminate.MIN_WORDS)}
    left = {r.doc_id for r in three.collect()}
    assert {d for d, _ in short} - left == leaks and three.columns == docs.columns
    four = steps["mixing_sources"](spark, three, sf)
    again = {r.doc_id for r in four.collect()}
    assert again == left and four.columns == docs.columns
    assert four.count() == mixing.mixed(three).count()
    out = steps["sharding"](spark, four, sf).collect()
    ran = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.text_crc32) for r in ran) == sorted((r.doc_id, r.text_crc32) for r in out)
    assert {(r.shard, r.slot) for r in ran} == {(r.shard, r.slot) for r in out}
    text = {r.doc_id: (r.text, r.lang, r.source) for r in docs.collect()}
    assert all((r.text, r.lang, r.source) == text[r.doc_id] for r in ran)


def test_pipeline_odd_tables(spark, sf, tmp_path):
    """Nulls, repeated rows and clashing columns pass; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    odd = docs.limit(3).selectExpr("cast(null AS long) AS doc_id", "text", "cast(null AS string) AS lang", "cast(null AS string) AS source", "n_chars")
    blank = docs.limit(3).selectExpr("doc_id + 9000 AS doc_id", "cast(null AS string) AS text", "lang", "source", "cast(null AS long) AS n_chars")
    rows = docs.unionAll(docs.limit(20)).unionAll(odd).unionAll(blank).selectExpr("*", "7 AS shard", "'x' AS kept", "1 AS epoch")
    for folder, table in (("a", rows), ("b", rows.limit(0))):
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
        table.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    plain = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/a").where("text IS NOT NULL").collect()}
    assert {r.doc_id for r in out if r.doc_id is not None} == plain - {None} and plain
    assert {(r.shard, r.slot) for r in out} and len({(r.shard, r.slot) for r in out}) == len(out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    got = queries.queries()[name](spark, sf).toPandas()
    want = _tables(sf).execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_columns_of_the_contracts(spark, sf):
    first = {
        "op1": ["doc_id", "n_shingles", "component_id"],
        "op2": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op4": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op8": ["doc_id", "held_out", "lang_pred", "score"],
        "op9": ["doc_id", "held_out", "score", "predicted"],
        "op10": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, query in found.items():
        want = first.get(name.split("_")[0])
        if want:
            out = query(spark, sf)
            assert out.columns[: len(want)] == want
            assert out.count() == n
