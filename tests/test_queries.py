"""Every named query against its DuckDB twin."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.plans import queries

SMALL = "/root/testdata/sf0.001"
TABLES = ("customer", "events", "part", "conversations", "documents", "benchmark")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return None
    return float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else x


def rows(df):
    return sorted(repr(tuple(map(_plain, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SMALL).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark).collect()
    assert out and any("PER-001" in r.text for r in out)


def test_only_known_names_have_sql():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fixtures_are_made_by_many_tasks(spark, sf, monkeypatch):
    """A file of one split is dealt over tasks of so many rows, none of which grows with the table."""
    from veilspark.plans import fixtures

    monkeypatch.setattr(fixtures.dealt, "__defaults__", (20,))
    for name in ("docs", "mappings", "cells", "gold", "decisions"):
        rows = fixtures.load(spark, sf, name)
        sizes = rows.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 5, name
        assert max(r["count"] for r in sizes) < rows.count() / 2, name


def test_annotator_reads_a_text_once_in_one_pass(spark, sf):
    from veilspark.functions import patterns as P
    from veilspark.operators import spans as S
    from veilspark.plans import detection, fixtures, queries

    docs = fixtures.load(spark, sf, "docs")
    for name, rules in (("d24_annotator_all", P.ANNOTATOR), ("d24_annotator", detection._SAME_EDGES)):
        got = queries.queries()[name](spark, sf)
        assert "MapInArrow" in got._jdf.queryExecution().toString(), name
        want = S.regex_spans(docs, rules)  # natively
        want = (S.dedup_spans(want) if name.endswith("all") else want).select(*got.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0, name


def test_organizations_are_sought_in_runs_with_an_ending(spark, sf):
    """One pass; capitals without an ending after them aren't searched from one by one."""
    got = queries.queries()["d5_organizations_suffix"](spark, sf)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
