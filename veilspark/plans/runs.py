"""Queries of whole runs: with a store, over cells, with decisions, and with look-ups by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spans as S
from ..sources.parquet_store import ParquetStore
from ..sources.tables import work_folder
from . import engine
from . import fixtures as X
from .detection import _BY_NAME
from .registry import query

#: First names that a title's pattern takes whole.
_SHORT = [f for f in X.FIRST if "-" not in f]
_PASSPHRASE = "a passphrase of the queries"


def _store(spark: SparkSession) -> ParquetStore:
    """An encrypted store of its own in the shared work folder."""
    return ParquetStore(spark, f"{work_folder(spark)}/store-{uuid.uuid4().hex}", _PASSPHRASE, 1000)


def _titled(docs: DataFrame) -> DataFrame:
    """A detector of titled names alone, merged as all detectors' spans are."""
    return S.detected(docs, rules=[_BY_NAME["titles"]], engine="arrow")


# -- tables


def _units_sql(d: str) -> str:
    """Cells as units of a few workbooks, each with a titled name in it."""
    title, first, last = X.pick(d, X.TITLES, "row"), X.pick(d, _SHORT, "row * 7 + col"), X.pick(d, X.LAST, "row * 5 + col")
    return f"""SELECT CAST(row % 37 AS BIGINT) AS doc_id, CAST(row * 10 + col AS BIGINT) AS unit_ord, {title} AS title, {first} || ' ' || {last} AS name, value
      FROM ({X.cells_sql(d)}) c WHERE trim(value) <> ''"""


X.FIXTURES["units"] = _units_sql
X._TABLES["units"] = "part"


@query(
    "units",
    sql="""SELECT doc_id, unit_ord, title || ' PER-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') || ' : ' || value AS text, 1 AS n_replaced FROM units
      JOIN (SELECT name, row_number() OVER (ORDER BY pl) AS n FROM (SELECT name, min((doc_id, unit_ord)) AS pl FROM units GROUP BY 1) f) k USING (name)""",
)
def b1_tabular_run(units):
    """Workbooks cell by cell through detection, one table of names, rewriting and the store."""
    docs = units.select("doc_id", "unit_ord", F.concat_ws(" ", "title", "name", F.lit(":"), "value").alias("text"))
    return engine.process(docs, _store(units.sparkSession), detector=_titled)


# -- decisions


def _three_sql(d: str) -> str:
    """Three titled names a document, their places, and what was decided about each; some are still pending."""
    k, cast = "c_custkey", "STRING" if d == "spark" else "VARCHAR"
    name = lambda i: f"{X.pick(d, _SHORT, f'{k} * {i + 2} + {i}')} || ' ' || {X.pick(d, X.LAST, f'{k} * {2 * i + 1} + {i}')}"
    whole = f"""SELECT {k} AS doc_id, 'M. ' || {name(1)} AS s1, 'Mme ' || {name(2)} AS s2, 'Dr. ' || {name(3)} AS s3 FROM customer"""
    text = "'Voir ' || s1 || ', ' || s2 || ' et ' || s3 || '.'"
    starts = {1: "5", 2: "7 + length(s1)", 3: "11 + length(s1) + length(s2)"}
    rows = [f"SELECT doc_id, {text} AS text, {i} AS i, s{i} AS span, CAST({starts[i]} AS INTEGER) AS start_pos FROM w" for i in starts]
    action = X.pick(d, ["CONFIRM", "REJECT", "MODIFY", "CONFIRM", "CHANGE_PSEUDONYM", "PENDING", "CONFIRM"], "doc_id * 3 + i")
    changed = f"CASE i WHEN 1 THEN 'M. ' WHEN 2 THEN 'Mme ' ELSE 'Dr. ' END || {X.pick(d, _SHORT, 'doc_id + i')} || ' Nouveau'"
    return f"""SELECT *, {action} AS action, {changed} AS changed, 'Choix ' || CAST(doc_id % 50 AS {cast}) AS own FROM
      (SELECT * FROM ({" UNION ALL ".join(r.replace("FROM w", f"FROM ({whole}) w") for r in rows)}) u) v"""


X.FIXTURES["three"] = _three_sql


@query(
    "three",
    sql=""", v AS (SELECT *, CASE action WHEN 'MODIFY' THEN changed ELSE span END AS said FROM three WHERE action NOT IN ('REJECT', 'PENDING')),
      k AS (SELECT *, regexp_replace(said, '^(M\\.|Mme|Dr\\.) ', '') AS key FROM v),
      o AS (SELECT key, arg_min(own, (doc_id, i)) AS given FROM k WHERE action = 'CHANGE_PSEUDONYM' GROUP BY 1),
      c AS (SELECT key, row_number() OVER (ORDER BY pl) AS n FROM (SELECT key, min((doc_id, i)) AS pl FROM k WHERE key NOT IN (SELECT key FROM o) GROUP BY 1) f),
      p AS (SELECT k.doc_id, k.i, regexp_extract(said, '^(M\\.|Mme|Dr\\.) ', 0) || coalesce(given, 'PER-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0')) AS new
        FROM k LEFT JOIN o USING (key) LEFT JOIN c USING (key)),
      t AS (SELECT three.doc_id, three.i, coalesce(new, span) AS shown, new IS NOT NULL AS hit FROM three LEFT JOIN p ON p.doc_id = three.doc_id AND p.i = three.i)
      SELECT doc_id, 'Voir ' || max(shown) FILTER (i = 1) || ', ' || max(shown) FILTER (i = 2) || ' et ' || max(shown) FILTER (i = 3) || '.' AS text,
        (count(*) FILTER (hit))::INTEGER AS n_replaced FROM t GROUP BY 1""",
)
def v2_decided_run(three):
    """Documents after review: confirmed, modified and own pseudonyms reach the texts, what was rejected or is pending stays."""
    docs = three.select("doc_id", "text").distinct()
    none = F.lit(None).cast("string")
    own = F.when(F.col("action") == "CHANGE_PSEUDONYM", F.col("own"))
    decisions = three.where("action <> 'PENDING'").select(
        "doc_id",
        F.concat_ws("_", "span", "start_pos").alias("span_id"),
        F.lit(1).alias("seq"),
        "action",
        F.when(F.col("action") == "MODIFY", F.col("changed")).alias("new_text"),
        own.alias("new_pseudonym"),
        none.alias("entity_type"),
        F.lit(None).cast("int").alias("start_pos"),
        F.lit(None).cast("int").alias("end_pos"),
    )
    return engine.process(docs, _store(three.sparkSession), detector=_titled, decisions=decisions)


# -- the store


@query(
    "mappings",
    sql="""SELECT entity_type, full_name, pseudonym_full FROM mappings m WHERE EXISTS (SELECT 1 FROM mappings n WHERE substr(n.id, 1, 1) = 'a'
      AND (m.full_name = n.full_name OR m.last_name = n.full_name OR m.first_name = n.full_name OR m.full_name = n.last_name OR m.last_name = n.last_name OR m.first_name = n.last_name))""",
)
def m2_lookup(mappings):
    """Rows of an encrypted store that stand under one of many names, in full or by a part; only the names' buckets are read."""
    keep = _store(mappings.sparkSession)
    keep.add(mappings)
    names = mappings.where("substr(id, 1, 1) = 'a'").select(F.explode(F.array("full_name", "last_name")).alias("value"))
    return keep.lookup(names).select("entity_type", "full_name", "pseudonym_full")


@query("mappings", sql="SELECT entity_type, count(*) AS n, 0 AS n_gone FROM mappings WHERE id <> (SELECT min(id) FROM mappings) GROUP BY 1")
def m6_erased_store(mappings):
    """An encrypted store after an erasure: what is left by type, and how many rows still have the name."""
    keep = _store(mappings.sparkSession)
    keep.add(mappings)
    name = mappings.agg(F.min_by("full_name", "id")).first()[0]
    keep.erase(name)
    return keep.mappings().groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("full_name") == name).cast("int").alias("n_gone"))
