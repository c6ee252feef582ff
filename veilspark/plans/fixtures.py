"""Inputs made from the driver's tables: the same expressions for Spark and for DuckDB.

Documents are sentences with names, places and organisations picked by key, so that
detection has something to find and both engines see the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TITLES = ["M.", "Mme", "Dr.", "Pr.", "Me"]
FIRST = ["Marie", "Jean", "Sophie", "Pierre", "Claire", "Luc", "Anne-Sophie", "Jean-Pierre", "Hugo", "Alice", "Camille"]
LAST = ["Dubois", "Martin", "Lefebvre", "Moreau", "Durand", "Laurent", "Bernard", "Petit", "Mercier"]
CITIES = ["Paris", "Lyon", "Marseille", "Toulouse", "Nice", "Lille", "Aix-en-Provence"]
ORGS = ["Cabinet Mercier", "Nordtech SARL", "Delta Conseil SAS", "Fondation Pasteur", "Groupe Horizon", "Alpha SA"]


def pick(dialect: str, values: list[str], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    at = f"CAST(1 + ({index}) % {len(values)} AS INTEGER)"
    return f"element_at(array({listed}), {at})" if dialect == "spark" else f"list_extract([{listed}], {at})"


def div(dialect: str, a: str, b: int) -> str:
    return f"({a} div {b})" if dialect == "spark" else f"({a} // {b})"


def _sentence(d: str, k: str, m: str) -> str:
    """One of eight sentences, by m, with names by k."""
    t, f, f2 = pick(d, TITLES, k), pick(d, FIRST, k), pick(d, FIRST, f"{k} * 3 + 1")
    n, n2 = pick(d, LAST, k), pick(d, LAST, f"{k} * 5 + 2")
    c, o = pick(d, CITIES, k), pick(d, ORGS, k)
    return f"""CASE ({m}) % 8
      WHEN 0 THEN 'Entretien avec ' || {t} || ' ' || {f} || ' ' || {n} || ' habitant à ' || {c} || '.'
      WHEN 1 THEN {f} || ' ' || {n} || ' travaille pour ' || {o} || '; voir ' || {t} || ' ' || {n2} || '.'
      WHEN 2 THEN 'Objet : dossier de ' || {n} || ', suivi en France.'
      WHEN 3 THEN {n} || ', ' || {f2} || ' a signé dans ' || {c} || '.'
      WHEN 4 THEN 'Rien de neuf chez ' || {o} || '.'
      WHEN 5 THEN '\U0001f600 ' || {f2} || ' ' || {n2} || ' et ' || {t} || ' ' || {f} || ' ' || {n} || '.'
      WHEN 6 THEN {f} || ' est venue de ' || {c} || ' avec ' || {n} || '.'
      ELSE 'rendez-vous pris sans autre précision.' END"""


def docs_sql(d: str) -> str:
    k = "c_custkey"
    parts = [_sentence(d, k, k), _sentence(d, div(d, k, 3), f"{k} * 3 + 1"), _sentence(d, div(d, k, 5), f"{k} * 5 + 2")]
    line = "chr(10)"
    return f"SELECT c_custkey AS doc_id, {parts[0]} || ' ' || {parts[1]} || {line} || {parts[2]} AS text FROM customer"


def mappings_sql(d: str) -> str:
    k = "c_custkey"
    first = pick(d, FIRST, k)
    cast = "STRING" if d == "spark" else "VARCHAR"
    last = f"{pick(d, LAST, div(d, k, 3))} || CAST({k} AS {cast})"
    kind = pick(d, ["PERSON", "PERSON", "LOCATION", "ORG"], k)
    name = f"CASE {kind} WHEN 'PERSON' THEN {first} || ' ' || {last} WHEN 'LOCATION' THEN {pick(d, CITIES, k)} || ' ' || CAST({k} AS {cast}) ELSE {pick(d, ORGS, k)} || ' ' || CAST({k} AS {cast}) END"
    number = f"lpad(CAST({k} AS {cast}), 5, '0')"
    return f"""SELECT md5(CAST({k} AS {cast})) AS id, {kind} AS entity_type,
      CASE WHEN {kind} = 'PERSON' THEN {first} END AS first_name, CASE WHEN {kind} = 'PERSON' THEN {last} END AS last_name,
      {name} AS full_name,
      CASE {kind} WHEN 'PERSON' THEN 'PER-' WHEN 'LOCATION' THEN 'LOC-' ELSE 'ORG-' END || {number} AS pseudonym_full,
      {pick(d, ["neutral_id", "star", "plain"], f"{k} * 7")} AS theme,
      CASE WHEN {k} % 6 = 0 THEN NULL WHEN {k} % 6 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(({k} * 37) % 100 AS DOUBLE) / 100 END AS confidence_score,
      {k} % 11 = 0 AS is_ambiguous FROM customer"""


def operations_sql(d: str) -> str:
    cast = "STRING" if d == "spark" else "VARCHAR"
    k = "CAST(get_json_object(props, '$.k') AS INT)" if d == "spark" else "CAST(json_extract_string(props, '$.k') AS INTEGER)"
    return f"""SELECT md5(CAST(event_id AS {cast})) AS id, CAST(ts AS TIMESTAMP) AS ts, event_type AS operation_type,
      event_type <> 'error' AS success, value AS processing_time_seconds, {k} AS entity_count, event_id, user_id FROM events"""


def _span_rows(d: str) -> str:
    """A row a customer: spans with places and confidences by key, for the merge and the review."""
    k = "c_custkey"
    return f"""SELECT {div(d, k, 3)} AS doc_id, {k} AS span_no,
      {pick(d, FIRST, k)} || ' ' || {pick(d, LAST, k)} AS name, {pick(d, ORGS, k)} AS org, {pick(d, CITIES, k)} AS city,
      CAST(({k} * 31) % 37 AS INTEGER) AS a, CAST(2 + ({k} * 7) % 9 AS INTEGER) AS w FROM customer"""


def regex_spans_sql(d: str) -> str:
    """doc_id, text, entity_type, start_pos, end_pos, confidence, pattern_ord."""
    kind = pick(d, ["PERSON", "LOCATION", "ORG"], "span_no")
    return f"""SELECT doc_id, CASE {kind} WHEN 'PERSON' THEN (CASE WHEN span_no % 4 = 0 THEN 'Dr. ' ELSE '' END) || name WHEN 'LOCATION' THEN city ELSE org END AS text,
      {kind} AS entity_type, a AS start_pos, a + w AS end_pos, CAST(60 + (span_no * 13) % 30 AS DOUBLE) / 100 AS confidence,
      CAST(span_no % 7 AS INTEGER) AS pattern_ord FROM ({_span_rows(d)}) s"""


def ner_spans_sql(d: str) -> str:
    """Spans at, inside, across or beside the regex ones of a document."""
    kind = pick(d, ["PERSON", "ORG", "LOCATION", "PERSON"], "span_no")
    text = "CASE span_no % 5 WHEN 0 THEN 'Lieu' WHEN 1 THEN 'Dr.' WHEN 2 THEN name ELSE org END"
    return f"""SELECT doc_id, {text} AS text, {kind} AS entity_type, CAST(a + span_no % 3 AS INTEGER) AS start_pos,
      CAST(a + span_no % 3 + w - span_no % 2 AS INTEGER) AS end_pos, CAST(NULL AS DOUBLE) AS confidence FROM ({_span_rows(d)}) s WHERE span_no % 3 <> 1"""


def gold_sql(d: str) -> str:
    kind = pick(d, ["PERSON", "LOCATION", "ORG"], "span_no")
    text = f"CASE {kind} WHEN 'PERSON' THEN (CASE WHEN span_no % 4 = 0 THEN 'Dr. ' ELSE '' END) || name WHEN 'LOCATION' THEN city ELSE org END"
    return f"""SELECT doc_id, {text} AS entity_text, {kind} AS entity_type, CAST(a + span_no % 2 AS INTEGER) AS start_pos, a + w AS end_pos
      FROM ({_span_rows(d)}) s WHERE span_no % 5 <> 2"""


def decisions_sql(d: str) -> str:
    """Two or three decisions on most spans; span_id is the span's number."""
    cast = "STRING" if d == "spark" else "VARCHAR"
    one = lambda seq, actions, factor: f"SELECT doc_id, CAST(span_no AS {cast}) AS span_id, {seq} AS seq, {pick(d, actions, f'span_no * {factor}')} AS action, CASE WHEN span_no % 2 = 0 THEN name || '{seq}' END AS new_text, CASE WHEN span_no % 3 = 0 THEN 'PER-' || CAST(span_no AS {cast}) END AS new_pseudonym, CAST(NULL AS {cast}) AS entity_type, CAST(NULL AS INTEGER) AS start_pos, CAST(NULL AS INTEGER) AS end_pos FROM ({_span_rows(d)}) s"
    added = f"SELECT doc_id, 'add' || CAST(span_no AS {cast}), 1, 'ADD', city, CAST(NULL AS {cast}), 'LOCATION', a, a + w FROM ({_span_rows(d)}) s WHERE span_no % 10 = 3"
    first = one(1, ["CONFIRM", "MODIFY", "REJECT", "CONFIRM", "CHANGE_PSEUDONYM"], 1)
    second = one(2, ["CONFIRM", "MODIFY", "MODIFY", "REJECT"], 3) + " WHERE span_no % 4 < 2"
    return f"{first} UNION ALL {second} UNION ALL {added}"


def review_spans_sql(d: str) -> str:
    cast = "STRING" if d == "spark" else "VARCHAR"
    return f"SELECT doc_id, CAST(span_no AS {cast}) AS span_id, name AS text, 'PERSON' AS entity_type, a AS start_pos, a + w AS end_pos FROM ({_span_rows(d)}) s WHERE span_no % 9 <> 4"


def cells_sql(d: str) -> str:
    """Cells of the part table: row is the key, four columns, some blank."""
    cast = "STRING" if d == "spark" else "VARCHAR"
    values = ["p_brand", "CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_type END", f"CAST(p_size AS {cast})", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'note ' || p_brand END"]
    return " UNION ALL ".join(f"SELECT CAST(p_partkey AS INTEGER) AS row, {i} AS col, {v} AS value FROM part" for i, v in enumerate(values, 1))


def paths_sql(d: str) -> str:
    cast = "STRING" if d == "spark" else "VARCHAR"
    ext = pick(d, [".txt", ".PDF", ".docx", ".csv", ".xlsx", ".md", ".png", ""], "c_custkey")
    mid = "CASE WHEN c_custkey % 9 = 0 THEN '_pseudonymized' ELSE '' END"
    return f"SELECT '/data/v' || CAST(c_custkey % 10 AS {cast}) || '.1/doc' || CAST(c_custkey AS {cast}) || {mid} || {ext} AS path FROM customer"


FIXTURES = {
    "docs": docs_sql,
    "mappings": mappings_sql,
    "operations": operations_sql,
    "regex_spans": regex_spans_sql,
    "ner_spans": ner_spans_sql,
    "gold": gold_sql,
    "decisions": decisions_sql,
    "review_spans": review_spans_sql,
    "cells": cells_sql,
    "paths": paths_sql,
}
_TABLES = {"operations": "events", "cells": "part"}
#: Rows of customer or part that a task makes fixtures of.
ROWS = 1 << 13


def dealt(rows: DataFrame, at_once: int = ROWS) -> DataFrame:
    """rows by their key over as many tasks as have at_once rows each.

    A row of a few bytes becomes several texts, so a file that is one split would be one task, however large.
    """
    return rows.repartition(max(1, -(-rows.count() // at_once)), rows.columns[0])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame over the tables in sf_dir."""
    table = _TABLES.get(name, "customer")
    sql = FIXTURES[name]("spark").replace(f"FROM {table}", "FROM {_t}")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql, _t=rows if table == "events" else dealt(rows))


def duck(*names: str, recursive: bool = False) -> str:
    """WITH clauses of fixtures, to be followed by ', more AS (...)' or by the query."""
    parts = ", ".join(f"{n} AS ({FIXTURES[n]('duck')})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}"
