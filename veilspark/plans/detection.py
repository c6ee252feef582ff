"""Queries of detection: patterns, dictionaries, deduplication and the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookup
from ..functions import patterns as P
from ..operators import spans as S
from .registry import on_tables, query

_BY_NAME = {p.name: p for p in (*P.PATTERNS, *P.ANNOTATOR)}


def spans_sql(regex: str, docs: str = "docs", extra: str = "") -> str:
    """Spans of one pattern by the same gap arithmetic, over docs(doc_id, text). RE2 has ASCII word edges, which the fixtures fit."""
    rule = regex.replace("'", "''")
    return f"""(SELECT doc_id, m[i] AS text,
        (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS start_pos,
        (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::INTEGER AS end_pos{extra}
      FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{rule}') AS m, string_split_regex(text, '{rule}') AS g FROM {docs}) q) r)"""


def _one(name: str, docs: DataFrame, engine: str = "native") -> DataFrame:
    return S.regex_spans(docs, [_BY_NAME[name]], engine=engine).select("doc_id", "text", "start_pos", "end_pos")


_PLACE = _BY_NAME["location_indicators"].regex.replace(r"\b(à|", "(à|")


def _plain(regex: str) -> str:
    return f"SELECT * FROM {spans_sql(regex)}"


@query("docs", sql=_plain(_BY_NAME["titles"].regex))
def d1_titles(docs):
    return _one("titles", docs)


@query("docs", sql=_plain(_BY_NAME["compound_names"].regex))
def d2_compound_names(docs):
    return _one("compound_names", docs)


# RE2 has no lookahead: what it forbids is taken out afterwards
_LAST_FIRST = _BY_NAME["last_first_names"].regex.replace(f"(?!{P.NOT_BEFORE_FIRST_NAME})", "")
_FORBIDDEN = f"regexp_matches(text, ',\\s*({P.NOT_BEFORE_FIRST_NAME})')"


@query("docs", sql=f"SELECT * FROM {spans_sql(_LAST_FIRST)} WHERE NOT {_FORBIDDEN}")
def d3_last_first_names(docs):
    return _one("last_first_names", docs)


@query("docs", sql=_plain(_PLACE))
def d4_location_indicators(docs):
    return _one("location_indicators", docs)


@query("docs", sql=_plain(_BY_NAME["organizations_suffix"].regex))
def d5_organizations_suffix(docs):
    return _one("organizations_suffix", docs, "arrow")  # the native engine searches on from each capital letter


@query("docs", sql=_plain(_BY_NAME["organizations_prefix"].regex))
def d6_organizations_prefix(docs):
    return _one("organizations_prefix", docs)


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_FIRST = sorted({n for kind in lookup.GENDERS.values() for n in kind})


@query(
    "docs",
    sql=f"""SELECT doc_id, regexp_replace(text, '\\s+', ' ') AS text, start_pos, end_pos FROM {spans_sql(P.FULL_NAME.regex)}
      WHERE regexp_extract(text, '^(\\S+)\\s+(\\S+)$', 1) IN ({_listed(_FIRST)}) AND regexp_extract(text, '^(\\S+)\\s+(\\S+)$', 2) IN ({_listed(lookup.LAST_NAMES)})""",
)
def d7_full_names(docs):
    names = lookup.names(docs.sparkSession)
    found = S.full_name_spans(docs, names.where("kind = 'first'"), names.where("kind = 'last'"))
    return found.select("doc_id", "text", "start_pos", "end_pos")


_PLACES = [v for kind in lookup.PLACES.values() for v in kind]


@query("docs", sql=f"SELECT * FROM {spans_sql(P.GEOGRAPHY.regex)} WHERE text IN ({_listed(_PLACES)})")
def d8_geography(docs):
    found = S.geography_spans(docs, lookup.places(docs.sparkSession))
    return found.select("doc_id", "text", "start_pos", "end_pos")


_TOKENS = "SELECT doc_id, CAST(start_pos + 0 AS INT) AS start_pos, CAST(start_pos + 3 AS INT) AS end_pos, CASE WHEN start_pos % 2 = 0 THEN 'PROPN' ELSE 'NOUN' END AS pos, CASE WHEN start_pos % 3 = 0 THEN '' ELSE 'LOC' END AS ent_type FROM regex_spans"


@query(
    "regex_spans",
    sql=f""", s AS (SELECT DISTINCT * FROM regex_spans), t AS ({_TOKENS}), bad AS (
      SELECT s.doc_id, s.start_pos, s.end_pos, s.text FROM (SELECT DISTINCT doc_id, start_pos, end_pos, text FROM s) s
      JOIN t ON s.doc_id = t.doc_id AND t.start_pos < s.end_pos AND s.start_pos < t.end_pos
      GROUP BY 1, 2, 3, 4 HAVING min(t.start_pos) = s.start_pos AND max(t.end_pos) = s.end_pos AND NOT bool_or(t.pos = 'PROPN' OR t.ent_type = ''))
      SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = s.doc_id AND b.start_pos = s.start_pos AND b.end_pos = s.end_pos AND b.text = s.text)""",
)
def d9_pos_filter(spans):
    spark = spans.sparkSession
    return S.pos_filtered(spans.distinct(), spark.sql(_TOKENS.replace("FROM regex_spans", "FROM {t}"), t=spans))


@query(
    "regex_spans",
    sql="""SELECT doc_id, text, entity_type, start_pos, end_pos, confidence, pattern_ord FROM regex_spans
      QUALIFY row_number() OVER (PARTITION BY doc_id, start_pos, end_pos ORDER BY confidence DESC, pattern_ord, text, entity_type) = 1""",
)
def d10_span_dedup(spans):
    return S.dedup_spans(spans)


_RULES = ", ".join(f"('{r.entity_type}', {r.confidence}, {str(r.enabled).lower()})" for r in (*P.PATTERNS, P.FULL_NAME, P.GEOGRAPHY))


@query(
    "docs",
    sql=f"SELECT t AS entity_type, count(*) AS n_patterns, count(*) FILTER (e) AS n_enabled, round(avg(c::DOUBLE), 6) AS avg_confidence FROM (VALUES {_RULES}) v(t, c, e) GROUP BY 1",
)
def d11_pattern_stats(docs):
    found = S.pattern_stats((*P.PATTERNS, P.FULL_NAME, P.GEOGRAPHY), docs.sparkSession)
    return found.withColumn("avg_confidence", F.round("avg_confidence", 6))


_LABELS = "element_at(array('PER', 'per', 'GPE', 'MISC', 'Loc', 'ORG', 'PERSON'), CAST(1 + (start_pos % 7) AS INT))"
_LABELS_SQL = "list_extract(['PER', 'per', 'GPE', 'MISC', 'Loc', 'ORG', 'PERSON'], CAST(1 + (start_pos % 7) AS INTEGER))"


@query(
    "regex_spans",
    sql=f"""SELECT doc_id, text, start_pos, {_LABELS_SQL} AS label, CASE WHEN upper({_LABELS_SQL}) IN ('PER', 'PERSON') THEN 'PERSON'
      WHEN upper({_LABELS_SQL}) IN ('LOC', 'GPE') THEN 'LOCATION' ELSE 'ORG' END AS entity_type FROM regex_spans WHERE upper({_LABELS_SQL}) <> 'MISC'""",
)
def d13_label_map(spans):
    return S.mapped_labels(spans.select("doc_id", "text", "start_pos", F.expr(_LABELS).alias("label")))


def _strip_sql(text: str) -> str:
    """Titles taken out, for texts whose titles are followed by a blank or the end."""
    rule = r"(?i)(^|[^\p{L}\p{N}_])(?:Docteur|Professeur|Madame|Monsieur|Mademoiselle|Maître|Dr\.?|Pr\.?|Prof\.?|M\.?|Mme\.?|Mlle\.?|Me\.?)(?:\s+|$)"
    return f"trim(regexp_replace({text}, '{rule}', '\\1', 'g'))"


MERGE = f""", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, text, entity_type) AS ord FROM ner_spans),
  d AS (SELECT doc_id, text, entity_type, start_pos, end_pos, confidence FROM regex_spans
    QUALIFY row_number() OVER (PARTITION BY doc_id, start_pos, end_pos ORDER BY confidence DESC, pattern_ord, text, entity_type) = 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, text, entity_type) AS ord FROM d),
  p AS (SELECT r.*, n.ord AS n_ord, CASE WHEN n.ord IS NULL THEN 'alone'
      WHEN (r.start_pos = n.start_pos AND r.end_pos = n.end_pos) OR {_strip_sql('r.text')} = {_strip_sql('n.text')} THEN 'same'
      WHEN r.entity_type = 'ORG' AND n.entity_type = 'PERSON' AND regexp_matches(r.text, '^(Cabinet|Société|Entreprise|Groupe|Compagnie)')
        AND r.start_pos <= n.start_pos AND r.end_pos >= n.end_pos THEN 'over' ELSE 'ambiguous' END AS kind
    FROM r LEFT JOIN n ON r.doc_id = n.doc_id AND r.start_pos < n.end_pos AND n.start_pos < r.end_pos
    QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.ord ORDER BY n.ord) = 1),
  u AS (
    SELECT doc_id, text, entity_type, start_pos, end_pos, confidence, false AS is_ambiguous, 'ner' AS source, 0 AS s, ord FROM n
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.kind = 'over' AND p.doc_id = n.doc_id AND p.n_ord = n.ord)
    UNION ALL SELECT doc_id, text, entity_type, start_pos, end_pos, confidence, kind = 'ambiguous', 'regex', 1, ord FROM p WHERE kind <> 'same'),
  f AS (SELECT * FROM u WHERE (entity_type <> 'PERSON' OR {_strip_sql('text')} <> '')
    AND lower(trim(text)) NOT IN ('lieu', 'date', 'heure', 'objet', 'sujet', 'titre', 'nom', 'adresse'))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, s, ord))::INTEGER AS span_ord, text, entity_type, start_pos, end_pos,
    confidence, is_ambiguous, source FROM f"""


@query("ner_spans", "regex_spans", sql=MERGE)
def d15_hybrid_merge(ner, regex):
    return S.merged(ner, S.dedup_spans(regex))


@query("ner_spans", sql=f"SELECT * FROM ner_spans WHERE entity_type <> 'PERSON' OR {_strip_sql('text')} <> ''")
def d19_without_bare_titles(ner):
    return S.without_bare_titles(ner)


@query("ner_spans", sql="SELECT * FROM ner_spans WHERE lower(trim(text)) NOT IN ('lieu', 'date', 'heure', 'objet', 'sujet', 'titre', 'nom', 'adresse')")
def d20_without_labels(ner):
    return S.without_labels(ner)


@query("ner_spans", sql="SELECT * FROM ner_spans WHERE entity_type IN ('PERSON', 'ORG')")
def d21_only_types(ner):
    return S.only_types(ner, ["person", "ORG", "animal"])


_CELLS = "SELECT row, col, 'voir M. Dubois ' || value || ' et Mme Petit' AS text FROM cells WHERE trim(value) <> ''"


@query(
    "cells",
    sql=f""", c AS ({_CELLS}), docs AS (SELECT row * 10 + col AS doc_id, text FROM c)
      SELECT doc_id // 10 AS row, (doc_id % 10)::INTEGER AS col, chr((64 + doc_id % 10)::INTEGER) || (doc_id // 10)::VARCHAR AS context_label, text, start_pos, end_pos
      FROM {spans_sql(_BY_NAME['titles'].regex)}""",
)
def d22_cell_spans(cells):
    from ..sources import cells as C

    rows = C.with_refs(cells.where("trim(value) <> ''").withColumn("text", F.concat(F.lit("voir M. Dubois "), "value", F.lit(" et Mme Petit"))))
    found = S.regex_spans(rows, [_BY_NAME["titles"]], ["row", "col", "cell_ref"])
    return found.select(F.col("row").cast("long").alias("row"), "col", F.col("cell_ref").alias("context_label"), "text", "start_pos", "end_pos")


_TERMS = [("Cabinet Mercier", "ORG"), ("Paris", "LOCATION"), ("M. ", "PERSON"), ("Aix-en-Provence", "LOCATION")]


@query(
    "docs",
    sql=" UNION ALL ".join(f"SELECT doc_id, text, start_pos, end_pos, '{kind}' AS entity_type FROM {spans_sql(S.java_quoted(term))}" for term, kind in _TERMS),
)
def d23_literal_terms(docs):
    return S.literal_spans(docs, _TERMS).select("doc_id", "text", "start_pos", "end_pos", "entity_type")


# a_full_name and a_institution meet accented letters at their edges, where RE2 differs
_SAME_EDGES = [p for p in P.ANNOTATOR if p.name not in ("a_full_name", "a_institution", "a_title_name")]


@query(
    "docs",
    sql=" UNION ALL ".join(f"SELECT doc_id, text, start_pos, end_pos, '{p.entity_type}' AS entity_type, '{p.name}' AS pattern FROM {spans_sql(p.regex)}" for p in _SAME_EDGES),
)
def d24_annotator(docs):
    return S.regex_spans(docs, _SAME_EDGES, engine="arrow").select("doc_id", "text", "start_pos", "end_pos", "entity_type", "pattern")


@query("docs")
def d24_annotator_all(docs):
    """All patterns, one span a place. No twin for the same reason as d3."""
    return S.dedup_spans(S.regex_spans(docs, P.ANNOTATOR, engine="arrow")).select("doc_id", "text", "start_pos", "end_pos", "entity_type")


@query("docs", sql=f"SELECT doc_id, start_pos, end_pos FROM {spans_sql('Dubois')}")
def d25_positions(docs):
    return S.literal_spans(docs, [("Dubois", "PERSON")]).select("doc_id", "start_pos", "end_pos")


def detected_sql() -> str:
    """CTEs after `docs`, and a query: spans of all patterns and both dictionaries, as all_detected() has them."""
    parts = []
    for k, p in enumerate((*P.PATTERNS, P.FULL_NAME, P.GEOGRAPHY)):
        regex, text, where = p.regex, "text", "true"
        if p.name == "last_first_names":
            regex, where = _LAST_FIRST, f"NOT {_FORBIDDEN}"
        elif p.name == "location_indicators":
            regex = _PLACE
        elif p is P.FULL_NAME:
            text = "regexp_replace(text, '\\s+', ' ')"
            part = lambda i: f"regexp_extract(text, '^(\\S+)\\s+(\\S+)$', {i})"
            where = f"{part(1)} IN ({_listed(_FIRST)}) AND {part(2)} IN ({_listed(lookup.LAST_NAMES)})"
        elif p is P.GEOGRAPHY:
            where = f"text IN ({_listed(_PLACES)})"
        parts.append(f"SELECT doc_id, {text} AS text, '{p.entity_type}' AS entity_type, start_pos, end_pos, {p.confidence}::DOUBLE AS confidence, {k} AS pattern_ord FROM {spans_sql(regex)} WHERE {where}")
    none = "SELECT doc_id, text, entity_type, start_pos, end_pos, CAST(NULL AS DOUBLE) AS confidence FROM regex_spans WHERE false"
    return f", regex_spans AS ({' UNION ALL '.join(parts)}), ner_spans AS ({none}){MERGE}"


@query("docs", sql=detected_sql())
def d0_all_patterns(docs):
    """All patterns and both dictionaries in one scan, deduplicated and merged without a model."""
    return S.all_detected(docs)


_SIGHT = r"[A-Z][a-z]{3,}"


@on_tables(
    "documents",
    sql=f"""WITH docs AS (SELECT doc_id, text FROM documents), p AS (
        SELECT doc_id, regexp_extract_all(text, '{_SIGHT}') AS m, string_split_regex(text, '{_SIGHT}') AS g FROM docs WHERE text IS NOT NULL),
      u AS (SELECT doc_id, unnest(m) AS text, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM p),
      e AS (SELECT *, sum(length(text) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS fin FROM u)
      SELECT doc_id, text, (fin - length(text))::INTEGER AS start_pos, fin::INTEGER AS end_pos FROM e""",
)
def d0_document_spans(documents):
    """Places of capitalised words in whole documents, however long."""
    found = S.regex_spans(documents, [P.Pattern("sight", "PERSON", 1.0, _SIGHT)])
    return found.select("doc_id", "text", "start_pos", "end_pos")


@on_tables("documents")
def d0_documents(documents):
    """All patterns and both dictionaries over whole documents. No twin: RE2's word edges are ASCII ones, which these texts don't fit; the patterns are tested against plain matches."""
    return S.all_detected(documents)


@on_tables(
    "documents",
    "benchmark",
    sql="""WITH terms AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:4], ' ') AS term FROM benchmark WHERE text IS NOT NULL),
      h AS (SELECT doc_id, term, string_split(text, term) AS g FROM documents JOIN terms ON contains(text, term) WHERE term <> ''),
      u AS (SELECT doc_id, term, unnest(range(1, len(g))) AS i, g FROM h)
      SELECT doc_id, term, (list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(term))::INTEGER AS start_pos,
        (list_sum(list_transform(g[1:i], lambda x: length(x))) + i * length(term))::INTEGER AS end_pos FROM u""",
)
def d23_many_terms(documents, benchmark):
    """The beginnings of all benchmark items, sought in all documents in one pass."""
    terms = benchmark.select(F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("term"), F.lit("ITEM").alias("entity_type")).where("term IS NOT NULL").distinct()
    return S.term_spans(documents, terms).drop("entity_type")
