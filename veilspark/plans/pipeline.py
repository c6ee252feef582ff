"""Queries of grouping, assignment and rewriting, up to whole rewritten documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookup
from ..functions import patterns as P
from ..operators import assign as A
from ..operators import grouping as G
from ..operators import rewrite as R
from ..operators import spans as S
from ..sources import cells as C
from ..sources.tables import kept
from .detection import _BY_NAME, _strip_sql, detected_sql, spans_sql
from .registry import on_tables, query
from .scalars import _FORM_SQL, _PREP

# -- grouping

_CLUSTER = f""", f AS (SELECT *, CASE entity_type WHEN 'PERSON' THEN {_strip_sql('text')} WHEN 'LOCATION' THEN lower(trim(regexp_replace(text, '{_PREP}', '')))
    ELSE lower(trim(text)) END AS form FROM spans),
  w AS (SELECT *, regexp_extract_all(form, '\\S+') AS w FROM f),
  k AS (SELECT *, len(w) AS n, lower(w[1]) AS a, lower(w[len(w)]) AS z FROM w),
  b AS (SELECT doc_id, z, list(DISTINCT a) AS bearers FROM k WHERE entity_type = 'PERSON' AND n >= 2 GROUP BY 1, 2),
  c AS (SELECT k.*, CASE WHEN entity_type <> 'PERSON' THEN 'f:' || form WHEN n >= 2 THEN 'm/' || a || '/' || k.z
      WHEN n = 1 AND len(bearers) = 1 THEN 'm/' || bearers[1] || '/' || k.z WHEN n = 1 AND bearers IS NULL THEN 's:' || k.z ELSE 'r:' || text END AS cluster
    FROM k LEFT JOIN b ON b.doc_id = k.doc_id AND b.z = k.z)"""
#: Every third mention is only a last name.
_MENTIONS = """SELECT doc_id, CASE WHEN entity_type = 'PERSON' AND start_pos % 3 = 0 THEN split_part(text, ' ', -1) ELSE text END AS text, entity_type, start_pos, end_pos FROM regex_spans"""


def _mentions(spans: DataFrame) -> DataFrame:
    return spans.sparkSession.sql(_MENTIONS.replace("FROM regex_spans", "FROM {t}"), t=spans)


@query(
    "regex_spans",
    sql=f""", spans AS ({_MENTIONS}) {_CLUSTER}
      SELECT doc_id, entity_type, arg_max(text, (length(text), -start_pos, -end_pos)) AS canonical, array_to_string(list_sort(list(DISTINCT text)), '|') AS variants,
        count(*) AS n, min(start_pos) AS first_pos FROM c GROUP BY doc_id, entity_type, cluster""",
)
def g5_variant_groups(spans):
    found = G.groups(_mentions(spans))
    return found.select("doc_id", "entity_type", "canonical", F.array_join("variants", "|").alias("variants"), "n", "first_pos")


@query(
    "regex_spans",
    sql=f""", spans AS ({_MENTIONS}) {_CLUSTER}
      SELECT doc_id, entity_type, arg_max(text, (length(text), -start_pos, -end_pos)) AS canonical, count(*) AS n FROM c
      WHERE entity_type IN ('PERSON', 'ORG') GROUP BY doc_id, entity_type, cluster""",
)
def g6_typed_groups(spans):
    return G.groups(S.only_types(_mentions(spans), ["PERSON", "ORG"])).select("doc_id", "entity_type", "canonical", "n")


@query("regex_spans", sql="SELECT doc_id, text, array_to_string(list_sort(list(start_pos)), ',') AS starts FROM regex_spans GROUP BY 1, 2")
def g7_exact_groups(spans):
    return G.exact_groups(spans).select("doc_id", "text", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query(
    "regex_spans",
    sql=f""", spans AS ({_MENTIONS}) {_CLUSTER}
      SELECT doc_id, entity_type, start_pos, end_pos, text, arg_max(text, (length(text), -start_pos, -end_pos)) OVER (PARTITION BY doc_id, entity_type, cluster) AS canonical FROM c""",
)
def g8_expanded_groups(spans):
    return G.expanded(G.groups(_mentions(spans))).select("doc_id", "entity_type", "start_pos", "end_pos", "text", "canonical")


# -- assignment

#: Mentions in documents of three people each; some are a first or a last name alone.
_PEOPLE = """SELECT {div} AS doc_id, {div} AS doc_ord, CAST(c_custkey % 3 + 1 AS INT) AS span_ord,
    CASE c_custkey % 5 WHEN 0 THEN {last} WHEN 1 THEN 'M. ' || {first} || ' ' || {last} WHEN 2 THEN {first} WHEN 3 THEN {first} || ' ' || {last} ELSE {city} END AS text,
    CASE WHEN c_custkey % 5 = 4 THEN 'LOCATION' ELSE 'PERSON' END AS entity_type FROM customer"""


def _people_sql(d: str) -> str:
    from . import fixtures as X

    k = "c_custkey"
    suffix = f"CAST(({k} * 13) % 40 AS {'STRING' if d == 'spark' else 'VARCHAR'})"
    first = f"{X.pick(d, X.FIRST, f'{k} * 7')} || {suffix}"
    last = f"{X.pick(d, X.LAST, f'{k} * 11')} || {suffix}"
    return _PEOPLE.format(div=X.div(d, k, 3), first=first, last=last, city=X.pick(d, X.CITIES, k))


from . import fixtures as _X  # noqa: E402

_X.FIXTURES["people"] = _people_sql

NEUTRAL = f""", t AS (SELECT *, CASE WHEN entity_type = 'LOCATION' THEN text ELSE {_strip_sql('text')} END AS key FROM people),
  m AS (SELECT *, string_split(key, ' ') AS w, (doc_ord, span_ord) AS pl FROM t),
  k AS (SELECT key, arg_min(entity_type, pl) AS kind, arg_min(w, pl) AS w, min(pl) AS pl FROM m GROUP BY 1),
  parts AS (
    SELECT key AS bearer, pl, 0 AS role, w[1] AS part FROM k WHERE kind = 'PERSON' AND len(w) = 2
    UNION ALL SELECT key, pl, 1, w[2] FROM k WHERE kind = 'PERSON' AND len(w) = 2),
  words AS (SELECT doc_ord, key, min(span_ord) AS span_ord FROM m WHERE entity_type = 'PERSON' AND len(w) = 1 GROUP BY 1, 2),
  same AS (
    SELECT x.doc_ord, x.key, arg_min((p.bearer, p.role), (p.role, p.pl)) AS s FROM words x
    JOIN parts p ON p.part = x.key AND p.pl[1] = x.doc_ord AND p.pl < (x.doc_ord, x.span_ord) GROUP BY 1, 2),
  made AS (
    SELECT x.key, min((x.doc_ord, x.span_ord)) AS pl FROM words x LEFT JOIN same s ON s.doc_ord = x.doc_ord AND s.key = x.key WHERE s.key IS NULL GROUP BY 1),
  known AS (SELECT d.key, arg_min((p.bearer, p.role), (p.role, p.pl)) AS s FROM made d JOIN parts p ON p.part = d.key AND p.pl < d.pl GROUP BY 1),
  counted AS (
    SELECT key, kind, pl FROM k WHERE NOT (kind = 'PERSON' AND len(w) = 1)
    UNION ALL SELECT d.key, 'PERSON', d.pl FROM made d LEFT JOIN known n ON n.key = d.key WHERE n.key IS NULL),
  ids AS (SELECT key, CASE kind WHEN 'PERSON' THEN 'PER' ELSE 'LOC' END || '-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS id
    FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY pl, key) AS n FROM counted) z),
  shared AS (SELECT n.key, i.id || CASE n.s[2] WHEN 0 THEN '-P' ELSE '-N' END AS id FROM known n JOIN ids i ON i.key = n.s[1]),
  indoc AS (SELECT s.doc_ord, s.key, i.id || CASE s.s[2] WHEN 0 THEN '-P' ELSE '-N' END AS id FROM same s JOIN ids i ON i.key = s.s[1]),
  out AS (SELECT m.doc_id, m.span_ord, m.text, m.entity_type, m.key,
    CASE WHEN m.entity_type = 'PERSON' AND len(m.w) = 1 THEN CASE
      WHEN d.pl IS NOT NULL AND m.doc_ord > d.pl[1] THEN coalesce(h.id, i.id)
      WHEN j.id IS NOT NULL THEN j.id ELSE coalesce(h.id, i.id) END ELSE i.id END AS pseudonym
    FROM m LEFT JOIN ids i ON i.key = m.key LEFT JOIN made d ON d.key = m.key LEFT JOIN shared h ON h.key = m.key
    LEFT JOIN indoc j ON j.key = m.key AND j.doc_ord = m.doc_ord)"""


@query("people", sql=f"{NEUTRAL} SELECT * FROM out")
def a12_neutral_ids(people):
    return A.neutral_ids(people).select("doc_id", "span_ord", "text", "entity_type", "key", "pseudonym")


@query(
    "people",
    sql=f"""{NEUTRAL}, first AS (SELECT key, pl FROM k WHERE NOT (kind = 'PERSON' AND len(w) = 1) UNION ALL SELECT key, pl FROM made),
      n AS (SELECT o.*, string_split(o.key, ' ') AS w, o.entity_type = 'PERSON' AS person FROM first f JOIN out o ON o.key = f.key AND o.doc_id = f.pl[1] AND o.span_ord = f.pl[2])
      SELECT substr(sha256(key), 1, 32) AS id, entity_type, CASE WHEN person THEN w[1] END AS first_name, CASE WHEN person THEN w[2] END AS last_name, key AS full_name,
        CASE WHEN person AND len(w) > 1 THEN pseudonym || '-P' WHEN person THEN pseudonym END AS pseudonym_first,
        CASE WHEN person AND len(w) > 1 THEN pseudonym || '-N' END AS pseudonym_last, pseudonym AS pseudonym_full, 'neutral_id' AS theme FROM n""",
)
def a3_new_mappings(people):
    return A.new_mappings(A.neutral_ids(people))


#: As NEUTRAL, against stored mappings: a name that has one keeps it, a word may be a stored person's part, numbers go on.
RESOLVED_WITH_MAPPINGS = f""", t AS (SELECT *, CASE WHEN entity_type = 'LOCATION' THEN text ELSE {_strip_sql('text')} END AS key FROM people),
  m AS (SELECT t.*, string_split(key, ' ') AS w, (doc_ord, span_ord) AS pl, mp.pseudonym_full AS old FROM t LEFT JOIN mappings mp ON mp.full_name = t.key),
  fresh AS (SELECT * FROM m WHERE old IS NULL),
  k AS (SELECT key, arg_min(entity_type, pl) AS kind, arg_min(w, pl) AS w, min(pl) AS pl FROM fresh GROUP BY 1),
  parts AS (
    SELECT key AS bearer, pl, 0 AS role, w[1] AS part FROM k WHERE kind = 'PERSON' AND len(w) = 2
    UNION ALL SELECT key, pl, 1, w[2] FROM k WHERE kind = 'PERSON' AND len(w) = 2),
  od AS (SELECT part, arg_min(given, (role, given)) AS given FROM (
      SELECT first_name AS part, 0 AS role, pseudonym_full || '-P' AS given FROM mappings WHERE entity_type = 'PERSON' AND last_name IS NOT NULL
      UNION ALL SELECT last_name, 1, pseudonym_full || '-N' FROM mappings WHERE entity_type = 'PERSON' AND last_name IS NOT NULL) x GROUP BY 1),
  words AS (SELECT doc_ord, key, min(span_ord) AS span_ord FROM fresh WHERE entity_type = 'PERSON' AND len(w) = 1 GROUP BY 1, 2),
  same AS (
    SELECT x.doc_ord, x.key, arg_min((p.bearer, p.role), (p.role, p.pl)) AS s FROM words x
    JOIN parts p ON p.part = x.key AND p.pl[1] = x.doc_ord AND p.pl < (x.doc_ord, x.span_ord) GROUP BY 1, 2),
  made AS (
    SELECT x.key, min((x.doc_ord, x.span_ord)) AS pl FROM words x LEFT JOIN same s ON s.doc_ord = x.doc_ord AND s.key = x.key WHERE s.key IS NULL GROUP BY 1),
  known AS (SELECT d.key, arg_min((p.bearer, p.role), (p.role, p.pl)) AS s FROM made d JOIN parts p ON p.part = d.key AND p.pl < d.pl GROUP BY 1),
  counted AS (
    SELECT key, kind, pl FROM k WHERE NOT (kind = 'PERSON' AND len(w) = 1)
    UNION ALL SELECT d.key, 'PERSON', d.pl FROM made d LEFT JOIN known n ON n.key = d.key LEFT JOIN od ON od.part = d.key WHERE n.key IS NULL AND od.part IS NULL),
  bases AS (SELECT split_part(pseudonym_full, '-', 1) AS pre, max(split_part(pseudonym_full, '-', 2)::INTEGER) AS base FROM mappings GROUP BY 1),
  ids AS (SELECT key, pl, pre || '-' || lpad((n + coalesce(base, 0))::VARCHAR, greatest(3, length((n + coalesce(base, 0))::VARCHAR))::INTEGER, '0') AS id
    FROM (SELECT *, CASE kind WHEN 'PERSON' THEN 'PER' ELSE 'LOC' END AS pre, row_number() OVER (PARTITION BY kind ORDER BY pl, key) AS n FROM counted) z LEFT JOIN bases USING (pre)),
  shared AS (SELECT d.key, coalesce(od.given, i.id || CASE n.s[2] WHEN 0 THEN '-P' ELSE '-N' END) AS id
    FROM made d LEFT JOIN od ON od.part = d.key LEFT JOIN known n ON n.key = d.key LEFT JOIN ids i ON i.key = n.s[1]),
  indoc AS (SELECT s.doc_ord, s.key, i.id || CASE s.s[2] WHEN 0 THEN '-P' ELSE '-N' END AS id FROM same s JOIN ids i ON i.key = s.s[1])"""


@query(
    "people",
    "mappings",
    sql=f"""{RESOLVED_WITH_MAPPINGS}
      SELECT m.doc_id, m.span_ord, m.text, m.entity_type, m.key, CASE WHEN m.old IS NOT NULL THEN m.old WHEN m.entity_type = 'PERSON' AND len(m.w) = 1 THEN CASE
        WHEN d.pl IS NOT NULL AND m.doc_ord > d.pl[1] THEN coalesce(h.id, i.id)
        WHEN j.id IS NOT NULL THEN j.id ELSE coalesce(h.id, i.id) END ELSE i.id END AS pseudonym,
        m.old IS NULL AND coalesce(coalesce(d.pl, i.pl) = m.pl, false) AS is_new
      FROM m LEFT JOIN ids i ON i.key = m.key LEFT JOIN made d ON d.key = m.key LEFT JOIN shared h ON h.key = m.key LEFT JOIN indoc j ON j.key = m.key AND j.doc_ord = m.doc_ord""",
)
def a1_resolve_with_mappings(people, mappings):
    """Against stored mappings, whose numbers go on."""
    old = mappings.withColumns({"pseudonym_first": F.concat("pseudonym_full", F.lit("-P")), "pseudonym_last": F.concat("pseudonym_full", F.lit("-N"))})
    return A.neutral_ids(people, old).select("doc_id", "span_ord", "text", "entity_type", "key", "pseudonym", "is_new")


@query(
    "mappings",
    sql="""SELECT CASE split_part(pseudonym_full, '-', 1) WHEN 'PER' THEN 'PERSON' WHEN 'LOC' THEN 'LOCATION' ELSE 'ORG' END AS entity_type,
      max(split_part(pseudonym_full, '-', 2)::INTEGER) AS base FROM mappings GROUP BY 1""",
)
def a13_counters(mappings):
    return A.counters(mappings)


def _pool(spark):
    return lookup.pool(spark, lookup.pool_rows(lookup.made_up_library()))


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) v({columns})"


def _padded(n: str) -> str:
    return f"lpad(({n})::VARCHAR, greatest(3, length(({n})::VARCHAR))::INTEGER, '0')"


def _by_hash(secret: str, value: str) -> str:
    """The order of a keyed hash; secret and value are SQL."""
    return f"ORDER BY sha256({secret} || '|' || {value}), {value}"


def _library_sql() -> str:
    """As library_ids() without stored mappings: parts and names by rank, numbers where the pool ends."""
    pool = _values([row[1:] for row in lookup.pool_rows(lookup.made_up_library())], "kind, category, ord, value")
    genders = _values([(g, v) for g, values in lookup.GENDERS.items() for v in values], "gender, value")
    word = "string_split(value, ' ')[1]"
    return f"""{NEUTRAL}, pool AS ({pool}), gen AS (SELECT value AS name, list(DISTINCT gender) AS g FROM ({genders}) x GROUP BY 1),
      own AS (SELECT key, kind, pl, string_split(key, ' ') AS w FROM counted),
      pe AS (SELECT key, pl, CASE WHEN len(w) > 1 THEN array_to_string(w[1:len(w) - 1], ' ') ELSE w[1] END AS first, CASE WHEN len(w) > 1 THEN w[len(w)] ELSE chr(0) || w[1] END AS last FROM own WHERE kind = 'PERSON'),
      fi AS (SELECT value, CASE WHEN list_contains(g, 'ambiguous') THEN NULL WHEN list_contains(g, 'male') THEN 'male' WHEN list_contains(g, 'female') THEN 'female' END AS gender
        FROM (SELECT DISTINCT first AS value FROM pe) q LEFT JOIN gen ON name = split_part(upper(substr({word}, 1, 1)) || lower(substr({word}, 2)), '-', 1)),
      fp AS (SELECT value, arg_min(category, ord) AS category FROM pool WHERE kind = 'first' GROUP BY 1),
      gr AS (SELECT value, gender, row_number() OVER (PARTITION BY gender {_by_hash("'secret/' || gender || '/real'", "value")}) AS n FROM fi WHERE gender IS NOT NULL),
      gp AS (SELECT value, category, row_number() OVER (PARTITION BY category {_by_hash("'secret/' || category", "value")}) AS n FROM fp WHERE category IN ('male', 'female')),
      gm AS (SELECT gr.value, gp.value AS pseudonym FROM gr JOIN gp ON gp.category = gr.gender AND gp.n = gr.n),
      rr AS (SELECT value, row_number() OVER ({_by_hash("'secret/real'", "value")}) AS n FROM fi WHERE value NOT IN (SELECT value FROM gm)),
      rp AS (SELECT value AS pseudonym, row_number() OVER ({_by_hash("'secret'", "value")}) AS n FROM fp WHERE value NOT IN (SELECT pseudonym FROM gm)),
      lr AS (SELECT value, row_number() OVER ({_by_hash("'secret/real'", "value")}) AS n FROM (SELECT DISTINCT last AS value FROM pe) q),
      lp AS (SELECT value AS pseudonym, row_number() OVER ({_by_hash("'secret'", "value")}) AS n FROM (SELECT DISTINCT value FROM pool WHERE kind = 'last') q),
      bo AS (SELECT 0 AS role, value, pseudonym FROM gm UNION ALL SELECT 0, value, pseudonym FROM rr LEFT JOIN rp USING (n) UNION ALL SELECT 1, value, pseudonym FROM lr LEFT JOIN lp USING (n)),
      nb AS (SELECT role, value, row_number() OVER ({_by_hash("'secret/rest'", "role || '|' || value")}) AS n FROM bo WHERE pseudonym IS NULL),
      bb AS (SELECT role, value, coalesce(pseudonym, 'Person-' || {_padded('n')}) AS p FROM bo LEFT JOIN nb USING (role, value)),
      pf AS (SELECT pe.key, a.p AS p1, b.p AS p2, a.p || ' ' || b.p AS whole, row_number() OVER (PARTITION BY a.p || ' ' || b.p ORDER BY pl, pe.key) AS r
        FROM pe JOIN bb a ON a.role = 0 AND a.value = pe.first JOIN bb b ON b.role = 1 AND b.value = pe.last),
      ba AS (SELECT coalesce(max(nullif(regexp_extract(p, '^Person-([0-9]+)$', 1), '')::INTEGER), 0) AS base FROM bb),
      nu AS (SELECT key, 'Person-' || {_padded(f"base + row_number() OVER ({_by_hash(chr(39) + 'secret/rest' + chr(39), chr(39) + '2|' + chr(39) + ' || key')})")} AS p FROM pf, ba WHERE r > 1),
      re AS (SELECT key, CASE WHEN nu.key IS NULL THEN p1 END AS p1, coalesce(nu.p, p2) AS p2, coalesce(nu.p, whole) AS whole FROM pf LEFT JOIN nu USING (key)),
      kr AS (SELECT key, row_number() OVER ({_by_hash("'secret/real'", "key")}) AS n FROM own WHERE kind = 'LOCATION'),
      kp AS (SELECT value AS pseudonym, row_number() OVER ({_by_hash("'secret'", "value")}) AS n FROM (SELECT DISTINCT value FROM pool WHERE kind = 'location') q),
      km AS (SELECT key, pseudonym FROM kr LEFT JOIN kp USING (n)),
      kn AS (SELECT key, row_number() OVER ({_by_hash("'secret/rest'", "'0|' || key")}) AS n FROM km WHERE pseudonym IS NULL)
      SELECT key, 'PERSON' AS entity_type, p1 AS pseudonym_first, p2 AS pseudonym_last, whole AS pseudonym_full FROM re
      UNION ALL SELECT key, 'LOCATION', NULL, NULL, coalesce(pseudonym, 'Location-' || {_padded('n')}) FROM km LEFT JOIN kn USING (key)
      UNION ALL SELECT k.key, 'PERSON', CASE WHEN k.s[2] = 0 THEN r.p1 END, CASE WHEN k.s[2] = 1 THEN r.p2 END, CASE WHEN k.s[2] = 0 THEN r.p1 ELSE r.p2 END FROM known k JOIN re r ON r.key = k.s[1]"""


@query("people", sql=_library_sql())
def a7_library_names(people):
    """Names from a library, by a keyed order."""
    spark = people.sparkSession
    return A.library_names(people, _pool(spark), "plain", "secret", lookup.genders(spark))


@query(
    "mappings",
    sql="""SELECT 'plain' AS theme, count(DISTINCT pseudonym_full) AS used, 500 * 500 + 130 AS capacity,
      round(count(DISTINCT pseudonym_full) / 250130.0, 9) AS share, count(DISTINCT pseudonym_full) / 250130.0 >= 0.8 AS warn FROM mappings WHERE theme = 'plain'""",
)
def a14_exhaustion(mappings):
    return A.exhaustion(mappings, _pool(mappings.sparkSession), "plain").withColumn("share", F.round("share", 9))


@query("mappings", sql="SELECT full_name AS value, 'Org-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS pseudonym FROM (SELECT full_name, 7 + row_number() OVER (ORDER BY full_name) AS n FROM mappings WHERE entity_type = 'ORG') o")
def a11_fallback_names(mappings):
    used = mappings.sparkSession.sql("SELECT * FROM VALUES ('Org-007'), ('Person-900'), ('Org-x') t(used)")
    return A.fallback_names(mappings.where("entity_type = 'ORG'").select(F.col("full_name").alias("value")), "ORG", used)


# -- rewriting


def _titled_spans(docs: DataFrame) -> DataFrame:
    spans = S.regex_spans(docs, [_BY_NAME["titles"]])
    from pyspark.sql import Window

    return spans.withColumn("span_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_pos")))


def pseudonymised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with their spans (doc_id, span_ord, text, entity_type, start_pos, end_pos) rewritten under neutral ids."""
    from ..functions import text as T

    spans = kept(spans)  # many joins read it
    ids = A.neutral_ids(spans).select("doc_id", "span_ord", "pseudonym")
    rows = spans.join(ids.hint("merge"), ["doc_id", "span_ord"], "left")
    rows = A.of_texts(rows, {"prefix": T.replacement_prefix("_text", "_type")})
    rows = rows.withColumn("replacement", F.concat("prefix", "pseudonym")).select("doc_id", "start_pos", "end_pos", "replacement")
    return R.rewritten(docs, rows)


_TITLED = spans_sql(_BY_NAME["titles"].regex)
REWRITE = f""", s AS (SELECT doc_id, text, start_pos, end_pos, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) AS span_ord FROM {_TITLED}),
  t AS (SELECT *, {_strip_sql('text')} AS key FROM s),
  people AS (SELECT doc_id, doc_id AS doc_ord, span_ord, text, 'PERSON' AS entity_type FROM s),
  {NEUTRAL.replace(', t AS (SELECT', 'tt AS (SELECT', 1).replace('FROM t)', 'FROM tt)', 1).lstrip(', ')},
  r AS (SELECT s.*, substr(s.text, 1, strpos(s.text, o.key) - 1) || o.pseudonym AS replacement FROM s JOIN out o ON o.doc_id = s.doc_id AND o.span_ord = s.span_ord),
  g AS (SELECT d.doc_id, d.text, coalesce(list(r.start_pos ORDER BY r.start_pos) FILTER (r.start_pos IS NOT NULL), []) AS a, coalesce(list(r.end_pos ORDER BY r.start_pos) FILTER (r.start_pos IS NOT NULL), []) AS b,
    coalesce(list(r.replacement ORDER BY r.start_pos) FILTER (r.start_pos IS NOT NULL), []) AS x FROM docs d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY 1, 2)
  SELECT doc_id, coalesce(array_to_string(list_transform(range(1, len(a) + 1), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE b[i - 1] + 1 END, a[i] - CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END) || x[i]), ''), '')
    || substr(text, CASE WHEN len(b) = 0 THEN 1 ELSE b[len(b)] + 1 END) AS text, len(a)::INTEGER AS n_replaced FROM g"""


@query("docs", sql=REWRITE)
def r2_rewritten_documents(docs):
    """From text to pseudonymised text: titles, neutral ids, prefixes kept, spans replaced."""
    return pseudonymised(docs, _titled_spans(docs))


#: Spans in turn by place, longer ones first: one that overlaps none kept before is kept.
_RESOLVED = """so AS (SELECT doc_id, list({'a': start_pos, 'b': end_pos, 'x': replacement} ORDER BY start_pos, end_pos DESC, replacement) AS l FROM r WHERE replacement IS NOT NULL GROUP BY 1),
  wa AS (SELECT doc_id, 0 AS i, 0 AS fin, CAST([] AS INTEGER[]) AS kept FROM so UNION ALL
    SELECT w.doc_id, w.i + 1, CASE WHEN s.l[w.i + 1].a >= w.fin THEN s.l[w.i + 1].b ELSE w.fin END,
      CASE WHEN s.l[w.i + 1].a >= w.fin THEN list_append(w.kept, (w.i + 1)::INTEGER) ELSE w.kept END
    FROM wa w JOIN so s ON s.doc_id = w.doc_id WHERE w.i < len(s.l)),
  ke AS (SELECT w.doc_id, list_transform(w.kept, lambda k: s.l[k]) AS l FROM wa w JOIN so s ON s.doc_id = w.doc_id WHERE w.i = len(s.l)),
  g AS (SELECT d.doc_id, d.text, coalesce(list_transform(l, lambda s: s.a), []) AS a, coalesce(list_transform(l, lambda s: s.b), []) AS b, coalesce(list_transform(l, lambda s: s.x), []) AS x
    FROM docs d LEFT JOIN ke ON ke.doc_id = d.doc_id)"""
_SPLICED = REWRITE[REWRITE.index("SELECT doc_id, coalesce(array_to_string(") :]
_BARE = _strip_sql(_strip_sql("text"))
_ALL_KEYS = f"CASE entity_type WHEN 'LOCATION' THEN trim(regexp_replace({_BARE}, '{_PREP}', '')) ELSE {_BARE} END"
_ALL_NEUTRAL = NEUTRAL.replace(", t AS (SELECT", "tt AS (SELECT", 1).replace("FROM t)", "FROM tt)", 1).lstrip(", ")
_ALL_NEUTRAL = _ALL_NEUTRAL.replace(f"CASE WHEN entity_type = 'LOCATION' THEN text ELSE {_strip_sql('text')} END AS key", f"{_ALL_KEYS} AS key", 1)
_ALL_NEUTRAL = _ALL_NEUTRAL.replace("CASE kind WHEN 'PERSON' THEN 'PER' ELSE 'LOC' END", "CASE kind WHEN 'PERSON' THEN 'PER' WHEN 'LOCATION' THEN 'LOC' ELSE 'ORG' END", 1)


def _all_rewritten_sql() -> str:
    """As r2_rewritten_documents, over all spans. CTEs of the detection have names of their own."""
    found = detected_sql()
    for name in ("n", "d", "r", "p", "u", "f"):
        found = re.sub(rf"\b{name} AS \(", f"z{name} AS (", found)
        found = re.sub(rf"\b(FROM|JOIN) {name}\b(?! AS)", rf"\1 z{name} {name}", found)
    head, tail = found[: found.rindex("SELECT doc_id, (row_number()")].rstrip(), found[found.rindex("SELECT doc_id, (row_number()") :]
    people = "people AS (SELECT doc_id, doc_id AS doc_ord, span_ord, text, entity_type FROM sp)"
    bare = _BARE.replace("text", "s.text")
    before = lambda whole: f"CASE WHEN o.key <> {whole} AND o.key <> '' AND strpos({whole}, o.key) > 1 THEN substr({whole}, 1, strpos({whole}, o.key) - 1) ELSE '' END"
    prefix = f"CASE s.entity_type WHEN 'PERSON' THEN {before('s.text')} WHEN 'LOCATION' THEN {before(bare)} ELSE '' END"
    replaced = f"r AS (SELECT s.*, {prefix} || o.pseudonym AS replacement FROM sp s JOIN out o ON o.doc_id = s.doc_id AND o.span_ord = s.span_ord)"
    return f"{head}, sp AS ({tail}), {people}, {_ALL_NEUTRAL}, {replaced}, {_RESOLVED} {_SPLICED}"


@query("docs", sql=_all_rewritten_sql(), recursive=True)
def r2_all_patterns_rewritten(docs):
    """The same with every pattern and both dictionaries, overlaps resolved."""
    return pseudonymised(docs, S.all_detected(docs))


_MARKED = r"[A-Z][a-z]{3,}"
_MARKED_RULE = P.Pattern("marked", "PERSON", 1.0, _MARKED)


@on_tables(
    "documents",
    sql=f"SELECT doc_id, regexp_replace(text, '{_MARKED}', '[~]', 'g') AS text, coalesce(len(regexp_extract_all(text, '{_MARKED}')), 0)::INTEGER AS n_replaced FROM documents",
)
def r1_marked_documents(documents):
    """Whole documents, however long, with each capitalised word replaced."""
    spans = S.regex_spans(documents, [_MARKED_RULE], engine="arrow")
    return R.rewritten(documents, spans.withColumn("replacement", F.lit("[~]")))


@query(
    "cells",
    sql=f""", c AS (SELECT row, col, 'voir M. Dubois ' || value AS text FROM cells WHERE trim(value) <> '')
      SELECT row, col, regexp_replace(text, 'M\\. Dubois( [A-Z][a-z]+)?', 'X', 'g') AS text, len(regexp_extract_all(text, 'M\\. Dubois( [A-Z][a-z]+)?'))::INTEGER AS n_replaced FROM c""",
)
def r3_rewritten_cells(cells):
    rows = cells.where("trim(value) <> ''").select("row", "col", F.concat(F.lit("voir M. Dubois "), "value").alias("text"))
    spans = S.regex_spans(rows, [_BY_NAME["titles"]], ["row", "col"]).withColumn("replacement", F.lit("X"))
    return R.rewritten(rows, spans, ["row", "col"])


@query("docs", sql="SELECT doc_id, replace(replace(text, 'Cabinet Mercier', '[ORG]'), 'Paris', '[LOCATION]') AS text, (len(regexp_extract_all(text, 'Cabinet Mercier|Paris')))::INTEGER AS n_replaced FROM docs")
def r4_literal_replacement(docs):
    spans = S.literal_spans(docs, [("Cabinet Mercier", "ORG"), ("Paris", "LOCATION")])
    return R.rewritten(docs, spans.withColumn("replacement", F.concat(F.lit("["), "entity_type", F.lit("]"))))


@query(
    "gold",
    recursive=True,
    sql=""", c AS (SELECT doc_id, list({'a': start_pos, 'n': end_pos - start_pos, 'b': end_pos, 't': entity_type, 'x': entity_text} ORDER BY start_pos, end_pos - start_pos, end_pos, entity_type, entity_text) AS l
        FROM (SELECT DISTINCT doc_id, start_pos, end_pos, entity_type, entity_text FROM gold) d GROUP BY 1),
      st AS (SELECT doc_id, 0 AS i, CAST([] AS INTEGER[]) AS kept FROM c UNION ALL
        SELECT doc_id, i + 1, CASE WHEN f IS NULL THEN list_append(kept, i + 1) WHEN l[i + 1].n < l[f].n AND l[i + 1].t = l[f].t THEN list_append(list_filter(kept, lambda k: k <> f), i + 1) ELSE kept END
        FROM (SELECT s.*, c.l, list_filter(s.kept, lambda k: c.l[k].a < c.l[s.i + 1].b AND c.l[s.i + 1].a < c.l[k].b)[1] AS f FROM st s JOIN c USING (doc_id) WHERE s.i < len(c.l)) y),
      e AS (SELECT doc_id, l, unnest(kept) AS k FROM st JOIN c USING (doc_id) WHERE i = len(l))
      SELECT doc_id, l[k].a AS start_pos, l[k].b AS end_pos, l[k].t AS entity_type, l[k].x AS entity_text FROM e""",
)
def r5_pruned_annotations(gold):
    """An order-dependent fold over each document's annotations."""
    return R.pruned_annotations(gold.distinct())


# -- cells


@query(
    "cells",
    sql="SELECT row, col, chr(64 + col) AS column_letter, value, chr(64 + col) || row::VARCHAR AS cell_ref FROM cells WHERE trim(value) <> ''",
)
def s7_cells(cells):
    wide = C.grid(cells, [], 4)
    found = C.cells_of(wide, [], ["c1", "c2", "c3", "c4"], "row")
    return found.select("row", "col", "column_letter", "value", "cell_ref")


@query("cells", sql="SELECT row, " + ", ".join(f"coalesce(max(value) FILTER (col = {i} AND trim(value) <> ''), '') AS c{i}" for i in range(1, 6)) + " FROM cells GROUP BY row")
def s11_grid(cells):
    return C.grid(cells.where("trim(value) <> ''"), [], 5)


@query(
    "cells",
    sql="SELECT row, " + " || chr(9) || ".join(f"coalesce(max(value) FILTER (col = {i} AND trim(value) <> ''), '')" for i in range(1, 5)) + " AS text FROM cells GROUP BY row",
)
def s12_row_texts(cells):
    return C.row_texts(cells.where("trim(value) <> ''").withColumn("sheet", F.lit("s")), ["sheet"]).drop("sheet")


del P, _FORM_SQL
