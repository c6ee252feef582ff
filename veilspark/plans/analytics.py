"""Queries of the mapping table, the audit log, the review and the evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as U
from ..operators import evaluate as E
from ..operators import review as V
from ..operators import store as M
from ..sources import files
from .registry import query
from .scalars import _CASES, _FLAGS

# -- mappings


@query("mappings", sql="SELECT id, full_name FROM mappings WHERE full_name IN (SELECT max(full_name) FROM mappings)")
def m1_by_full_name(mappings):
    name = mappings.agg(F.max("full_name")).first()[0]
    return M.by_full_name(mappings, name).select("id", "full_name")


@query("mappings", sql="SELECT id, full_name FROM mappings WHERE entity_type = 'PERSON' AND first_name = 'Marie'")
def m2_by_component(mappings):
    return M.by_component(mappings, "Marie", "first_name").select("id", "full_name")


#: New rows: some names exist, some stand twice.
_NEW = "SELECT md5(id) AS id, entity_type, first_name, last_name, CASE WHEN theme = 'star' THEN full_name WHEN theme = 'plain' THEN full_name || ' bis' ELSE 'same ' || entity_type END AS full_name, pseudonym_full, theme, confidence_score, is_ambiguous FROM mappings"


def _new(mappings):
    return mappings.sparkSession.sql(_NEW.replace("FROM mappings", "FROM {t}"), t=mappings)


@query("mappings", sql=f", n AS ({_NEW}), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY id) = 1) SELECT * FROM mappings UNION ALL SELECT * FROM f WHERE full_name NOT IN (SELECT full_name FROM mappings)")
def m4_insert_if_absent(mappings):
    return M.saved(mappings, _new(mappings))


@query("mappings", sql=f", n AS ({_NEW}), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY id) = 1) SELECT m.* FROM mappings m WHERE m.full_name NOT IN (SELECT full_name FROM f) UNION ALL SELECT coalesce(m.id, f.id), f.* EXCLUDE (id) FROM f LEFT JOIN mappings m USING (full_name)")
def q12_import_replacing(mappings):
    return M.replaced(mappings, _new(mappings))


@query("mappings", sql="SELECT id, full_name FROM mappings WHERE entity_type = 'LOCATION' AND is_ambiguous")
def m5_find_all(mappings):
    return M.find_all(mappings, "LOCATION", True).select("id", "full_name")


@query("mappings", sql="SELECT id, full_name FROM mappings WHERE id NOT IN (SELECT min(id) FROM mappings)")
def m6_deleted(mappings):
    left, _ = M.deleted(mappings, mappings.agg(F.min("id")).first()[0])
    return left.select("id", "full_name")


@query("mappings", sql="SELECT id, full_name, pseudonym_full FROM mappings WHERE lower(full_name) LIKE '%dubois1%' OR lower(pseudonym_full) LIKE '%dubois1%'")
def m7_search(mappings):
    return M.search(mappings, "DUBOIS1").select("id", "full_name", "pseudonym_full")


_META = "SELECT 'file:/d/' || CAST(event_id % 50 AS {0}) || ':hash' AS key, CASE WHEN operation_type = 'error' THEN NULL ELSE id END AS value, ts AS updated_at FROM {1}"


@query(
    "operations",
    sql=f", m AS ({_META.format('VARCHAR', 'operations')}) SELECT key, value FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, value DESC NULLS LAST) = 1) l WHERE value IS NOT NULL",
)
def m9_metadata(log):
    rows = log.sparkSession.sql(_META.format("STRING", "{t}"), t=log)
    return M.upserted(rows.limit(0), rows).select("key", "value")


@query(
    "docs",
    sql="SELECT doc_id FROM (SELECT doc_id, '/d/' || (doc_id % 40)::VARCHAR AS path, sha256(text) AS h FROM docs) f WHERE NOT (doc_id < 40 AND doc_id % 2 = 0) AND NOT EXISTS (SELECT 1 FROM docs o WHERE o.doc_id < 40 AND o.doc_id % 2 = 0 AND '/d/' || (o.doc_id % 40)::VARCHAR = f.path AND sha256(o.text) = f.h)",
)
def m9_unprocessed(docs):
    found = docs.select("doc_id", F.concat(F.lit("/d/"), (F.col("doc_id") % 40).cast("string")).alias("path"), F.col("text").alias("content"))
    done = M.file_hashes(found.where("doc_id < 40 AND doc_id % 2 = 0")).withColumn("updated_at", F.lit(0))
    return M.unprocessed(found, done).select("doc_id")


_TWICE = "SELECT full_name, pseudonym_full FROM mappings UNION ALL SELECT full_name, pseudonym_full || 'x' FROM mappings WHERE is_ambiguous"


@query(
    "mappings",
    sql=f", t AS ({_TWICE}) SELECT 'full_name' AS kind, full_name AS value, count(*) AS n FROM t GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'pseudonym', pseudonym_full, count(*) FROM t GROUP BY 2 HAVING count(*) > 1",
)
def m12_duplicates(mappings):
    return M.duplicates(mappings.sparkSession.sql(_TWICE.replace("FROM mappings", "FROM {t}"), t=mappings))


_TWICE_TYPED = _TWICE.replace("full_name, ", "entity_type, full_name, ")


@query(
    "mappings",
    "operations",
    sql=f""", t AS ({_TWICE_TYPED}), p AS (SELECT * FROM t WHERE entity_type = 'PERSON')
      SELECT 'mappings' AS measure, count(*) AS n FROM t
      UNION ALL SELECT 'shared_pseudonyms', count(*) FROM (SELECT pseudonym_full FROM p GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'shared_names', count(*) FROM (SELECT full_name FROM p GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'operations', count(*) FROM operations
      UNION ALL SELECT 'succeeded', count(*) FROM operations WHERE success
      UNION ALL SELECT 'failed', count(*) FROM operations WHERE NOT success""",
)
def m12_consistency(mappings, log):
    rows = mappings.sparkSession.sql(_TWICE_TYPED.replace("FROM mappings", "FROM {t}"), t=mappings)
    return M.consistency(rows, log)


@query("mappings", sql="SELECT id, full_name, entity_type, theme FROM mappings")
def c1_encryption_round_trip(mappings):
    """Encrypted and decrypted again; ciphertexts depend on the keys and aren't shown."""
    from ..functions import crypto

    keys = crypto.derive("a passphrase of the test", b"salt" * 8, 1000)
    return M.decrypted(M.encrypted(mappings, keys), keys).select("id", "full_name", "entity_type", "theme")


@query("mappings", sql="SELECT id, entity_type, full_name, coalesce(first_name, '') AS first_name, coalesce(last_name, '') AS last_name, pseudonym_full, theme, is_ambiguous::VARCHAR AS is_ambiguous, coalesce(round(confidence_score * 100)::INTEGER::VARCHAR, '') AS confidence FROM mappings")
def s19_mapping_export(mappings):
    confidence = F.round(F.col("confidence_score") * 100).cast("int")
    rows = mappings.select("id", "entity_type", "full_name", "first_name", "last_name", "pseudonym_full", "theme", "is_ambiguous", confidence.alias("confidence"))
    return U.exported_csv(rows)


@query("mappings", sql="SELECT substr(id, 1, 8) AS id, full_name, entity_type, pseudonym_full FROM mappings")
def s20_short_export(mappings):
    return U.listed(mappings).drop("n_docs")


@query("paths", sql=r"SELECT path FROM paths WHERE lower(regexp_extract(path, '[^/]+(\.[^./]*)$', 1)) IN ('.txt', '.md', '.pdf', '.docx', '.xlsx', '.csv') AND path NOT LIKE '%\_pseudonymized%' ESCAPE '\'")
def s13_discovery(paths):
    return files.chosen(paths)


# -- the audit log

_TEN = "ORDER BY ts DESC, id LIMIT 10"


@query("operations", sql=f"SELECT id, ts, operation_type, entity_count FROM operations WHERE operation_type = 'purchase' AND success AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20' {_TEN}")
def q1_find_operations(log):
    return U.operations(log, "purchase", True, "2024-01-02", "2024-01-20", 10).select("id", "ts", "operation_type", "entity_count")


@query("operations", sql="SELECT id, operation_type FROM operations WHERE id = md5('7')")
def q2_operation_by_id(log):
    return log.where(F.col("id") == F.md5(F.lit("7"))).select("id", "operation_type")


@query("operations", sql="SELECT coalesce(sum(entity_count), 0)::BIGINT AS total_entities FROM operations WHERE success")
def q3_total_entities(log):
    return U.total_entities(log)


@query("operations", sql="SELECT round(coalesce(avg(processing_time_seconds), 0), 6) AS avg_seconds FROM operations WHERE success AND operation_type = 'click'")
def q4_average_time(log):
    return U.average_time(log, "click").select(F.round("avg_seconds", 6).alias("avg_seconds"))


@query("operations", sql="SELECT round(coalesce(avg((NOT success)::INT), 0), 9) AS failure_rate FROM operations")
def q5_failure_rate(log):
    return U.failure_rate(log).select(F.round("failure_rate", 9).alias("failure_rate"))


@query("operations", sql="SELECT id, operation_type FROM operations WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-05 23:59:59'")
def q7_until_day(log):
    return U.until_day(log, "2024-01-03", "2024-01-05").select("id", "operation_type")


@query("mappings", sql="SELECT id, full_name FROM mappings WHERE entity_type = 'PERSON' AND lower(full_name) LIKE '%mar%' ORDER BY id LIMIT 25")
def q8_list_mappings(mappings):
    return M.search(M.find_all(mappings, "PERSON"), "Mar", ("full_name",)).orderBy("id").limit(25).select("id", "full_name")


@query(
    "mappings",
    "gold",
    sql="SELECT substr(m.id, 1, 8) AS id, m.full_name, m.entity_type, m.pseudonym_full, count(DISTINCT g.doc_id) AS n_docs FROM mappings m LEFT JOIN gold g ON g.entity_text || (g.start_pos % 50)::VARCHAR = m.full_name GROUP BY m.id, 2, 3, 4",
)
def q9_list_entities(mappings, gold):
    mentions = gold.select("doc_id", F.concat("entity_text", (F.col("start_pos") % 50).cast("string")).alias("key"))
    return U.listed(mappings, mentions)


@query("mappings", sql=f", f AS (SELECT {_FLAGS} AS flags FROM mappings) SELECT count(*) AS n, count(*) FILTER (flags LIKE '%AMB%') AS n_ambiguous, count(*) FILTER (flags LIKE '%LOW%') AS n_low FROM f")
def q10_flag_totals(mappings):
    return U.flag_totals(mappings)


@query(
    "mappings",
    "operations",
    sql="""SELECT 'type:' || entity_type AS metric, count(*)::VARCHAR AS value FROM mappings GROUP BY entity_type
      UNION ALL SELECT 'theme:' || theme, count(*)::VARCHAR FROM mappings GROUP BY theme
      UNION ALL SELECT 'ambiguous', (count(*) FILTER (is_ambiguous))::VARCHAR FROM mappings UNION ALL SELECT 'mappings', count(*)::VARCHAR FROM mappings
      UNION ALL SELECT 'operations', count(*)::VARCHAR FROM operations UNION ALL SELECT 'operations_ok', (count(*) FILTER (success))::VARCHAR FROM operations
      UNION ALL SELECT 'last_operation', arg_max(id, (ts, id)) FROM operations""",
)
def q11_stats(mappings, log):
    return U.stats(mappings, log)


@query("mappings", sql=f", n AS ({_NEW}), d AS (SELECT full_name, count(*) AS c FROM n GROUP BY 1), o AS (SELECT d.*, full_name IN (SELECT full_name FROM mappings) AS old FROM d) SELECT count(*) FILTER (NOT old) AS n_imported, (sum(c) - count(*) FILTER (NOT old))::BIGINT AS n_skipped FROM o")
def q12_import_counts(mappings):
    return M.import_counts(mappings, _new(mappings))


@query("mappings", sql="SELECT id, full_name FROM mappings WHERE id <> md5('5')")
def q13_delete_by_prefix(mappings):
    import hashlib

    left, _ = M.deleted(mappings, hashlib.md5(b"5").hexdigest()[:20])
    return left.select("id", "full_name")


@query("mappings", sql="SELECT 'ERASURE' AS operation_type, count(*) AS entity_count, true AS success, sha256(string_agg(id, ',' ORDER BY id)) AS id FROM mappings WHERE is_ambiguous")
def q14_erasure_row(mappings):
    row = U.erasure(mappings.where("is_ambiguous"), F.to_timestamp(F.lit("2024-03-01")))
    return row.select("operation_type", "entity_count", "success", "id")


@query("mappings", sql="SELECT id, full_name FROM mappings WHERE NOT is_ambiguous")
def q14_bulk_delete(mappings):
    return M.bulk_deleted(mappings, mappings.where("is_ambiguous")).select("id", "full_name")


@query(
    "operations",
    sql="SELECT id, round(avg(processing_time_seconds) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * (100000 - event_id), 4) AS eta_seconds FROM operations",
)
def q19_eta(log):
    rows = log.select("id", F.col("user_id").alias("batch"), F.col("event_id").alias("seq"), "processing_time_seconds")
    return U.eta(rows, F.lit(100000)).select("id", F.round("eta_seconds", 4).alias("eta_seconds"))


@query(
    "operations",
    sql="""SELECT count(*) AS n_files, count(*) FILTER (success) AS n_ok, count(*) FILTER (NOT success) AS n_failed, sum(entity_count)::BIGINT AS n_new, sum(event_id % 3)::BIGINT AS n_reused,
      round(sum(processing_time_seconds), 3) AS seconds, coalesce(string_agg(DISTINCT 'error ' || (event_id % 4)::VARCHAR, '; ' ORDER BY 'error ' || (event_id % 4)::VARCHAR) FILTER (NOT success), '') AS errors FROM operations""",
)
def q20_batch_totals(log):
    error = F.when(~F.col("success"), F.concat(F.lit("error "), (F.col("event_id") % 4).cast("string")))
    rows = log.select("success", F.col("entity_count").alias("entities_new"), (F.col("event_id") % 3).alias("entities_reused"), F.col("processing_time_seconds").alias("seconds"), error.alias("error"))
    return U.batch_totals(rows).withColumn("seconds", F.round("seconds", 3))


@query("operations", sql="SELECT id, operation_type, success::VARCHAR AS success, coalesce(entity_count::VARCHAR, '') AS entity_count, event_id::VARCHAR || ',' || user_id::VARCHAR AS files FROM operations")
def s22_audit_csv(log):
    files_ = F.array(F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    return U.exported_csv(log.select("id", "operation_type", "success", "entity_count", files_.alias("files")))


@query("operations", sql="SELECT count(*) AS total, count(*) AS listed, min(id) AS first_id, arg_max(id, (ts, id)) IS NOT NULL AS has_latest FROM operations")
def s21_audit_json(log):
    """The JSON is read back, line by line; its total and its operations are compared."""
    lines = U.exported_json(log.select("id", "ts", "operation_type"), {"success": "all"}, F.lit("2024-03-01T00:00:00"))
    opening = F.when(F.col("piece") == 0, F.from_json(F.concat("json", F.lit("]}")), "struct<export_metadata: struct<total_results: long>>"))
    one = F.when(F.col("piece") > 0, F.from_json(F.ltrim("json", F.lit(",")), "struct<id: string>"))
    got = lines.select("piece", opening["export_metadata"]["total_results"].alias("total"), one["id"].alias("id"))
    latest = F.max(F.when(F.col("piece") == 1, F.col("id")))
    return got.agg(F.max("total").alias("total"), F.count("id").alias("listed"), F.min("id").alias("first_id"), latest.isNotNull().alias("has_latest"))


# -- review


@query("gold", "mappings", sql="SELECT doc_id, entity_text, start_pos, false AS known FROM gold WHERE entity_text NOT IN (SELECT split_part(full_name, ' ', 1) || ' ' || 'Dubois' FROM mappings) UNION ALL SELECT doc_id, entity_text, start_pos, true FROM gold WHERE entity_text IN (SELECT split_part(full_name, ' ', 1) || ' ' || 'Dubois' FROM mappings)")
def v1_known_entities(gold, mappings):
    names = mappings.select(F.concat(F.split_part("full_name", F.lit(" "), F.lit(1)), F.lit(" Dubois")).alias("full_name"))
    known, unknown = V.known(gold.withColumn("key", F.col("entity_text")), names)
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False))).select("doc_id", "entity_text", "start_pos", "known")


_BY = """, b AS (SELECT doc_id, span_id, bool_or(action = 'REJECT') AS rejected, bool_or(action IN ('CONFIRM', 'MODIFY', 'CHANGE_PSEUDONYM')) AS kept,
    arg_max(new_text, seq) FILTER (action = 'MODIFY' AND new_text IS NOT NULL) AS any_text,
    max(seq) FILTER (action = 'MODIFY') AS m_seq, max(seq) FILTER (action = 'CHANGE_PSEUDONYM') AS p_seq FROM decisions WHERE action <> 'ADD' GROUP BY 1, 2),
  c AS (SELECT b.doc_id, b.span_id, rejected, kept, m.new_text AS changed, p.new_pseudonym AS chosen FROM b
    LEFT JOIN decisions m ON m.doc_id = b.doc_id AND m.span_id = b.span_id AND m.seq = b.m_seq LEFT JOIN decisions p ON p.doc_id = b.doc_id AND p.span_id = b.span_id AND p.seq = b.p_seq)"""


@query(
    "review_spans",
    "decisions",
    sql=f"""{_BY} SELECT s.doc_id, s.span_id, coalesce(c.changed, s.text) AS text, s.entity_type, s.start_pos, s.end_pos, false AS added, c.chosen
      FROM review_spans s JOIN c ON c.doc_id = s.doc_id AND c.span_id = s.span_id WHERE kept AND NOT rejected
      UNION ALL SELECT doc_id, span_id, new_text, entity_type, start_pos, end_pos, true, new_pseudonym FROM decisions WHERE action = 'ADD'""",
)
def v2_validated_spans(spans, decisions):
    return V.validated(spans, decisions, custom=True)


@query(
    "review_spans",
    "decisions",
    sql=""", l AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY doc_id, span_id ORDER BY seq DESC) = 1)
      SELECT s.doc_id, s.span_id, coalesce(l.new_text, s.text) AS text, s.start_pos FROM review_spans s JOIN l ON l.doc_id = s.doc_id AND l.span_id = s.span_id WHERE l.action <> 'REJECT'""",
)
def v3_by_state(spans, decisions):
    return V.by_state(spans, decisions).select("doc_id", "span_id", "text", "start_pos")


@query(
    "review_spans",
    "decisions",
    sql=""", l AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY doc_id, span_id ORDER BY seq DESC) = 1)
      SELECT coalesce(l.action, 'PENDING') AS state, count(*) AS n FROM review_spans s FULL JOIN l ON l.doc_id = s.doc_id AND l.span_id = s.span_id GROUP BY 1""",
)
def v4_summary(spans, decisions):
    return V.summary(spans, decisions)


@query(
    "docs",
    "gold",
    sql="""SELECT g.doc_id, g.entity_text, g.entity_type, CASE WHEN strpos(coalesce(d.text, ''), g.entity_text) > 0 THEN strpos(d.text, g.entity_text) - 1 END::INTEGER AS start_pos,
      CASE WHEN strpos(coalesce(d.text, ''), g.entity_text) > 0 THEN strpos(d.text, g.entity_text) - 1 + length(g.entity_text) END::INTEGER AS end_pos,
      CASE WHEN NOT strpos(coalesce(d.text, ''), g.entity_text) > 0 THEN 'not found in the document' END AS error FROM gold g LEFT JOIN docs d ON d.doc_id = g.doc_id""",
)
def v5_added_by_hand(docs, gold):
    return V.added_by_hand(docs, gold.select("doc_id", "entity_text", "entity_type"))


@query(
    "regex_spans",
    sql="""SELECT DISTINCT doc_id, text, entity_type, start_pos, end_pos, (dense_rank() OVER (PARTITION BY doc_id ORDER BY CASE entity_type WHEN 'PERSON' THEN 1 WHEN 'ORG' THEN 2 ELSE 3 END, start_pos, end_pos, text))::INTEGER AS review_ord FROM regex_spans""",
)
def v6_review_order(spans):
    rows = spans.select("doc_id", "text", "entity_type", "start_pos", "end_pos").distinct()
    return V.review_order(rows).select("doc_id", "text", "entity_type", "start_pos", "end_pos", "review_ord")


@query("regex_spans", sql="SELECT doc_id % 5 AS doc_id, count(*) AS n, round(count(*) * 6 / 60.0, 1)::DOUBLE AS minutes FROM regex_spans GROUP BY 1 HAVING count(*) >= 100")
def v7_large_documents(spans):
    return V.large_documents(spans.withColumn("doc_id", F.col("doc_id") % 5))


@query("gold", sql="SELECT entity_type, count(*) AS n, count(DISTINCT entity_text) AS n_unique FROM gold GROUP BY 1")
def v10_counts(gold):
    return V.counts(gold.withColumnRenamed("entity_text", "text"))


# -- evaluation

_SCORES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"""
_CELLS = """, p AS (SELECT doc_id, lower(trim(text)) AS norm, entity_type, count(*) AS a FROM regex_spans GROUP BY 1, 2, 3),
  g AS (SELECT doc_id, lower(trim(entity_text)) AS norm, entity_type, count(*) AS b FROM gold GROUP BY 1, 2, 3),
  c AS (SELECT coalesce(p.entity_type, g.entity_type) AS entity_type, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.norm = g.norm AND p.entity_type = g.entity_type)"""


def _rounded(rows, *names):
    return rows.withColumns({n: F.round(n, 9) for n in names})


@query("regex_spans", "gold", sql=f"{_CELLS} SELECT entity_type, sum(least(a, b))::BIGINT AS tp, sum(a - least(a, b))::BIGINT AS fp, sum(b - least(a, b))::BIGINT AS fn FROM c GROUP BY ROLLUP (entity_type)")
def e1_text_matches(spans, gold):
    return E.text_matches(spans, gold)


@query(
    "regex_spans",
    "gold",
    sql=f"""{_CELLS}, s AS (SELECT entity_type, sum(least(a, b)) AS tp, sum(a - least(a, b)) AS fp, sum(b - least(a, b)) AS fn FROM c GROUP BY 1), x AS (SELECT *, {_SCORES} FROM s)
      SELECT entity_type, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1,
        round(CASE WHEN tp + fn > 0 THEN 100 * fn / (tp + fn) ELSE 0 END, 9) AS fn_rate, round(CASE WHEN tp + fp > 0 THEN 100 * fp / (tp + fp) ELSE 0 END, 9) AS fp_rate FROM x""",
)
def e2_scores(spans, gold):
    rows = E.with_scores(E.text_matches(spans, gold).where("entity_type IS NOT NULL")).drop("tp", "fp", "fn")
    return _rounded(rows, "precision", "recall", "f1", "fn_rate", "fp_rate")


#: Gold entities in turn, each with the nearest prediction that is free: x has a row a cell, with the places of those that were used.
_NEAREST = """, pr AS (SELECT doc_id, lower(trim(text)) AS norm, entity_type, list({{'start_pos': start_pos, 'end_pos': end_pos, 'v': {0}}} ORDER BY start_pos, end_pos, {0}) AS p FROM regex_spans GROUP BY 1, 2, 3),
  go AS (SELECT doc_id, lower(trim(entity_text)) AS norm, entity_type, list({{'start_pos': start_pos, 'end_pos': end_pos}} ORDER BY start_pos, end_pos) AS g FROM gold GROUP BY 1, 2, 3),
  ce AS (SELECT pr.*, coalesce(g, []) AS g FROM pr LEFT JOIN go USING (doc_id, norm, entity_type)),
  st AS (
    SELECT doc_id, norm, entity_type, 0 AS i, CAST([] AS INTEGER[]) AS used FROM ce
    UNION ALL
    SELECT s.doc_id, s.norm, s.entity_type, s.i + 1, list_append(s.used, coalesce(list_sort(list_transform(list_filter(range(1, len(c.p) + 1), lambda k: NOT list_contains(s.used, k::INTEGER)),
      lambda k: {{'far': abs(c.p[k].start_pos - c.g[s.i + 1].start_pos), 'k': k::INTEGER}}))[1].k, 0))
    FROM st s JOIN ce c USING (doc_id, norm, entity_type) WHERE s.i < len(c.g)),
  x AS (SELECT c.*, s.used FROM st s JOIN ce c USING (doc_id, norm, entity_type) WHERE s.i = len(c.g)),
  s AS (SELECT doc_id, norm, entity_type, p[k].start_pos AS start_pos, p[k].end_pos AS end_pos, p[k].v AS v, list_position(used, k::INTEGER) AS m, g FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM x) y)"""
_SOURCE = "CASE WHEN pattern_ord % 2 = 0 THEN 'ner' ELSE 'regex' END"


@query(
    "regex_spans",
    "gold",
    recursive=True,
    sql=f"{_NEAREST.format('start_pos')} SELECT doc_id, norm, entity_type, start_pos, end_pos, g[m].start_pos AS gold_start, g[m].end_pos AS gold_end FROM s WHERE m > 0",
)
def e1_nearest_matches(spans, gold):
    """Pairs of gold entities and predictions, one to one."""
    return E.nearest_matches(spans, gold)


@query("regex_spans", "gold", recursive=True, sql=f"{_NEAREST.format(_SOURCE)} SELECT v AS source, count(*) FILTER (m > 0) AS tp, count(*) FILTER (coalesce(m, 0) = 0) AS fp, round(count(*) FILTER (m > 0) / count(*), 9) AS precision FROM s GROUP BY 1")
def e3_source_scores(spans, gold):
    rows = spans.withColumn("source", F.when(F.col("pattern_ord") % 2 == 0, "ner").otherwise("regex"))
    return _rounded(E.source_scores(rows, gold), "precision")


@query(
    "regex_spans",
    "gold",
    sql=f""", p AS (SELECT doc_id, lower(trim(text)) AS norm, entity_type, count(*) AS a FROM regex_spans GROUP BY 1, 2, 3),
      g AS (SELECT *, lower(trim(entity_text)) AS norm, row_number() OVER (PARTITION BY doc_id, lower(trim(entity_text)), entity_type ORDER BY start_pos, end_pos) AS k FROM gold),
      h AS (SELECT g.*, k <= coalesce(a, 0) AS hit FROM g LEFT JOIN p ON p.doc_id = g.doc_id AND p.norm = g.norm AND p.entity_type = g.entity_type),
      e AS (SELECT hit, unnest({_CASES}) AS edge_case FROM h) SELECT edge_case, count(*) AS n_gold, count(*) FILTER (hit) AS n_found, round(count(*) FILTER (hit) / count(*), 9) AS recall FROM e WHERE edge_case IS NOT NULL GROUP BY 1""",
)
def e4_edge_case_recall(spans, gold):
    return _rounded(E.edge_case_recall(spans, gold), "recall")


@query(
    "regex_spans",
    "gold",
    recursive=True,
    sql=f"""{_NEAREST.format('confidence')} SELECT CASE WHEN v < 0.7 THEN '0.5-0.7' WHEN v < 0.9 THEN '0.7-0.9' ELSE '0.9-1.0' END AS bucket, count(*) AS n,
      count(*) FILTER (m > 0) AS tp, round(count(*) FILTER (m > 0) / count(*), 9) AS precision FROM s GROUP BY 1""",
)
def e5_bucket_precision(spans, gold):
    return _rounded(E.bucket_precision(spans, gold), "precision")


_SETS = """, p AS (SELECT DISTINCT doc_id, start_pos, end_pos, entity_type FROM regex_spans), g AS (SELECT DISTINCT doc_id, start_pos, end_pos, entity_type FROM gold),
  m AS (SELECT coalesce(p.entity_type, g.entity_type) AS entity_type, p.doc_id IS NOT NULL AS a, g.doc_id IS NOT NULL AS b FROM p FULL JOIN g
    ON p.doc_id = g.doc_id AND p.start_pos = g.start_pos AND p.end_pos = g.end_pos AND p.entity_type = g.entity_type),
  s AS (SELECT entity_type, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (b AND NOT a) AS fn FROM m GROUP BY 1)"""


@query("regex_spans", "gold", sql=f"{_SETS} SELECT * FROM s")
def e6_span_matches(spans, gold):
    return E.span_matches(spans, gold, ["entity_type"])


@query(
    "regex_spans",
    "gold",
    sql=f"{_SETS}, t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM s), x AS (SELECT *, {_SCORES} FROM t) SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 9) AS precision, round(r, 9) AS recall FROM x",
)
def e7_micro_average(spans, gold):
    return _rounded(E.micro_average(E.span_matches(spans, gold, ["entity_type"])), "precision", "recall").drop("f1", "fn_rate", "fp_rate")


@query(
    "operations",
    sql="""SELECT operation_type AS detector, count(*) AS n_files, sum(entity_count + user_id % 3 + 1)::BIGINT AS n_spans, sum(entity_count)::BIGINT AS n_person, sum(user_id % 3)::BIGINT AS n_location, count(*) AS n_org,
      round(sum(processing_time_seconds), 4) AS total_s, round(avg(processing_time_seconds), 6) AS avg_s, min(processing_time_seconds) AS min_s, max(processing_time_seconds) AS max_s FROM operations GROUP BY 1""",
)
def e8_detector_comparison(log):
    runs = log.select(F.col("operation_type").alias("detector"), F.col("processing_time_seconds").alias("seconds"), F.col("entity_count").cast("long").alias("n_person"), (F.col("user_id") % 3).alias("n_location"), F.lit(1).cast("long").alias("n_org"))
    return E.detector_comparison(runs).withColumns({"total_s": F.round("total_s", 4), "avg_s": F.round("avg_s", 6)})


@query(
    "gold",
    sql="""SELECT doc_id, count(*) FILTER (entity_type = 'PERSON') AS "PERSON", count(*) FILTER (entity_type = 'LOCATION') AS "LOCATION", count(*) FILTER (entity_type = 'ORG') AS "ORG",
      count(*) FILTER (entity_type = 'PERSON') >= 1 AND count(*) FILTER (entity_type = 'ORG') >= 1 AS enough FROM gold GROUP BY 1""",
)
def e9_entity_counts(gold):
    return E.entity_counts(gold, {"PERSON": 1, "ORG": 1})


@query(
    "gold",
    sql="""SELECT doc_id, entity_text, start_pos, end_pos, next_text, next_start FROM (SELECT *, lead(entity_text) OVER w AS next_text, lead(start_pos) OVER w AS next_start FROM (SELECT DISTINCT * FROM gold) d
      WINDOW w AS (PARTITION BY doc_id ORDER BY start_pos, end_pos, entity_text)) x WHERE next_start < end_pos""",
)
def e10_adjacent_overlaps(gold):
    return E.adjacent_overlaps(gold.distinct())


@query(
    "gold",
    "regex_spans",
    sql=""", c AS (SELECT DISTINCT doc_id, start_pos, end_pos FROM gold WHERE entity_type = 'PERSON' AND entity_text LIKE '%-%'),
      h AS (SELECT EXISTS (SELECT 1 FROM regex_spans p WHERE p.doc_id = c.doc_id AND p.start_pos < c.end_pos AND c.start_pos < p.end_pos) AS hit FROM c)
      SELECT count(*) AS n_compound, count(*) FILTER (hit) AS n_found, round(avg(hit::INT), 9) AS rate FROM h""",
)
def e12_compound_rate(gold, spans):
    return _rounded(E.compound_rate(gold, spans), "rate")


@query(
    "operations",
    sql="""SELECT operation_type, v[len(v) // 2 + 1] AS p50, v[least(floor(len(v) * 0.95)::INT, len(v) - 1) + 1] AS p95, v[least(floor(len(v) * 0.99)::INT, len(v) - 1) + 1] AS p99, round(len(v) / s * 60, 6) AS per_minute
      FROM (SELECT operation_type, list_sort(list(processing_time_seconds)) AS v, sum(processing_time_seconds) AS s FROM operations GROUP BY 1) o""",
)
def e13_index_percentiles(log):
    return E.index_percentiles(log, ["operation_type"], "processing_time_seconds").withColumn("per_minute", F.round("per_minute", 6))


@query(
    "operations",
    sql="SELECT operation_type, round(avg(entity_count), 6) AS mean, median(entity_count)::DOUBLE AS median, round(stddev_pop(entity_count), 6) AS std, min(entity_count) AS min, max(entity_count) AS max FROM operations GROUP BY 1",
)
def e14_utility(log):
    return E.utility(log, ["operation_type"], "entity_count").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _any_sql(values, how: str, text: str = "t") -> str:
    return "(" + " OR ".join(f"{how}({text}, '{v}')" for v in values) + ")"


def _in_sql(word: str, values) -> str:
    return f"{word} IN ({', '.join(repr(v) for v in values)})"


_ODD_TEXTS = ["Directeur technique", "Le Siège", "Nous avons vu le Groupe Horizon", "Dubois, Chef", "Corp Solutions", "Me", "Directeur, Paul"]
_ODD_SQL = f""", o AS (SELECT doc_id, CASE WHEN end_pos % 2 = 0 THEN {_ODD_TEXTS}[start_pos % {len(_ODD_TEXTS)} + 1] ELSE entity_text END AS entity_text, entity_type, start_pos, end_pos FROM gold),
  w AS (SELECT *, entity_text AS t, regexp_extract_all(entity_text, '\\S+') AS w, trim(split_part(entity_text, ',', 1)) AS head FROM o)"""
_UPPER = lambda word: f"regexp_matches(substr({word}, 1, 1), '\\p{{Lu}}')"
_LISTED = f"(contains(t, ',') AND {_UPPER('head')})"
_NAMED = f"len(list_filter(w[2:], lambda x: {_UPPER('x')} AND NOT {_in_sql('x', E.JOB_TITLES)})) > 0"
_PERSON = f"entity_type = 'PERSON' AND NOT {_LISTED}"
_REASONS = [
    (f"{_PERSON} AND {_any_sql(E.JOB_TITLES, 'contains')} AND NOT {_NAMED}", "job_title"),
    (f"{_PERSON} AND {_any_sql(E.SITE_WORDS, 'contains')}", "site"),
    (f"{_PERSON} AND {_any_sql(E.FRAGMENT_STARTS, 'starts_with')}", "fragment"),
    (f"{_PERSON} AND {_any_sql(('Corp', 'France'), 'contains')}", "organisation"),
    ("entity_type = 'ORG' AND len(w) > 5", "too_long"),
    (f"entity_type = 'ORG' AND {_any_sql(E.SENTENCE_STARTS, 'starts_with')}", "sentence"),
]


@query("gold", sql=f"{_ODD_SQL}, r AS (SELECT *, concat_ws(',', {', '.join(f'CASE WHEN {rule} THEN {name!r} END' for rule, name in _REASONS)}) AS reasons FROM w) SELECT doc_id, entity_text, entity_type, start_pos, reasons FROM r WHERE reasons <> ''")
def e11_suspicious(gold):
    return E.suspicious(_odd(gold)).select("doc_id", "entity_text", "entity_type", "start_pos", F.array_join("reasons", ",").alias("reasons"))


_NO_TITLE = "NOT regexp_matches(t, '^(?:Dr\\.|Pr\\.|M\\.|Mme|Me|Professeur|Docteur)\\s+[A-ZÀ-Ö]')"
_PROPER = f"len(list_filter(w, lambda x: {_UPPER('x')} AND NOT {_in_sql('x', E.COMPANY_WORDS)} AND length(x) > 2)) < 2"
_NO_PERSON = " OR ".join(
    [
        f"(contains(t, ',') AND {_in_sql('head', E.STANDALONE_TITLES)})",
        _any_sql(E.PLACE_WORDS, "contains"),
        _any_sql((*E.FRAGMENT_STARTS, "En "), "starts_with"),
        f"({_any_sql(E.COMPANY_WORDS, 'contains')} AND {_NO_TITLE} AND {_PROPER})",
        _any_sql(E.FRAGMENTS, "contains"),
        "length(t) < 3",
    ]
)
_NO_ORG = " OR ".join(["len(w) > 6", _any_sql((*E.SENTENCE_STARTS, "Ensuite", "Avec "), "starts_with"), _any_sql(E.VERBS, "contains", "lower(t)")])


@query("gold", sql=f"{_ODD_SQL} SELECT doc_id, entity_text, entity_type, start_pos, end_pos FROM w WHERE NOT CASE entity_type WHEN 'PERSON' THEN ({_NO_PERSON}) WHEN 'ORG' THEN ({_NO_ORG}) ELSE false END")
def e15_without_false_positives(gold):
    return E.without_false_positives(_odd(gold))


def _odd(gold):
    """gold with texts that annotators get wrong in some places."""
    text = F.element_at(F.array(*map(F.lit, _ODD_TEXTS)), (F.col("start_pos") % len(_ODD_TEXTS) + 1).cast("int"))
    return gold.withColumn("entity_text", F.when(F.col("end_pos") % 2 == 0, text).otherwise(F.col("entity_text")))
