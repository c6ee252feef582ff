"""Queries of scalar functions and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookup
from ..functions import text as T
from .detection import _listed, _strip_sql, spans_sql
from .registry import on_tables, query

_PREP = r"(?i)^\s*(?:(?:d''|l'')|(?:aux|au|des|du|de|à|en)\s+)"


@query("gold", sql=f"SELECT doc_id, start_pos, end_pos, entity_text, {_strip_sql('entity_text')} AS bare FROM gold")
def n1_strip_titles(gold):
    return gold.select("doc_id", "start_pos", "end_pos", "entity_text", T.strip_titles("entity_text").alias("bare"))


_WITH_PREP = "element_at(array('à ', 'en ', 'du ', 'La ', 'dans ', ''), CAST(1 + start_pos % 6 AS INT)) || entity_text"
_WITH_PREP_SQL = "list_extract(['à ', 'en ', 'du ', 'La ', 'dans ', ''], CAST(1 + start_pos % 6 AS INTEGER)) || entity_text"


@query("gold", sql=f"SELECT doc_id, start_pos, end_pos, {_WITH_PREP_SQL} AS place, trim(regexp_replace({_WITH_PREP_SQL}, '{_PREP}', '')) AS bare FROM gold")
def n2_strip_prepositions(gold):
    rows = gold.withColumn("place", F.expr(_WITH_PREP))
    return rows.select("doc_id", "start_pos", "end_pos", "place", T.strip_prepositions("place").alias("bare"))


_FORM_SQL = f"CASE WHEN entity_type = 'LOCATION' THEN trim(regexp_replace({_strip_sql('t')}, '{_PREP}', '')) ELSE {_strip_sql('t')} END"


@query("gold", sql=f"SELECT doc_id, start_pos, end_pos, t, {_FORM_SQL} AS norm FROM (SELECT *, {_WITH_PREP_SQL} AS t FROM gold) g")
def n3_normal_form(gold):
    rows = gold.withColumn("t", F.expr(_WITH_PREP))
    return rows.select("doc_id", "start_pos", "end_pos", "t", T.normal_form("t", "entity_type").alias("norm"))


@query(
    "gold",
    sql=f"""SELECT doc_id, start_pos, end_pos, CASE entity_type WHEN 'PERSON' THEN {_strip_sql('entity_text')}
      WHEN 'LOCATION' THEN lower(trim(regexp_replace(entity_text, '{_PREP}', ''))) ELSE lower(trim(entity_text)) END AS form FROM gold""",
)
def n4_grouping_form(gold):
    return gold.select("doc_id", "start_pos", "end_pos", T.grouping_form("entity_text", "entity_type").alias("form"))


@query(
    "mappings",
    sql="""SELECT id, full_name, CASE WHEN len(w) = 1 THEN w[1] WHEN len(w) > 1 THEN array_to_string(w[1:len(w) - 1], ' ') END AS "first",
      CASE WHEN len(w) > 1 THEN w[len(w)] END AS "last", len(w) <> 2 AS ambiguous FROM (SELECT *, string_split(full_name, ' ') AS w FROM mappings) m""",
)
def n5_parse_name(mappings):
    return mappings.select("id", "full_name", T.parse_name("full_name").alias("p")).select("id", "full_name", "p.first", "p.last", "p.ambiguous")


def _gender_sql(word: str) -> str:
    key = f"split_part(upper(substr({word}, 1, 1)) || lower(substr({word}, 2)), '-', 1)"
    return f"CASE WHEN {key} IN ({_listed(lookup.GENDERS['ambiguous'])}) THEN NULL WHEN {key} IN ({_listed(lookup.GENDERS['male'])}) THEN 'male' WHEN {key} IN ({_listed(lookup.GENDERS['female'])}) THEN 'female' END"


@query("mappings", sql=f"SELECT id, first_name, {_gender_sql('first_name')} AS gender FROM mappings")
def n6_gender(mappings):
    return lookup.with_gender(mappings.select("id", "first_name"), "first_name", lookup.genders(mappings.sparkSession))


@query("mappings", sql=f"SELECT id, full_name, entity_type, CASE WHEN entity_type = 'PERSON' THEN {_gender_sql('''split_part(full_name, ' ', 1)''')} END AS gender FROM mappings")
def n7_gender_of_full_name(mappings):
    return lookup.with_name_gender(mappings.select("id", "full_name", "entity_type"), "full_name", lookup.genders(mappings.sparkSession))


_FIRST = sorted({n for kind in lookup.GENDERS.values() for n in kind})


@query(
    "mappings",
    sql=f"""SELECT id, w, w IN ({_listed(_FIRST)}) OR upper(substr(w, 1, 1)) || lower(substr(w, 2)) IN ({_listed(_FIRST)}) AS known
      FROM (SELECT id, CASE WHEN is_ambiguous THEN lower(split_part(full_name, ' ', 1)) ELSE split_part(full_name, ' ', 1) END AS w FROM mappings) m""",
)
def n8_is_first_name(mappings):
    rows = mappings.selectExpr("id", "CASE WHEN is_ambiguous THEN lower(split_part(full_name, ' ', 1)) ELSE split_part(full_name, ' ', 1) END AS w")
    names = lookup.names(mappings.sparkSession).where("kind = 'first'")
    return lookup.is_name(rows, "w", names, "known")


@query("gold", sql=f"SELECT doc_id, entity_text, start_pos FROM gold WHERE entity_text IN ({_listed([v for k in lookup.PLACES.values() for v in k])})")
def n9_is_location(gold):
    places = lookup.places(gold.sparkSession).select(F.col("value").alias("entity_text"))
    return gold.join(places, "entity_text", "left_semi").select("doc_id", "entity_text", "start_pos")


_BEFORE = lambda whole, part: f"CASE WHEN {part} <> {whole} AND {part} <> '' AND strpos({whole}, {part}) > 1 THEN substr({whole}, 1, strpos({whole}, {part}) - 1) ELSE '' END"
_PLACE_SQL = f"trim(regexp_replace({_strip_sql('t')}, '{_PREP}', ''))"


@query(
    "gold",
    sql=f"""SELECT doc_id, start_pos, end_pos, t, CASE entity_type WHEN 'PERSON' THEN {_BEFORE('t', _strip_sql('t'))}
      WHEN 'LOCATION' THEN {_BEFORE(_strip_sql('t'), _PLACE_SQL)} ELSE '' END AS prefix
      FROM (SELECT *, CASE WHEN entity_type = 'LOCATION' THEN {_WITH_PREP_SQL} ELSE entity_text END AS t FROM gold) g""",
)
def n10_replacement_prefix(gold):
    rows = gold.withColumn("t", F.expr(f"CASE WHEN entity_type = 'LOCATION' THEN {_WITH_PREP} ELSE entity_text END"))
    return rows.select("doc_id", "start_pos", "end_pos", "t", T.replacement_prefix("t", "entity_type").alias("prefix"))


@query(
    "gold",
    sql=r"""SELECT doc_id, start_pos, end_pos, entity_text, CASE WHEN regexp_matches(entity_text, '(?i)^(Dr\.?|M\.?|Mme\.?)\s')
      THEN regexp_extract(entity_text, '(?i)^((?:Dr|M|Mme)\.?)\s', 1) || ' ' ELSE '' END AS title FROM gold""",
)
def n11_preview_title(gold):
    return gold.select("doc_id", "start_pos", "end_pos", "entity_text", T.preview_title("entity_text").alias("title"))


_WORDS_SQL = r"regexp_extract_all({}, '\S+')"


@on_tables(
    "conversations",
    sql=f"""WITH c AS (SELECT conv_id, turn, text, (length(text) // 3)::INTEGER AS a, least(length(text), length(text) // 3 + 12)::INTEGER AS b FROM conversations),
      w AS (SELECT *, {_WORDS_SQL.format('substr(text, 1, a)')} AS x, {_WORDS_SQL.format('substr(text, b + 1)')} AS y FROM c)
      SELECT conv_id, turn, concat_ws(' ', CASE WHEN len(x) > 0 THEN '...' || array_to_string(CASE WHEN len(x) > 10 THEN x[len(x) - 9:] ELSE x END, ' ') END,
        '[' || substr(text, a + 1, b - a) || ']', CASE WHEN len(y) > 0 THEN array_to_string(y[1:10], ' ') || '...' END) AS context FROM w""",
)
def n12_context(turns):
    rows = turns.withColumn("a", F.floor(F.length("text") / 3).cast("int"))
    rows = rows.withColumn("b", F.least(F.length("text"), F.col("a") + 12))
    return rows.select("conv_id", "turn", T.context("text", "a", "b").alias("context"))


@query("gold", sql="SELECT doc_id, entity_text || '_' || start_pos::VARCHAR AS key FROM gold")
def n13_span_key(gold):
    return gold.select("doc_id", T.span_key("entity_text", "start_pos").alias("key"))


_MESSAGE = "'Cannot open ''' || entity_text || ''' for Marie Anne Dubois: file \"x y\" of doc ' || CAST(doc_id AS {})"


@query(
    "gold",
    sql=f"""SELECT doc_id, start_pos, end_pos, regexp_replace(regexp_replace(regexp_replace({_MESSAGE.format('VARCHAR')}, '''[^'']*''', '''[REDACTED]''', 'g'),
      '"[^"]*"', '"[REDACTED]"', 'g'), '\\b[A-ZÀ-Ÿ][a-zà-ÿ]+(?:\\s+[A-ZÀ-Ÿ][a-zà-ÿ]+)+\\b', '[REDACTED]', 'g') AS message FROM gold""",
)
def n14_redaction(gold):
    message = F.concat(F.lit("Cannot open '"), "entity_text", F.lit("' for Marie Anne Dubois: file \"x y\" of doc "), F.col("doc_id").cast("string"))
    return gold.select("doc_id", "start_pos", "end_pos", T.redacted(message).alias("message"))


@query(
    "mappings",
    sql="""SELECT id, CASE WHEN confidence_score < 0.6 THEN 'Low confidence score from NLP model'
      WHEN full_name || ' ' LIKE '% %' AND len(regexp_extract_all(full_name, '\\S+')) = 1 THEN 'Partial compound name detected'
      ELSE 'Entity flagged as ambiguous by detection algorithm' END AS reason FROM mappings WHERE is_ambiguous""",
)
def n15_ambiguity_reason(mappings):
    return mappings.where("is_ambiguous").select("id", T.ambiguity_reason("full_name", "confidence_score").alias("reason"))


_FLAGS = """CASE WHEN is_ambiguous AND confidence_score <> 0 AND confidence_score < 0.85 THEN 'AMB LOW' WHEN is_ambiguous THEN 'AMB'
      WHEN confidence_score <> 0 AND confidence_score < 0.85 THEN 'LOW' ELSE 'OK' END"""


@query("mappings", sql=f"SELECT id, {_FLAGS} AS flags FROM mappings")
def n16_review_flags(mappings):
    return mappings.select("id", T.review_flags("is_ambiguous", "confidence_score").alias("flags"))


_SIZE = "(CAST(event_id AS DOUBLE) * event_id * 1000)"


@query(
    "operations",
    sql=f"""SELECT id, CASE WHEN {_SIZE} < 1024 THEN printf('%.1f B', {_SIZE}) WHEN {_SIZE} < 1048576 THEN printf('%.1f KB', {_SIZE} / 1024)
      WHEN {_SIZE} < 1073741824 THEN printf('%.1f MB', {_SIZE} / 1048576) WHEN {_SIZE} < 1099511627776 THEN printf('%.1f GB', {_SIZE} / 1073741824)
      ELSE printf('%.1f TB', {_SIZE} / 1099511627776) END AS size,
      CASE WHEN processing_time_seconds < 60 THEN '< 1m' ELSE floor(processing_time_seconds / 60)::BIGINT::VARCHAR || 'm ' || floor(processing_time_seconds % 60)::BIGINT::VARCHAR || 's' END AS duration
      FROM operations""",
)
def n17_labels(log):
    return log.select("id", T.size_label(F.expr(_SIZE)).alias("size"), T.duration_label("processing_time_seconds").alias("duration"))


@query(
    "operations",
    sql="""SELECT id, CASE d WHEN 0 THEN 'aujourd''hui' WHEN 1 THEN 'hier' ELSE 'il y a ' || d::VARCHAR || ' jours' END AS label
      FROM (SELECT id, floor((epoch(TIMESTAMP '2024-02-15 00:00:00') - floor(epoch(ts))) / 86400)::BIGINT AS d FROM operations) o""",
)
def n18_days_ago(log):
    return log.select("id", T.days_ago("ts", F.to_timestamp(F.lit("2024-02-15 00:00:00"))).alias("label"))


_PASS = "substr(md5(CAST(c_custkey AS {})) || CASE WHEN c_custkey % 2 = 0 THEN 'ABC!' ELSE '' END, 1 + CAST(c_custkey % 3 AS INT), CAST((c_custkey * 7) % 40 AS INT))"
_KINDS = r"(regexp_matches(p, '\p{Ll}')::INT + regexp_matches(p, '\p{Lu}')::INT + regexp_matches(p, '\p{Nd}')::INT + regexp_matches(p, '[^\p{L}\p{N}]')::INT)"


@on_tables(
    "customer",
    sql=f"""SELECT c_custkey, CASE WHEN length(p) < 12 THEN 'invalid' WHEN length(p) >= 30 AND {_KINDS} >= 3 THEN 'strong'
      WHEN length(p) >= 20 AND {_KINDS} >= 2 THEN 'medium' ELSE 'weak' END AS strength FROM (SELECT c_custkey, {_PASS.format('VARCHAR')} AS p FROM customer) c""",
)
def n19_passphrase_strength(customer):
    return customer.select("c_custkey", T.passphrase_strength(F.expr(_PASS.format("STRING"))).alias("strength"))


@query(
    "mappings",
    sql="SELECT id, regexp_extract(pseudonym_full, '^(PER|LOC)-([0-9]+)$', 1) AS prefix, regexp_extract(pseudonym_full, '^(PER|LOC)-([0-9]+)$', 2)::INTEGER AS number FROM mappings WHERE regexp_matches(pseudonym_full, '^(PER|LOC)-')",
)
def n20_numbered(mappings):
    rows = mappings.select("id", T.numbered("pseudonym_full", ("PER", "LOC")).alias("n")).where("n.prefix IS NOT NULL")
    return rows.select("id", "n.prefix", "n.number")


_CASES = r"""[CASE WHEN regexp_matches(entity_text, '[A-ZÀ-ÖØ-Ÿa-zà-öø-ÿ]+-[A-ZÀ-ÖØ-Ÿa-zà-öø-ÿ]+') THEN 'compound_hyphenated' END,
      CASE WHEN regexp_matches(entity_text, '(?i)^(?:Dr\.?|Pr\.?|Prof\.?|M\.?|Mme\.?|Mlle\.?|Me\.?|Docteur|Professeur|Madame|Monsieur|Mademoiselle|Maître)\s') THEN 'title_with_name' END,
      CASE WHEN regexp_matches(entity_text, '\b[A-ZÀ-ÖØ-Ÿ](?:-[A-ZÀ-ÖØ-Ÿ])?\.\s') THEN 'abbreviation' END,
      CASE WHEN entity_type = 'ORG' AND regexp_matches(entity_text, '\s') THEN 'multi_word_org' END,
      CASE WHEN regexp_matches(entity_text, '[àâäéèêëïîôùûüÿçœæÀÂÄÉÈÊËÏÎÔÙÛÜŸÇŒÆ]') THEN 'french_diacritics' END,
      CASE WHEN entity_type = 'PERSON' AND regexp_matches(entity_text, '^[A-ZÀ-ÖØ-Ÿ][a-zà-öø-ÿ]+,\s') THEN 'last_first_order' END]"""


@query("gold", sql=f"SELECT * FROM (SELECT doc_id, start_pos, end_pos, entity_text, unnest({_CASES}) AS edge_case FROM gold) g WHERE edge_case IS NOT NULL")
def n21_edge_cases(gold):
    return gold.select("doc_id", "start_pos", "end_pos", "entity_text", F.explode(T.edge_cases("entity_text", "entity_type")).alias("edge_case"))


_BUCKET = "CASE WHEN {0} IS NULL THEN 'none' WHEN {0} < 0.5 THEN '0.0-0.5' WHEN {0} < 0.7 THEN '0.5-0.7' WHEN {0} < 0.9 THEN '0.7-0.9' ELSE '0.9-1.0' END"


@query("mappings", sql=f"SELECT {_BUCKET.format('confidence_score')} AS bucket, count(*) AS n FROM mappings GROUP BY 1")
def n22_confidence_buckets(mappings):
    return mappings.groupBy(T.confidence_bucket("confidence_score").alias("bucket")).agg(F.count("*").alias("n"))


@query("paths", sql="SELECT path FROM paths")
def n23_path_of_key(paths):
    keys = paths.select(F.concat(F.lit("file:"), "path", F.lit(":hash")).alias("k"))
    return keys.select(T.path_of_key("k").alias("path"))


def _letter_sql(n: str) -> str:
    one = f"chr(65 + (({n}) - 1) % 26)"
    return f"CASE WHEN {n} <= 26 THEN {one} WHEN {n} <= 702 THEN chr(65 + ((({n}) - 1) // 26 - 1) % 26) || {one} ELSE chr(65 + (((({n}) - 1) // 26 - 1) // 26 - 1) % 26) || chr(65 + ((({n}) - 1) // 26 - 1) % 26) || {one} END"


@on_tables("customer", sql=f"SELECT c_custkey + 1 AS i, {_letter_sql('(c_custkey + 1)::INTEGER')} AS letter FROM customer")
def s8_column_letter(customer):
    i = F.col("c_custkey") + 1
    return customer.select(i.alias("i"), T.column_letter(i).alias("letter"))


@query(
    "paths",
    sql=r"""SELECT path, CASE WHEN lower(e) IN ('.pdf', '.docx') THEN substr(path, 1, length(path) - length(e)) || '_pseudonymized.txt'
      ELSE substr(path, 1, length(path) - length(e)) || '_pseudonymized' || e END AS output FROM (SELECT path, regexp_extract(path, '[^/]+(\.[^./]*)$', 1) AS e FROM paths) p""",
)
def s14_output_name(paths):
    return paths.select("path", T.output_path("path").alias("output"))


@query("paths", sql=r"SELECT path, lower(regexp_extract(path, '[^/]+(\.[^./]*)$', 1)) AS ext FROM paths")
def s15_extension(paths):
    return paths.select("path", T.extension("path").alias("ext"))


del spans_sql
