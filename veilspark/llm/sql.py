"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x AS u, y AS v FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS u, doc_id AS top FROM documents UNION SELECT b.v, r.top FROM r JOIN both_ways b ON r.u = b.u),
top AS (SELECT u, min(top) AS top FROM r GROUP BY 1),
cls AS (SELECT y, min(x) AS x FROM e WHERE same GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, t.top AS component_id, coalesce(c.x, d.doc_id) AS class_id
FROM documents d JOIN top t ON t.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN cls c ON c.y = d.doc_id
"""

OP3 = rf"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM split),
live AS (
  SELECT doc_id, i, x, len(regexp_extract_all(x, '{WORD}')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM lines WHERE regexp_matches(x, '{WORD}')),
cum AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY r) AS s FROM live),
reach AS (
  SELECT a.doc_id, a.r AS low, b.r AS high FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + 49
  WHERE b.s - a.s + a.n >= 50),
spans AS (SELECT doc_id, low, min(high) AS high FROM reach GROUP BY 1, 2 UNION SELECT doc_id, max(low), high FROM reach GROUP BY 1, 3),
runs AS (
  SELECT s.doc_id, s.low, s.high, string_agg(c.x, chr(10) ORDER BY c.r) AS content
  FROM spans s JOIN cum c ON c.doc_id = s.doc_id AND c.r BETWEEN s.low AND s.high GROUP BY 1, 2, 3),
later AS (
  SELECT doc_id, low, high FROM (
    SELECT *, first_value(doc_id) OVER win AS first_doc, first_value(low) OVER win AS first_low, first_value(high) OVER win AS first_high
    FROM runs WINDOW win AS (PARTITION BY content ORDER BY doc_id, low))
  WHERE doc_id <> first_doc OR low > first_high),
gone AS (SELECT DISTINCT c.doc_id, c.i FROM later t JOIN cum c ON c.doc_id = t.doc_id AND c.r BETWEEN t.low AND t.high),
kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY 1),
total AS (SELECT doc_id, count(*) AS n FROM live GROUP BY 1),
cut AS (SELECT doc_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS deleted FROM gone GROUP BY 1)
SELECT s.doc_id, coalesce(t.n, 0) AS n_lines, coalesce(c.n, 0) AS n_deleted, coalesce(c.deleted, '') AS deleted_lines,
  length(CASE WHEN s.text IS NOT NULL THEN coalesce(k.text, '') END) AS kept_chars,
  md5(CASE WHEN s.text IS NOT NULL THEN coalesce(k.text, '') END) AS kept_md5
FROM split s LEFT JOIN kept k USING (doc_id) LEFT JOIN total t USING (doc_id) LEFT JOIN cut c USING (doc_id)
"""


def _key(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(47) || '.join(parts)}), 1, 15))::BIGINT"


OP5 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, '=' || source AS s, doc_id::VARCHAR AS doc, len(regexp_extract_all(text, '{WORD}')) AS n FROM documents),
k AS (SELECT *, ({_key("'k'", "doc")} % 1024)::INTEGER AS block FROM d),
tot AS (SELECT s, sum(n) AS t FROM k GROUP BY 1 HAVING sum(n) > 0),
share AS (SELECT s, t, t / (SELECT sum(t) FROM tot)::DOUBLE AS p FROM tot),
edge AS (SELECT max(p) / min(p) AS r FROM share),
bis(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN pow(r, 1 - (lo + hi) / 2) > 2.0 THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN pow(r, 1 - (lo + hi) / 2) > 2.0 THEN hi ELSE (lo + hi) / 2 END FROM bis, edge WHERE i < 60),
w AS (SELECT s, t, p, pow(p, (SELECT hi FROM bis WHERE i = 60)) AS v FROM share),
z AS (SELECT s, t, p, v / (SELECT sum(v) FROM w) AS weight FROM w),
spent AS (SELECT (SELECT sum(t) FROM tot) * max(p / weight) AS b FROM z),
goal AS (SELECT s, t, weight, round(weight * b)::BIGINT AS target FROM z, spent),
plan AS (SELECT s, weight, target // t AS complete, target % t AS rest FROM goal),
blocks AS (
  SELECT b.s, b.block, b.n, p.complete, p.rest, {_key("'b'", "p.complete::VARCHAR", "b.block::VARCHAR")} AS rank
  FROM (SELECT s, block, sum(n) AS n FROM k GROUP BY 1, 2) b JOIN plan p USING (s)),
run AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY rank, block) - n AS before FROM blocks),
stop AS (SELECT s, complete, block, rank, rest - before AS remaining FROM run WHERE before < rest AND before + n >= rest),
inside AS (
  SELECT k.s, k.doc, t.remaining, {_key("'d'", "t.complete::VARCHAR", "k.doc")} AS key, k.n FROM k JOIN stop t ON t.s = k.s AND t.block = k.block),
ran AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY key, doc) AS total FROM inside),
last AS (SELECT s, min(row(key, doc)) AS last FROM ran WHERE total >= remaining GROUP BY 1),
times AS (
  SELECT k.*, coalesce(p.weight, 0) AS weight, CASE WHEN p.s IS NULL THEN 1 ELSE p.complete + (p.rest > 0 AND coalesce(
    row({_key("'b'", "p.complete::VARCHAR", "k.block::VARCHAR")}, k.block) < row(t.rank, t.block)
    OR (k.block = t.block AND row({_key("'d'", "p.complete::VARCHAR", "k.doc")}, k.doc) <= l.last), false))::INTEGER END AS m
  FROM k LEFT JOIN plan p USING (s) LEFT JOIN stop t USING (s) LEFT JOIN last l USING (s)),
e AS (SELECT *, unnest(range(m::BIGINT))::INTEGER AS epoch FROM times)
SELECT doc_id, source, n AS n_tokens, round(weight, 9) AS weight, epoch, block,
  {_key("'b'", "epoch::VARCHAR", "block::VARCHAR")} AS block_key, {_key("'d'", "epoch::VARCHAR", "doc")} AS doc_key
FROM e
"""

OP6 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, role IS NULL AS nameless, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE NOT nameless AND speaker <> 'system'),
b AS (
  SELECT t.*, perspective, (speaker = perspective AND NOT nameless)::INTEGER AS mask,
    CASE WHEN speaker = 'system' AND NOT nameless THEN 'system' WHEN speaker = perspective AND NOT nameless THEN 'assistant' ELSE 'user:' || speaker END AS role_as
  FROM t JOIN who USING (conv_id)),
h AS (SELECT *, '<|' || replace(replace(replace(role_as, '<' || chr(92), '<' || chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), ' ') || '|>' || chr(10) AS head FROM b),
s AS (SELECT *, head || replace(replace(text, '<' || chr(92), '<' || chr(92) || chr(92)), '<|', '<' || chr(92) || '|') || '<|end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, row_number() OVER win - 1 AS position, sum(length(segment)) OVER win AS fin
  FROM s WINDOW win AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, nameless, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, role_as, mask, (fin - length(segment))::BIGINT AS char_start,
  (fin - length(segment) + length(head))::BIGINT AS mask_start, fin::BIGINT AS char_end, segment, md5(segment) AS segment_md5
FROM o
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM d),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails
  FROM w
),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
),
steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before
  FROM orders, range(1, 6) AS r(step)
),
c AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER ((fails & bit) = 0 AND (fails & before) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER ((fails & bit) <> 0 AND (fails & before) = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER ((fails & bit) <> 0 AND (fails & before) <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER ((fails & bit) <> 0 AND (fails & before) = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER ((fails & bit) <> 0 AND (fails & before) = 0), 0)::BIGINT AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM c
"""
