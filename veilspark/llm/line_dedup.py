"""Line dedup by winnowing over line hashes.

A document is its lines that have a word.  A run of lines is repeated if it has
MIN_WORDS words or more and an equal run begins earlier in the corpus, in the order
of doc_id and line, and ends before it begins.  Every line of a repeated run is
deleted; the first run stays, in periodic text too.

From each line a window reaches just far enough, forwards and backwards, to hold
MIN_WORDS words, so any run of that many words is a union of windows.  The line with
the smallest hash in a window is its fingerprint: a run and its repetition select
the same lines, so a window whose fingerprint stands at one position of the corpus
only has no equal.  Positions of a fingerprint that has two or more are joined, by
the content of the windows around them, each with the first of its content and never
with each other; a match is extended both ways by the windows that match beside it,
and the union of a document's matches is deleted.

Nulls and edge cases: a null or empty text has no lines and keeps its text; a null
doc_id sorts before all others; rows that share doc_id and text are one occurrence,
and stay or go together; a line without a word is no part of a run and is kept; an
empty table gives an empty result; extra columns are kept by deduplicated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_word, stored, words

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _reach(counts: str, i: str, step: int, least: int) -> str:
    """How many lines from line i on, in steps of 1 or -1, hold `least` words; null if there are too few."""
    part = f"slice({counts}, {i} + 1, {least})" if step > 0 else f"reverse(slice({counts}, greatest(1, {i} + 2 - {least}), least({least}, {i} + 1)))"
    total = f"aggregate({part}, named_struct('w', 0, 'n', 0), (a, x) -> CASE WHEN a.w >= {least} THEN a ELSE named_struct('w', a.w + x, 'n', a.n + 1) END)"
    return f"transform(array({total}), a -> CASE WHEN a.w >= {least} THEN a.n END)[0]"


def windows(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, print and at (the fingerprint and its line), low, size (lines, without blank ones) and content of each window.

    content is a pair of hashes of the window's line hashes. A window that reaches backwards is left out where the one
    that reaches forwards from its first line is the same. Work grows with the lines, of which a window has `least` at most.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.filter(_lines(F.col("text")), has_word).alias("l"))
    rows = lines.select(
        "doc_id",
        "text_hash",
        F.transform("l", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("l", lambda x: F.xxhash64(x, F.lit(7))).alias("h2"),
        F.transform("l", lambda x: F.size(words(x))).alias("n"),
    )
    every = "slice(sequence(0, size(n)), 1, size(n))"
    rows = rows.withColumn("_on", F.expr(f"transform({every}, i -> {_reach('n', 'i', 1, least)})"))
    rows = rows.withColumn("_back", F.expr(f"transform({every}, i -> {_reach('n', 'i', -1, least)})"))
    on = "transform(_on, (k, i) -> named_struct('low', i, 'size', k))"
    back = "transform(_back, (k, i) -> named_struct('low', i + 1 - k, 'size', CASE WHEN get(_on, i + 1 - k) = k THEN NULL ELSE k END))"
    rows = rows.withColumn("spans", F.expr(f"filter(concat({on}, {back}), x -> x.size IS NOT NULL)"))
    cut = lambda h: f"slice({h}, s.low + 1, s.size)"
    window = f"named_struct('low', s.low, 'size', s.size, 'print', array_min({cut('h')}), 'c1', xxhash64({cut('h')}), 'c2', xxhash64({cut('h2')}))"
    rows = rows.select("doc_id", "text_hash", "h", F.expr(f"transform(spans, s -> {window})").alias("w"))
    rows = rows.withColumn("w", F.expr("transform(w, x -> named_struct('print', x.print, 'at', x.low - 1 + cast(array_position(slice(h, x.low + 1, x.size), x.print) AS int), 'low', x.low, 'size', x.size, 'c1', x.c1, 'c2', x.c2))"))
    # outer: a filter for empty arrays would be pushed down and compute all of this once more
    rows = rows.select("doc_id", "text_hash", F.inline_outer("w"))
    return rows.where("size IS NOT NULL")


def repeated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, low and high (lines, without blank ones) of every maximal run of repeated windows, disjoint in a document."""
    found = stored(windows(docs, least))
    place = F.struct("doc_id", "text_hash", "at")
    prints = found.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("print")
    near = found.join(prints, "print", "left_semi")
    at = F.struct("doc_id", "text_hash", "low")
    first = near.groupBy("c1", "c2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last").drop("last")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    # equal windows have equally many lines: one that begins inside the first is no repetition
    apart = ~same | (F.col("low") >= F.col("first.low") + F.col("size"))
    later = near.join(first, ["c1", "c2"]).where((at > F.col("first")) & apart)
    later = later.groupBy("doc_id", "text_hash", "low").agg(F.max(F.col("low") + F.col("size")).alias("high"))
    # the extension: a document's matches that overlap or touch are one run
    own = "PARTITION BY doc_id, text_hash ORDER BY low"
    reach = f"max(high) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    later = later.withColumn("_new", F.expr(f"CASE WHEN low <= {reach} THEN 0 ELSE 1 END"))
    later = later.withColumn("_run", F.expr(f"sum(_new) OVER ({own})"))
    return later.groupBy("doc_id", "text_hash", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_run")


def deduplicated(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs with the lines of repeated runs deleted from text, and n_lines, n_deleted and deleted (their line numbers)."""
    spans = repeated(docs, least)
    # a document's own runs: no more of them than its lines
    spans = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("_spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans")
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_own")
    rows = docs.select(own, F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.xxhash64("text").alias("_th"))
    rows = rows.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_hash")), "left")
    rows = rows.withColumn("_lines", F.when(F.col("_text").isNotNull(), _lines(F.col("_text"))))
    # numbers of the lines that have a word; a run counts only them
    real = F.filter(F.transform("_lines", lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_real", real)
    rows = rows.withColumn("_gone", F.expr("coalesce(flatten(transform(_spans, s -> slice(_real, s.low + 1, s.high - s.low))), cast(array() AS array<int>))"))
    # from the end of the run before to the beginning of each run all lines stay, and from there to its end those without a word
    edge = "transform(_spans, s -> named_struct('low', get(_real, s.low), 'high', get(_real, s.high - 1) + 1))"
    rows = rows.withColumn("_edges", F.expr(edge))
    low = lambda k: F.coalesce(F.get("_edges", k - 1)["high"], F.lit(0))
    between = lambda e, k: F.slice("_lines", low(k) + 1, e["low"] - low(k))
    inside = lambda e: F.filter(F.slice("_lines", e["low"] + 1, e["high"] - e["low"]), lambda x: ~has_word(x))
    rest = F.slice("_lines", F.element_at("_edges", -1)["high"] + 1, F.size("_lines"))
    kept = F.array_join(F.concat(F.flatten(F.transform("_edges", lambda e, k: F.concat(between(e, k), inside(e)))), rest), "\n")
    text = F.when(F.size("_gone") > 0, kept).otherwise(F.col("_text"))
    new = ["n_lines", "n_deleted", "deleted"]
    return rows.select(
        *[(text if c == "text" else F.col("_own")[c]).alias(c) for c in docs.columns if c not in new],
        F.coalesce(F.size("_real"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_deleted"),
        F.col("_gone").alias("deleted"),
    )
