"""Quality rules: a fixed rule set, then a hashed n-gram likelihood ratio.

Two multinomials over hashed uni- and bigrams are counted: one over all documents
trusted to be good, one over all documents.  A document's verdict is the mean,
over its n-grams, of the log ratio of the two, against a fixed threshold.  Every
document is counted and judged, whole; nothing here runs outside the JVM.

Up to BROADCAST_IDS trusted ids are broadcast, and one pass counts both.  With more,
the trusted documents are found by a shuffled join and counted in a pass of their
own, while the raw counts need no join.

Nulls and edge cases: a null or empty text has no words and fails the base
rules; repeated rows are counted and judged each; without any trusted document
the ratio is 0 everywhere and the base rules decide alone; an empty table gives
an empty result; extra columns are ignored by judge() and kept by kept().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, has_word, stored, words

BUCKET_BITS = 16
THRESHOLD = -0.25
MIN_WORDS = 50
MARKS = "#*$%&|<>!"


def _base(text: Column) -> dict[str, Column]:
    rest = text
    for symbol in "#*$%&|<>":
        rest = F.replace(rest, F.lit(symbol), F.lit(""))
    return {
        "_words": words(text),
        "n_symbols": (F.octet_length(text) - F.octet_length(rest)).cast("long"),
        "_lines": F.filter(F.split(text, "\n", -1), has_word),
    }


#: A window's hash and place in one number, so that a plain sort brings like ones together: the place takes
#: the low bits, and of the hash the high ones stay. In a text of more words every window is looked at as a whole.
PLACE_BITS = 20
_WINDOW = "element_at(_windows, i + 1)"


def _windows() -> Column:
    """Hashes of the windows of three words."""
    return F.expr("transform(slice(_words, 1, greatest(0, size(_words) - 2)), (x, i) -> xxhash64(x, get(_words, i + 1), get(_words, i + 2)))")


def _packed() -> Column:
    """Of a text that has a window twice; most have none, which takes no sort and no look at each place."""
    return F.expr(f"""
CASE WHEN size(_windows) > {1 << PLACE_BITS} OR size(array_distinct(_windows)) = size(_windows) THEN array() ELSE
  sort_array(transform(_windows, (x, i) -> (x & {-(1 << PLACE_BITS)}L) | i)) END
""")


def _maybe() -> Column:
    """Places of the windows that may occur twice: those with a neighbour of equal high bits (in a longer text, all)."""
    return F.expr(f"""
CASE WHEN size(_windows) > {1 << PLACE_BITS} THEN sequence(0, size(_windows) - 1)
  WHEN size(_packed) = 0 THEN array() ELSE
  transform(filter(_packed, (e, k) -> coalesce(shiftright(e ^ get(_packed, k + 1), {PLACE_BITS}) = 0, false)
      OR coalesce(shiftright(e ^ get(_packed, k - 1), {PLACE_BITS}) = 0, false)),
    e -> cast(e & {(1 << PLACE_BITS) - 1} AS int)) END
""")


#: Words inside windows that do occur twice: of those places, windows are sorted by their whole hash, equal neighbours
#: are marked, and the marked places' windows united.
_REPEATED = f"""
CASE WHEN size(_maybe) = 0 THEN 0L ELSE
  aggregate(
    transform(array(sort_array(transform(_maybe, i -> named_struct('x', {_WINDOW}, 'i', i)))), s ->
      sort_array(filter(transform(s, (e, k) ->
        CASE WHEN get(s, k - 1).x = e.x OR get(s, k + 1).x = e.x THEN e.i END), p -> p IS NOT NULL)))[0],
    named_struct('n', 0L, 'last', -3),
    (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p)).n
END
"""


def profile(docs: DataFrame, more: list[Column] = ()) -> DataFrame:
    """doc_id with the base counts and base_failed, and the text for what follows."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    counted = base.withColumns(_base(F.col("text")))
    counted = counted.withColumns({"n_words": F.size("_words").cast("long"), "_windows": _windows()})
    counted = counted.withColumn("_packed", _packed()).withColumn("_maybe", _maybe())
    return counted.select(
        "doc_id",
        "text",
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
        *(["_own"] if more else []),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def tokens(text: Column) -> Column:
    """Lower-cased words, with each mark of MARKS as a token of its own."""
    spaced = F.lower(text)
    for mark in MARKS:
        spaced = F.replace(spaced, F.lit(mark), F.lit(f" {mark} "))
    return words(spaced)


def _hashed(tokens: Column) -> Column:
    """32 bits a token: enough for what ends in a table of buckets."""
    return F.transform(tokens, lambda x: F.hash(x))


def _bucket(gram: Column, bits: int) -> Column:
    return F.shiftrightunsigned(gram, 32 - bits)


def _total(ratio: Column, h: Column, bits: int) -> Column:
    """The sum of the ratios of a text's uni- and bigrams, from its token hashes (two at least)."""
    of = lambda gram: F.get(ratio, _bucket(gram, bits))
    both = F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.when(b.isNull(), of(a)).otherwise(of(a) + of(F.hash(a, b))))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def ratios(docs: DataFrame, trusted: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """One row with `ratio`: the log ratio of each of 2 ** bits buckets, target against raw, add-one smoothed.

    trusted: doc_id of the trusted documents. The counts cover all documents and all trusted ones.
    """
    good = stored(trusted.where("doc_id IS NOT NULL").select("doc_id").distinct())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if good.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(good.withColumn("t", F.lit(1))), "doc_id", "left").select(F.lit(1).alias("r"), F.coalesce("t", F.lit(0)).alias("t"), "text")
    else:
        own = rows.join(good, "doc_id", "left_semi").select(F.lit(0).alias("r"), F.lit(1).alias("t"), "text")
        rows = rows.select(F.lit(1).alias("r"), F.lit(0).alias("t"), "text").unionAll(own)
    rows = rows.select("r", "t", _hashed(tokens(F.col("text"))).alias("h"))
    # outer: a filter for empty arrays would be pushed down and compute the tokens once more
    rows = rows.select("r", "t", F.explode_outer(F.expr("arrays_zip(h, slice(h, 2, greatest(size(h), 1)))")).alias("p"))
    rows = rows.select("r", "t", F.col("p")["h"].alias("a"), F.col("p")["1"].alias("b"))
    both = F.array(F.when(F.col("a").isNotNull(), _bucket(F.col("a"), bits)), F.when(F.col("b").isNotNull(), _bucket(F.hash("a", "b"), bits)))
    found = rows.select("r", "t", F.explode(both).alias("b"))
    counts = found.where("b IS NOT NULL").groupBy("b").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    every = docs.sparkSession.range(0, 1 << bits, 1, 1).select(F.col("id").cast("int").alias("b"))
    counts = every.join(counts, "b", "left").na.fill(0, ["r", "t"])
    one = counts.agg(
        F.array_sort(F.collect_list(F.struct("b", "r", "t"))).alias("c"), F.sum("r").alias("R"), F.sum("t").alias("T")
    )
    term = F.expr(
        f"transform(c, x -> CASE WHEN T = 0 THEN 0D ELSE"
        f" ln((x.t + 1) / (T + {1 << bits}D)) - ln((x.r + 1) / (R + {1 << bits}D)) END)"
    )
    return one.select(term.alias("ratio"))


def kept(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """The documents that the rules keep, each judged in its own row, with all their columns."""
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_own")
    # a row number keeps the filter above the projections: pushed down, it would compute them again inside itself
    rows = judge(docs, trusted, threshold, [own], bits).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.where("kept AND _row >= 0")
    return rows.select(*[F.col("_own")[c].alias(c) for c in docs.columns])


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, more: list[Column] = (), bits: int = BUCKET_BITS) -> DataFrame:
    """doc_id, the base counts, base_failed, llr (mean log ratio an n-gram) and kept, then further columns of docs."""
    rows = profile(docs, more).withColumn("_tokens", _hashed(tokens(F.col("text"))))
    # a fixed number of buckets, found once for all rows; as a literal, every description of the plan would write it out.
    # It is bound once a row, not copied into it.
    rows = rows.withColumn("_ratio", ratios(docs, trusted, bits).scalar())
    known = F.struct(F.col("_ratio").alias("r"), F.col("_tokens").alias("h"))
    judged = F.get(F.transform(F.array(known), lambda v: _total(v["r"], v["h"], bits)), F.lit(0)) / (2 * F.size("_tokens") - 1)
    rows = rows.withColumn("llr", F.when(~F.col("base_failed"), judged))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.coalesce(F.col("llr") >= threshold, F.lit(False)).alias("kept"),
        "llr",
        *(["_own"] if more else []),
    )
