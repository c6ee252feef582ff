"""Mixing sources to target weights by temperature, with budgeted block permutations.

Weights are w_i ~ p_i ** alpha, where p_i is source i's share of all tokens.
alpha in [0, 1] is bisected: the smallest one whose most repeated source is read
at most `max_repeats` times as often as its least repeated one, or the one whose
weights have the entropy asked for.  The budget defaults to the least number of
tokens at which no document is left out, so mixing repeats and never drops.

A source's budget is realised epoch by epoch.  Its documents lie in BLOCKS blocks
by hash; an epoch reads the blocks in an order of its own and, within a block, the
documents in an order of its own.  The last epoch stops at the document with which
the budget is met.  Only block totals and the one block in which an epoch stops are
ordered, so no source is sorted as a whole and no text is shuffled.

Nulls and edge cases: a null source is a source of its own; a null, empty or blank
text has 0 tokens and is read once in each started epoch that reaches it; a null
doc_id is permuted like any other; rows that tie in every way are taken together;
an empty table gives an empty result; extra columns are kept,
and mixed() puts its own in place of those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, stored, words

MAX_REPEATS = 2.0
BLOCKS = 1024
STEPS = 60


def _key(*parts: Column | str) -> Column:
    """A reproducible 60-bit rank."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("-")) for p in parts])), 1, 15), 16, 10).cast("long")


def _doc() -> Column:
    return F.col("doc_id").cast("string")


def weights(totals: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """source, tokens, weight and target (tokens to read), from a table of source and tokens.

    The exponent is bisected on one row with an array of the sources' totals, so it is the number of sources, and not
    that of documents, that has to fit a row.
    """
    one = totals.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("tokens", "source"))).alias("s"))
    one = one.select("s", F.expr("aggregate(s, 0D, (a, x) -> a + x.tokens)").alias("total"))
    # p is scaled by its largest value; the weights are normalised, so that changes nothing
    one = one.withColumn("p", F.expr("transform(s, x -> x.tokens / total)"))
    one = one.withColumn("top", F.array_max("p")).withColumn("low", F.array_min("p"))
    if entropy is None:
        over = f"pow(top / low, 1 - (a.lo + a.hi) / 2) > {float(max_repeats)!r}D"
    else:
        z = "aggregate(p, 0D, (t, x) -> t + pow(x, (a.lo + a.hi) / 2))"
        plain = "aggregate(p, 0D, (t, x) -> t + pow(x, (a.lo + a.hi) / 2) * ln(x))"
        over = f"ln({z}) - (a.lo + a.hi) / 2 * ({plain}) / ({z}) > {float(entropy)!r}D"
    step = f"CASE WHEN {over} THEN named_struct('lo', (a.lo + a.hi) / 2, 'hi', a.hi) ELSE named_struct('lo', a.lo, 'hi', (a.lo + a.hi) / 2) END"
    alpha = F.expr(f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (a, i) -> {step}).hi")
    one = one.withColumn("alpha", alpha).withColumn("w", F.expr("transform(p, x -> pow(x, alpha))"))
    one = one.withColumn("z", F.expr("aggregate(w, 0D, (t, x) -> t + x)"))
    # the least repeated source has the largest p / w; a budget of total * max(p / w) reads it exactly once
    least = "array_max(zip_with(p, w, (x, y) -> x / (y / z)))"
    spent = f"{float(budget)!r}D" if budget is not None else f"total * {least}"
    rows = one.select("alpha", F.expr(f"{spent}").alias("spent"), F.inline(F.expr("zip_with(s, w, (x, y) -> named_struct('source', x.source, 'tokens', x.tokens, 'weight', y / z))")))
    return rows.select("source", "tokens", "alpha", "weight", F.round(F.col("weight") * F.col("spent")).cast("long").alias("target"))


def _few(sources: DataFrame, n: int) -> DataFrame:
    """A table with a row a source, to be broadcast if there are few enough sources."""
    return F.broadcast(sources) if n <= BROADCAST_IDS // 10 else sources


def _plan(rows: DataFrame, shares: DataFrame, n: int) -> DataFrame:
    """source, weight, full (whole epochs), and where the epoch after them stops: block, then key and document."""
    plan = shares.select("source", "weight", F.floor(F.col("target") / F.col("tokens")).alias("full"), F.pmod("target", "tokens").alias("rest"))
    blocks = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).join(_few(plan, n), "source")
    blocks = blocks.withColumn("rank", _key(F.lit("b"), F.col("full").cast("string"), F.col("block").cast("string")))
    # BLOCKS rows a source, however many documents it has
    before = F.expr("sum(n) OVER (PARTITION BY source ORDER BY rank, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n")
    blocks = blocks.withColumn("before", before).where("before < rest AND before + n >= rest")
    stop = blocks.select("source", "full", F.col("rank").alias("stop_rank"), "block", (F.col("rest") - F.col("before")).alias("left"))
    inside = rows.join(_few(stop, n), ["source", "block"])
    inside = inside.withColumn("key", _key(F.lit("d"), F.col("full").cast("string"), F.col("doc")))
    inside = inside.groupBy("source", "left", "key", "doc").agg(F.sum("n_tokens").alias("n_tokens"))
    run = "sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    last = inside.withColumn("run", F.expr(run)).where("run >= left").groupBy("source").agg(F.min(F.struct("key", "doc")).alias("last"))
    stop = stop.select("source", "stop_rank", F.col("block").alias("stop_block"))
    return plan.join(stop, "source", "left").join(last, "source", "left")


def _read(docs: DataFrame, max_repeats: float, entropy: float | None, budget: float | None) -> DataFrame:
    """_own (the document's columns) with n_tokens, weight, epoch, block and position keys, a row for each reading."""
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_own")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    rows = docs.select(own, source.alias("source"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"), F.coalesce(_doc(), F.lit("-")).alias("doc"))
    rows = rows.withColumn("block", (_key(F.lit("k"), F.col("doc")) % BLOCKS).cast("int"))
    counted = stored(rows.select("source", "block", "doc", "n_tokens"))
    totals = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    shares = stored(weights(totals, max_repeats, entropy, budget))
    n = shares.count()
    plan = stored(_plan(counted, shares, n))
    # a source without tokens is read once
    out = rows.join(_few(plan, n), "source", "left")
    rank = _key(F.lit("b"), F.col("full").cast("string"), F.col("block").cast("string"))
    key = _key(F.lit("d"), F.col("full").cast("string"), F.col("doc"))
    here, stop = F.struct(rank.alias("a"), F.col("block").alias("b")), F.struct(F.col("stop_rank").alias("a"), F.col("stop_block").alias("b"))
    before = F.struct(key.alias("key"), F.col("doc").alias("doc")) <= F.col("last")
    part = (F.col("rest") > 0) & ((here < stop) | ((here == stop) & before))
    times = F.coalesce(F.col("full") + F.coalesce(part, F.lit(False)).cast("long"), F.lit(1).cast("long"))
    out = out.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))
    epoch = F.col("epoch").cast("string")
    return out.select(
        "_own",
        "n_tokens",
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.col("epoch").cast("int").alias("epoch"),
        "block",
        _key(F.lit("b"), epoch, F.col("block").cast("string")).alias("block_key"),
        _key(F.lit("d"), epoch, F.col("doc")).alias("doc_key"),
    )


def mixed(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """A row for each time that a document is read: n_tokens, weight, epoch, block, block_key and doc_key after its other columns.

    Read in the order of source, epoch, block_key and doc_key, that is the permutation.
    """
    rows = _read(docs, max_repeats, entropy, budget)
    new = rows.columns[1:]
    return rows.select(*[F.col("_own")[c].alias(c) for c in docs.columns if c not in new], *new)


def repeated(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """mixed() with the columns of docs and no others."""
    rows = _read(docs, max_repeats, entropy, budget)
    return rows.select(*[F.col("_own")[c].alias(c) for c in docs.columns])
