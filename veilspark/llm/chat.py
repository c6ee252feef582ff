"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
participant as assistant and all others as users named by role; system turns stay
system turns.  A segment is one turn of one rendering: its text, its place in the
rendering (character offsets), and mask = 1 where the model learns, that is in the
participant's own words and the end mark after them.

Renderings stay one row a segment, so a conversation of any length is spread over
the cluster: offsets come from the lengths of blocks of BLOCK turns and of the turns
before in the block.  rendered() joins segments into one text where that is wanted.

Delimiters in texts and names are escaped, so no text can forge a turn; unescaped() gives a
segment's text back.

Nulls and edge cases: a null conv_id is a conversation like any other; a null turn
sorts first; turns that tie are ordered by role and text; a null role is a user named
`unknown` and no participant; a null or empty text is an empty turn; a conversation
whose only role is `system` has no rendering; repeated rows are repeated turns; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
OPEN, SEPARATOR, CLOSE = "<|", "|>\n", "<|end|>\n"


def escaped(value: Column) -> Column:
    """value without marks that could open a turn: a backslash goes into each `<|`, and one more into each `<\\` to tell them apart."""
    return F.replace(F.replace(value, F.lit("<\\"), F.lit("<\\\\")), F.lit(OPEN), F.lit("<\\|"))


def unescaped(value: Column) -> Column:
    """What escaped() was given."""
    return F.replace(F.replace(value, F.lit("<\\|"), F.lit(OPEN)), F.lit("<\\\\"), F.lit("<\\"))


def _head(kind: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escaped(kind), F.lit("\n"), F.lit(" ")), F.lit(SEPARATOR))


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position, role_as, segment, mask, char_start, mask_start and char_end."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.col("role").isNull().alias("nameless"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    system = (F.col("speaker") == "system") & ~F.col("nameless")
    people = rows.where(~system & ~F.col("nameless")).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    both = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = (F.col("speaker") == F.col("perspective")) & ~F.col("nameless")
    both = both.withColumn("mask", own.cast("int"))
    kind = F.when(system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user:"), F.col("speaker")))
    both = both.withColumn("role_as", kind)
    both = both.withColumn("segment", F.concat(_head(F.col("role_as")), escaped(F.col("text")), F.lit(CLOSE)))
    both = both.withColumn("size", F.length("segment").cast("long"))
    # a block of turns is a partition of its own; only sums a block are ordered over a whole conversation
    order = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "nameless", "text")
    order = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("s"), F.count("*").alias("c"))
    over = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(
        F.col("conv_id").alias("_conv"),
        F.col("perspective").alias("_who"),
        F.col("block").alias("_block"),
        (F.sum("s").over(over) - F.col("s")).alias("_size"),
        (F.sum("c").over(over) - F.col("c")).alias("_count"),
    )
    both = both.withColumn("end", F.sum("size").over(order)).withColumn("n", F.count("*").over(order))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who")) & F.col("block").eqNullSafe(F.col("_block"))
    both = both.join(sums, same)
    end = F.col("_size") + F.col("end")
    return both.select(
        "conv_id",
        "perspective",
        (F.col("_count") + F.col("n") - 1).alias("position"),
        "role_as",
        "segment",
        "mask",
        (end - F.col("size")).alias("char_start"),
        (end - F.col("size") + F.length(_head(F.col("role_as")))).alias("mask_start"),
        end.alias("char_end"),
    )


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, text and spans (start and end of what the model learns), a row a rendering.

    A whole conversation becomes one value here, so it has to fit one.
    """
    part = F.struct("position", "segment", "mask", "mask_start", "char_end")
    rows = segments(turns).groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(part)).alias("p"))
    learned = F.filter("p", lambda x: x["mask"] == 1)
    return rows.select(
        "conv_id",
        "perspective",
        F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"),
        F.transform(learned, lambda x: F.struct(x["mask_start"].alias("start"), x["char_end"].alias("end"))).alias("spans"),
    )
