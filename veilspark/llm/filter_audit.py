"""Audit of filters that overlap: what each removes, in every order of applying them.

Filters, by letter: A too few words, B too few distinct words, C too many capitals, D a
symbol of markup, E a copy of a text with a smaller doc_id, removed or not.

Copies are found by refining a partition.  Documents are split by their length in code
points; then, block after block of the text, by a hash of the blocks so far.  After each
split the classes with a single document go.  What survives all splits is compared by full
text, and all but the smallest doc_id of equal texts are marked.  Splits work on numbers
of classes, which copies share and which are counted before they are shuffled; only texts
of surviving classes are read again.  Classes of the most documents (HEAD of them at most)
meet the documents by broadcast, others by a shuffle in which none is hot.

Every document then is a mask of five bits.  Masks are counted a part, 32 rows at most, and
the report over all orders comes from these counts alone.

Nulls and edge cases: a null text is empty, and empty texts are copies of each other.  A null
lang is the part ''.  A null doc_id is neither smaller nor larger than another: such a row is
never a copy and has no label, nor are rows of the same doc_id copies of each other; each row
counts.  Of several labels of a doc_id one 1 suffices.  An empty table gives an empty report.
Other columns are ignored.  Texts are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import head_of_counts, stored

LETTERS = "ABCDE"
#: Where the blocks of a text begin, in code points; the last one goes to the text's end.
BLOCKS = (0, 256, 2048)
#: Classes that are broadcast at most, at 24 bytes each.
HEAD = 1 << 18

_CAPITALS = bytes(range(65, 91))
_KEYS = [f"class_{k}" for k in range(len(BLOCKS) + 1)]
_LAST = _KEYS[-1]


@dataclass(frozen=True)
class Rules:
    """A document fails A to D with fewer words, a smaller share of distinct words, more capitals, or any symbol."""

    min_words: int = 200
    min_distinct_percent: int = 50
    max_capitals_percent: int = 3
    symbols: str = "#$%&*|"

    def fails(self, text: str) -> int:
        """Bits of A to D."""
        data = text.encode()
        words = data.split()  # at 0x20 and 0x09-0x0D
        capitals = len(data) - len(data.translate(None, _CAPITALS))
        return (
            (len(words) < self.min_words)
            | (100 * len(set(words)) < self.min_distinct_percent * len(words)) << 1
            | (100 * capitals > self.max_capitals_percent * len(text)) << 2
            | any(s in text for s in self.symbols) << 3
        )


def _classes(text: Column, bits: int) -> list[Column]:
    """A number of the class after each split; bits: of a block's hash, fewer in tests, where unlike texts are to meet."""
    found = [F.length(text).cast("long")]
    for low, high in zip(BLOCKS, [*BLOCKS[1:], None]):
        part = F.substring(text, low + 1, high - low if high else 2**31 - 1)
        found.append(F.shiftrightunsigned(F.xxhash64(found[-1], part), 64 - bits))
    return [c.alias(k) for c, k in zip(found, _KEYS)]


def sketched(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, part, text and the classes of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), *_classes(text, bits))


def judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """sketched() rows with `fails`, the bits of A to D, in place of the text."""
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in kept) + ", fails int"

    def run(batches):
        for batch in batches:
            fails = pa.array([rules.fails(t.as_py()) for t in batch.column("text")], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), fails], names=[*kept, "fails"])

    return rows.select(*kept, "text").mapInArrow(run, schema)


def met(rows: DataFrame, table: DataFrame, key: str, how: str, head: int = HEAD) -> DataFrame:
    """rows join table on key (how: left_semi, left_anti or left); table is stored, has a key once, and n, the rows with that key."""
    least = head_of_counts(table, "n", head)
    top, rest = F.broadcast(table.where(F.col("n") >= least).drop("n")), table.where(F.col("n") < least).drop("n")
    if rest.isEmpty():
        return rows.join(top, key, how)
    others = rows.join(top, key, "left_anti").join(rest, key, how)
    return others if how == "left_anti" else rows.join(top, key, "inner" if how == "left" else how).unionByName(others)


def refined(sketch: DataFrame, head: int = HEAD) -> DataFrame:
    """Last classes of two documents or more, with the number n of their documents."""
    alive = sketch.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_docs"))
    for k, key in enumerate(_KEYS):
        alive = stored(alive)
        several = alive.groupBy(key).agg(F.sum("n_docs").alias("n")).where("n > 1")
        if k == len(BLOCKS):
            return stored(several)
        alive = met(alive, stored(several), key, "left_semi", head)


def marked(docs: DataFrame, rules: Rules = Rules(), bits: int = 64, head: int = HEAD) -> DataFrame:
    """doc_id, part and fails, the bits of A to E, of every row."""
    rows = sketched(docs, bits)
    sketch = stored(judged(rows, rules))
    survivors = refined(sketch, head)
    texts = met(rows.select("doc_id", "text", _LAST), survivors, _LAST, "left_semi", head).groupBy(_LAST, "text").agg(F.min("doc_id").alias("first_id"))
    same = stored(texts.groupBy(_LAST).agg(F.count(F.lit(1)).alias("texts"), F.min("first_id").alias("first_id")))
    alike = stored(survivors.join(same, _LAST))
    unlike = alike.where("texts > 1").select(_LAST, "n")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    out = lambda joined: joined.select("doc_id", "part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("fails"))
    one = alike.where("texts = 1").select(_LAST, "n", "first_id")
    if unlike.isEmpty():
        return out(met(sketch, one, _LAST, "left", head))
    # unlike texts have met in a class: their rows are read with texts, which then must be equal
    others = met(sketch, unlike, _LAST, "left_anti", head)
    again = stored(met(rows, unlike, _LAST, "left_semi", head).withColumn("text_key", F.sha2("text", 256)))
    first = stored(again.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    return out(met(others, one, _LAST, "left", head)).unionByName(out(met(judged(again, rules), first, "text_key", "left", head)))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    found = []
    for order in map("".join, permutations(LETTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            found.append((order, step, bit, before))
            before |= bit
    return found


def report(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """marked() rows counted: a row a part, order and step."""
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    labels = labels.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    masks = rows.join(labels, "doc_id", "left").groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(bit).alias("bit"), F.lit(b).alias("before")) for o, s, bit, b in _steps()])
    each = masks.select("*", F.inline(steps))
    hit, gone = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    total = lambda test, c="n": F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    counted = each.groupBy("part", "filter_order", "step", "bit").agg(
        total(~hit & ~gone).alias("kept"),
        total(hit & ~gone).alias("removed"),
        total(hit & gone).alias("redundant"),
        total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(hit & ~gone, "good").alias("good_lost"),
        total(hit & ~gone, "toxic").alias("toxic_lost"),
    )
    # a part and filter have 120 rows
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), bits: int = 64, head: int = HEAD) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    return report(marked(docs, rules, bits, head), labels)
