"""Replacement: overlaps are resolved and the texts between spans and replacements are joined again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_overlaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of spans(keys..., start_pos, end_pos, ...), those that overlap none kept before them; by start, longer ones first.

    A document's spans are one group, gone through once.
    """

    def kept(table: pa.Table) -> pa.Table:
        start, end = (table.column(c).to_pylist() for c in ("start_pos", "end_pos"))
        taken, at = [], None
        for i in sorted(range(len(start)), key=lambda i: (start[i], -end[i])):
            if at is None or start[i] >= at:
                taken.append(i)
                at = end[i]
        return table.take(pa.array(taken, pa.int64()))

    return spans.groupBy(*keys).applyInArrow(kept, spans.schema)


def spliced(text: str, spans: list[dict]) -> tuple[str, int]:
    """text with the spans' places taken by their replacements, overlaps resolved as in without_overlaps(), and how many were taken."""
    pieces, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start_pos"], -s["end_pos"], s["replacement"])):
        if s["start_pos"] >= at:
            pieces += [text[at : s["start_pos"]], s["replacement"]]
            at = s["end_pos"]
    return "".join([*pieces, text[at:]]), len(pieces) // 2


def rewritten(docs: DataFrame, spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, text (rewritten) and n_replaced, from docs(keys..., text) and spans(keys..., start_pos, end_pos, replacement).

    A null replacement leaves its place as it is. Time grows as the text and its spans do: the texts are
    spliced by Python, which finds a character's place at once, as the JVM's strings do not.
    """
    keys = keys or ["doc_id"]
    one = F.struct(F.col("start_pos").cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"), "replacement")
    found = spans.where("replacement IS NOT NULL").groupBy(*keys).agg(F.collect_set(one).alias("_s"))
    # spans grow as texts do and pack well: sent to all tasks, a table that looks small would be large in each
    rows = docs.select(*keys, "text").join(found.hint("merge"), keys, "left")

    def run(batches):
        for batch in batches:
            texts, taken = [], []
            for text, own in zip(batch.column("text"), batch.column("_s")):
                text, own = text.as_py(), own.as_py()
                text, n = spliced(text, own) if text is not None and own else (text, 0)
                texts.append(text)
                taken.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string()), pa.array(taken, pa.int32())], names=[*keys, "text", "n_replaced"])

    kinds = dict(docs.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string, n_replaced int")


def pruned_annotations(spans: DataFrame) -> DataFrame:
    """Annotations without overlaps: by start and length, the first stays unless a shorter one of its type overlaps it."""
    item = F.struct("start_pos", (F.col("end_pos") - F.col("start_pos")).alias("n"), "end_pos", "entity_type", "entity_text")
    rows = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("s"))

    def meets(a: Column, b: Column) -> Column:
        return (a["start_pos"] < b["end_pos"]) & (b["start_pos"] < a["end_pos"])

    def step(kept: Column, s: Column) -> Column:
        first = F.get(F.filter(kept, lambda k: meets(k, s)), F.lit(0))
        better = (s["n"] < first["n"]) & (s["entity_type"] == first["entity_type"])
        swapped = F.concat(F.filter(kept, lambda k: k != first), F.array(s))
        return F.when(first.isNull(), F.concat(kept, F.array(s))).when(better, swapped).otherwise(kept)

    kept = F.aggregate("s", F.slice("s", 1, 0), step)
    return rows.select("doc_id", F.explode(kept).alias("k")).select("doc_id", "k.start_pos", "k.end_pos", "k.entity_type", "k.entity_text")
