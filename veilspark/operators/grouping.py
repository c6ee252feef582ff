"""Variant grouping: which spellings of a document's entities are one entity.

The union of person variants has a closed form, so no graph is built: a name of two
words or more is keyed by its first and last word; a single word joins the one
bearer of that last name if there is exactly one, and otherwise stands alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def with_cluster(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """spans with `cluster`, equal within a document and type for variants of one entity."""
    keys = keys or ["doc_id"]
    form = T.grouping_form("text", "entity_type")
    w = T.words(form)
    rows = spans.withColumns({"_form": form, "_n": F.size(w), "_first": F.lower(F.get(w, F.lit(0))), "_last": F.lower(F.element_at(F.when(F.size(w) > 0, w), -1))})
    person = F.col("entity_type") == "PERSON"
    whole = person & (F.col("_n") >= 2)
    bearers = F.collect_set(F.when(whole, F.col("_first"))).over(Window.partitionBy(*keys, "_last", person))
    rows = rows.withColumn("_bearers", F.when(person & (F.col("_n") == 1), bearers))
    key = (
        F.when(~person, F.concat(F.lit("f:"), F.col("_form")))
        .when(whole, F.concat_ws("\x1f", F.lit("m"), "_first", "_last"))
        .when((F.col("_n") == 1) & (F.size("_bearers") == 1), F.concat_ws("\x1f", F.lit("m"), F.get("_bearers", F.lit(0)), "_last"))
        .when((F.col("_n") == 1) & (F.size("_bearers") == 0), F.concat(F.lit("s:"), F.col("_last")))
        .otherwise(F.concat(F.lit("r:"), F.col("text")))
    )
    return rows.withColumn("cluster", key).drop("_form", "_n", "_first", "_last", "_bearers")


def groups(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row a variant group: canonical (longest text, then earliest), occurrences by place, variants, count and first place."""
    keys = keys or ["doc_id"]
    rows = with_cluster(spans, keys)
    longest = F.struct(F.length("text"), F.negative("start_pos"), F.negative("end_pos"))
    return rows.groupBy(*keys, "entity_type", "cluster").agg(
        F.max_by("text", longest).alias("canonical"),
        F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "text"))).alias("occurrences"),
        F.sort_array(F.collect_set("text")).alias("variants"),
        F.count("*").alias("n"),
        F.min("start_pos").alias("first_pos"),
    )


def exact_groups(spans: DataFrame) -> DataFrame:
    """Places of each distinct text of a document."""
    return spans.groupBy("doc_id", "text").agg(F.sort_array(F.collect_list("start_pos")).alias("starts"))


def expanded(grouped: DataFrame) -> DataFrame:
    """Every occurrence of each group, with the group's canonical text."""
    rows = grouped.select("doc_id", "entity_type", "canonical", F.explode("occurrences").alias("o"))
    return rows.select("doc_id", "entity_type", "canonical", "o.start_pos", "o.end_pos", "o.text")


def component(form: Column, place: int) -> Column:
    return F.get(T.words(form), F.lit(place))
