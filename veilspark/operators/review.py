"""Review: what people decided about spans, folded onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ORDER = {"PERSON": 1, "ORG": 2, "LOCATION": 3}
MANY, SECONDS_EACH = 100, 6


def known(rows: DataFrame, mappings: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(known, unknown): rows whose key has a mapping, and the others."""
    names = mappings.select(F.col("full_name").alias(key)).distinct()
    return rows.join(names, key, "left_semi").select(*rows.columns), rows.join(names, key, "left_anti").select(*rows.columns)


def validated(spans: DataFrame, decisions: DataFrame, custom: bool = False) -> DataFrame:
    """Spans that were confirmed, then those added by hand.

    decisions: doc_id, span_id, seq, action (CONFIRM, MODIFY, CHANGE_PSEUDONYM, REJECT, ADD), new_text, new_pseudonym,
    and for ADD entity_type, start_pos, end_pos. One REJECT outweighs all else; the last MODIFY gives the text.
    custom: the last chosen pseudonym is carried along.
    """
    by = decisions.where("action <> 'ADD'").groupBy("doc_id", "span_id").agg(
        F.bool_or(F.col("action") == "REJECT").alias("rejected"),
        F.bool_or(F.col("action").isin("CONFIRM", "MODIFY", "CHANGE_PSEUDONYM")).alias("kept"),
        F.max_by(F.when(F.col("action") == "MODIFY", F.col("new_text")), F.when(F.col("action") == "MODIFY", F.col("seq"))).alias("changed"),
        F.max_by(F.when(F.col("action") == "CHANGE_PSEUDONYM", F.col("new_pseudonym")), F.when(F.col("action") == "CHANGE_PSEUDONYM", F.col("seq"))).alias("chosen"),
    )
    # decisions are as many as spans, and pack well: they only look small enough to be sent to all tasks
    rows = spans.join(by.hint("merge"), ["doc_id", "span_id"]).where("kept AND NOT rejected")
    columns = ["doc_id", "span_id", F.coalesce("changed", "text").alias("text"), "entity_type", "start_pos", "end_pos", F.lit(False).alias("added")]
    more = ["chosen"] if custom else []
    added = decisions.where("action = 'ADD'").select("doc_id", "span_id", F.col("new_text").alias("text"), "entity_type", "start_pos", "end_pos", F.lit(True).alias("added"), *([F.col("new_pseudonym").alias("chosen")] if custom else []))
    return rows.select(*columns, *more).unionByName(added)


def by_state(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spans whose last decision keeps them; without one they are pending and go."""
    last = decisions.groupBy("doc_id", "span_id").agg(F.max_by(F.struct("action", "new_text"), "seq").alias("d"))
    rows = spans.join(last, ["doc_id", "span_id"]).where("d.action <> 'REJECT'")
    return rows.withColumn("text", F.coalesce("d.new_text", "text")).drop("d")


def summary(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Number of spans by what happened to them."""
    last = decisions.groupBy("doc_id", "span_id").agg(F.max_by("action", "seq").alias("action"))
    rows = spans.select("doc_id", "span_id").join(last, ["doc_id", "span_id"], "full")
    state = F.coalesce("action", F.lit("PENDING"))
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def added_by_hand(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc_id, entity_text, entity_type) with the first place in the text, or an error where there is none."""
    rows = wanted.join(docs.select("doc_id", "text"), "doc_id", "left")
    at = F.call_function("locate", F.col("entity_text"), F.coalesce("text", F.lit("")))
    found = (at > 0) & (F.col("entity_text") != "")
    start = F.when(found, at - 1)
    return rows.select(
        "doc_id", "entity_text", "entity_type", start.alias("start_pos"), (start + F.length("entity_text")).alias("end_pos"),
        F.when(~found, "not found in the document").alias("error"),
    )


def review_order(spans: DataFrame) -> DataFrame:
    """spans with review_ord: people, then organisations, then places, each by place."""
    from pyspark.sql import Window

    return spans.withColumn("review_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank("entity_type"), "start_pos", "end_pos", "text")))


def rank(entity_type: Column | str) -> Column:
    kind = T.col(entity_type)
    out = F.lit(9)
    for name, k in ORDER.items():
        out = F.when(kind == name, k).otherwise(out)
    return out


def large_documents(spans: DataFrame) -> DataFrame:
    """Documents with many spans and the minutes that their review will take."""
    rows = spans.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= MANY)
    return rows.withColumn("minutes", F.round(F.col("n") * SECONDS_EACH / 60, 1))


def counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_unique"))


def with_canonical(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    """Decisions on group canonicals (doc_id, entity_type, canonical, action) carried to every occurrence."""
    rows = groups.select("doc_id", "entity_type", "canonical", F.explode("occurrences").alias("o"))
    rows = rows.join(chosen, ["doc_id", "entity_type", "canonical"])
    return rows.select("doc_id", "entity_type", "o.text", "o.start_pos", "o.end_pos", "action")
