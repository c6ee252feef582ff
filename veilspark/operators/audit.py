"""Queries on the operation log and on mappings, as a privacy team asks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import numbered


def operations(log: DataFrame, operation_type: str | None = None, success: bool | None = None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Matching operations, the latest first; start and end count."""
    rows = log
    if operation_type is not None:
        rows = rows.where(F.col("operation_type") == operation_type)
    if success is not None:
        rows = rows.where(F.col("success") == success)
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    rows = rows.orderBy(F.desc("ts"), "id")
    return rows if limit is None else rows.limit(limit)


def until_day(log: DataFrame, start: str | None, day: str) -> DataFrame:
    """Operations up to the last second of a day."""
    return operations(log, start=start, end=f"{day} 23:59:59")


def total_entities(log: DataFrame, operation_type: str | None = None, success: bool | None = True) -> DataFrame:
    rows = _matching(log, operation_type, success)
    return rows.agg(F.coalesce(F.sum("entity_count"), F.lit(0)).alias("total_entities"))


def _matching(log: DataFrame, operation_type: str | None, success: bool | None) -> DataFrame:
    rule = F.lit(True)
    if operation_type is not None:
        rule &= F.col("operation_type") == operation_type
    if success is not None:
        rule &= F.col("success") == success
    return log.where(rule)


def average_time(log: DataFrame, operation_type: str | None = None) -> DataFrame:
    return _matching(log, operation_type, True).agg(F.coalesce(F.avg("processing_time_seconds"), F.lit(0.0)).alias("avg_seconds"))


def failure_rate(log: DataFrame, operation_type: str | None = None) -> DataFrame:
    return _matching(log, operation_type, None).agg(F.coalesce(F.avg((~F.col("success")).cast("double")), F.lit(0.0)).alias("failure_rate"))


def eta(log: DataFrame, total: Column, window: int = 5) -> DataFrame:
    """id, seq and eta_seconds: the mean of the last durations of a batch, times what is left. log: batch, seq, id, processing_time_seconds."""
    last = Window.partitionBy("batch").orderBy("seq").rowsBetween(1 - window, 0)
    return log.withColumn("eta_seconds", F.avg("processing_time_seconds").over(last) * (total - F.col("seq")))


def batch_totals(results: DataFrame) -> DataFrame:
    """One row from results: success, entities_new, entities_reused, seconds, error."""
    return results.agg(
        F.count("*").alias("n_files"),
        F.count_if("success").alias("n_ok"),
        F.count_if(~F.col("success")).alias("n_failed"),
        F.coalesce(F.sum("entities_new"), F.lit(0)).alias("n_new"),
        F.coalesce(F.sum("entities_reused"), F.lit(0)).alias("n_reused"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
        F.array_join(F.sort_array(F.collect_set("error")), "; ").alias("errors"),
    )


def stats(mappings: DataFrame, log: DataFrame) -> DataFrame:
    """metric, value: counts by type and theme, ambiguous ones, operations by outcome, and the latest operation."""
    metric = lambda name, value: F.struct(name.alias("metric"), value.cast("string").alias("value"))
    kinds = mappings.groupBy("entity_type").count().select(metric(F.concat(F.lit("type:"), "entity_type"), F.col("count")).alias("x"))
    themes = mappings.groupBy("theme").count().select(metric(F.concat(F.lit("theme:"), "theme"), F.col("count")).alias("x"))
    own = mappings.agg(F.count_if("is_ambiguous").alias("a"), F.count("*").alias("n"))
    own = own.select(F.explode(F.array(metric(F.lit("ambiguous"), F.col("a")), metric(F.lit("mappings"), F.col("n")))).alias("x"))
    ops = log.agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.max_by("id", F.struct("ts", "id")).alias("last"))
    ops = ops.select(F.explode(F.array(metric(F.lit("operations"), F.col("n")), metric(F.lit("operations_ok"), F.col("ok")), metric(F.lit("last_operation"), F.col("last")))).alias("x"))
    return kinds.unionAll(themes).unionAll(own).unionAll(ops).select("x.*")


def flagged(mappings: DataFrame) -> DataFrame:
    return mappings.select("id", "full_name", "entity_type", T.review_flags("is_ambiguous", "confidence_score").alias("flags"))


def flag_totals(mappings: DataFrame) -> DataFrame:
    rows = flagged(mappings)
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("flags").contains("AMB")).alias("n_ambiguous"),
        F.count_if(F.col("flags").contains("LOW")).alias("n_low"),
    )


def listed(mappings: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Entities as a list shows them: id prefix, name, type, pseudonym and number of documents (mentions: doc_id, key)."""
    rows = mappings.select(F.substring("id", 1, 8).alias("id"), "full_name", "entity_type", "pseudonym_full")
    if mentions is None:
        return rows.withColumn("n_docs", F.lit(None).cast("long"))
    count = mentions.groupBy(F.col("key").alias("full_name")).agg(F.count_distinct("doc_id").alias("n_docs"))
    return rows.join(count, "full_name", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0))).select("id", "full_name", "entity_type", "pseudonym_full", "n_docs")


def erasure(goes: DataFrame, ts: Column) -> DataFrame:
    """The log row of a deletion: ids and types, neither names nor hashes of them, as a name is soon guessed from its hash."""
    kinds = F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", F.col("n").cast("string"))))) if "entity_type" in goes.columns else F.lit(None)
    by_kind = goes.groupBy("entity_type") if "entity_type" in goes.columns else goes.groupBy()
    rows = by_kind.agg(F.count("*").alias("n"), F.collect_list("id").alias("ids"))
    row = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entity_count"), F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"), kinds.alias("kinds"))
    return row.where("entity_count > 0").select(
        F.sha2(F.array_join("ids", ","), 256).alias("id"), ts.alias("ts"), F.lit("ERASURE").alias("operation_type"), "entity_count", F.lit(True).alias("success"),
        F.map_concat(F.create_map(F.lit("ids"), F.array_join("ids", ",")), F.coalesce("kinds", F.create_map().cast("map<string,string>"))).alias("user_modifications"),
    )


def exported_json(log: DataFrame, filters: dict[str, str], exported_at: Column) -> DataFrame:
    """One JSON document of the operations, the latest first, with the filters and the total, in rows (piece, json).

    The pieces in their order are the document's lines: 0 opens it with the metadata, a line an operation follows, the last
    closes it. No value and no task holds the whole export, however large the log is.
    """
    rows = numbered(log.withColumn("_t", F.negative(F.unix_micros(F.col("ts").cast("timestamp")))), ["_t", "id"], name="piece")
    comma = F.when(F.col("piece") > 1, ",").otherwise("")
    rows = rows.select(F.col("piece").cast("long").alias("piece"), F.concat(comma, F.to_json(F.struct(*log.columns))).alias("json"))
    meta = F.struct(exported_at.cast("string").alias("exported_at"), F.create_map(*[F.lit(v) for kv in sorted(filters.items()) for v in kv]).alias("filters") if filters else F.lit(None).alias("filters"), F.col("n").alias("total_results"))
    opens = F.concat(F.lit('{"export_metadata":'), F.to_json(meta), F.lit(',"operations":['))
    ends = F.array(F.struct(F.lit(0).cast("long").alias("piece"), opens.alias("json")), F.struct((F.col("n") + 1).alias("piece"), F.lit("]}").alias("json")))
    return rows.unionByName(log.agg(F.count("*").alias("n")).select(F.explode(ends).alias("e")).select("e.*"))


def exported_lines(log: DataFrame) -> DataFrame:
    return log.select(F.to_json(F.struct(*log.columns)).alias("value"))


def exported_csv(log: DataFrame) -> DataFrame:
    """The log with lists joined by commas, maps as JSON and empty strings for nulls."""
    kinds = dict(log.dtypes)

    def flat(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.array_join(c, ",")
        return F.to_json(c) if kinds[c].startswith(("map", "struct")) else F.col(c).cast("string")

    return log.select(*[F.coalesce(flat(c), F.lit("")).alias(c) for c in log.columns])
