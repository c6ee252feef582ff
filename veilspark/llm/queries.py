"""Queries opN_<name> over the driver's tables, and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, filter_audit, jaccard_join, language, line_dedup, lm, mixing, packing, quality, sharding, sql, toxicity
from .common import read


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.placed(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_lines",
        "n_deleted",
        F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted_lines"),
        F.length("text").cast("long").alias("kept_chars"),
        F.md5("text").alias("kept_md5"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(read(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))
    return found.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "block_key", "doc_key")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.segments(read(spark, sf_dir, "conversations"))
    return found.select(
        "conv_id",
        "perspective",
        F.col("position").cast("long").alias("position"),
        "role_as",
        "mask",
        F.col("char_start").cast("long").alias("char_start"),
        F.col("mask_start").cast("long").alias("mask_start"),
        F.col("char_end").cast("long").alias("char_end"),
        "segment",
        F.md5("segment").alias("segment_md5"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = language.classify(docs, docs.where(F.col("doc_id").isNotNull() & ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.classify(read(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return quality.judge(read(spark, sf_dir, "documents"), labels.where("quality = 1"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can say the same: checksums, ring walks, 64-bit hashes and learned models are tested in Python."""
    return {
        "op1_ngram_jaccard_join": sql.OP1,
        "op3_line_dedup": sql.OP3,
        "op5_mixing_sources": sql.OP5,
        "op6_chat_formatting": sql.OP6,
        "op12_filter_audit": sql.OP12,
    }
