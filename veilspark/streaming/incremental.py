"""Pseudonymise a stream of documents, micro-batch by micro-batch, with one growing mapping table.

Assignment depends on what was assigned before, so batches are taken one after the
other (foreachBatch) and each stores its new mappings before its documents.  Both go
to a folder of the batch, in place of what an attempt before may have left there, so
a batch that is run again gives the same rows once.  Names are stored in clear here;
ParquetStore encrypts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import assign, rewrite, spans
from ..functions import text as T
from ..sources.tables import kept
from pyspark.sql import functions as F

MAPPINGS = (
    "id string, entity_type string, first_name string, last_name string, full_name string, pseudonym_first string,"
    " pseudonym_last string, pseudonym_full string, theme string"
)


def mappings(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """The mapping table in a folder, of the batches before `batch` if given; empty if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if not exists:
        return spark.createDataFrame([], MAPPINGS)
    rows = spark.read.schema(MAPPINGS + ", batch long").parquet(folder)
    return (rows if batch is None else rows.where(F.col("batch") < batch)).drop("batch")


def one_batch(docs: DataFrame, store: str, out: str, batch: int = 0, ner=None) -> None:
    """Rewrite docs(doc_id, text) into the folder out; new mappings go to the folder store, each under batch=<batch>."""
    spark = docs.sparkSession
    found = kept(spans.all_detected(docs, ner, engine="arrow"))
    ids = kept(assign.neutral_ids(found, kept(mappings(spark, store, batch))))
    rows = found.join(ids.select("doc_id", "span_ord", "pseudonym"), ["doc_id", "span_ord"], "left")
    rows = rows.withColumn("replacement", F.concat(T.replacement_prefix("text", "entity_type"), "pseudonym"))
    assign.new_mappings(ids).write.mode("overwrite").parquet(f"{store}/batch={batch}")
    rewrite.rewritten(docs, rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")


def start(docs: DataFrame, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """Run over a streaming DataFrame of doc_id and text until what is there is done."""
    return (
        docs.writeStream.foreachBatch(lambda rows, batch: one_batch(rows, store, out, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
