"""Helpers that the operators share: shared-folder tables and column checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of at most this number (8 bytes each) are broadcast; beyond it, a shuffled join is used.
BROADCAST_IDS = 1_000_000

SPACES = "\t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, written once to the shared folder as Parquet and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def head_of_counts(counts: DataFrame, n: str, limit: int) -> int:
    """The least power of two such that at most `limit` rows have a count n of at least that.

    Those rows can be broadcast.  Of the rest none is hot: more than `limit` rows have at least half the count of any of them.
    """
    bits = counts.groupBy(F.length(F.bin(n)).alias("bits")).count().collect()  # 64 rows at most
    least, total = 1 << max((r["bits"] for r in bits), default=0), 0
    for r in sorted(bits, key=lambda r: -r["bits"]):
        total += r["count"]
        if total > limit:
            break
        least = 1 << (r["bits"] - 1)
    return least


def dropped(df: DataFrame) -> None:
    """Delete the files behind a stored() table that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_ids(df: DataFrame, ids: DataFrame, n_ids: int, how: str) -> DataFrame:
    """df left_semi or left_anti ids on doc_id, by broadcast only if there are few enough ids."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id", how)


def words(text: Column) -> Column:
    """Words of a text: runs of characters outside 0x20 and 0x09-0x0D. A null text has none."""
    return F.array_remove(F.split(flat(F.coalesce(text, F.lit(""))), " "), "")


def flat(text: Column) -> Column:
    """text with blanks for all other white space; replace() passes over a text that hasn't the character."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACES + " ")) != ""
