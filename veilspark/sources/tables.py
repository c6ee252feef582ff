"""Tables kept between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that were kept since the innermost scope() began.
_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


def work_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which executors share; a session of threads alone gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, stays: bool = False) -> DataFrame:
    """df, written once as Parquet to the shared work folder and read again.

    What several joins read is then computed once, and a lost executor costs no more than a read. Inside scope() the
    files go when the scope ends, unless they are to stay.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}.parquet"
    made = _MADE.get()
    if made is not None and not stays:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a kept table that nothing reads any more."""
    for name in df.inputFiles()[:1]:
        delete(df.sparkSession, name.rsplit("/", 1)[0])


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is kept inside is deleted at the end, whatever happens: names in clear don't outlive the run that needs them."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            delete(spark, path)
