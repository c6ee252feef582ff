"""A sink of whole files: one file a row, under the row's own name, all of them or none.

Each task writes into a folder of its own below `_writing-<job>`; the commit moves the files to their names, so a failed
or repeated task leaves nothing that a reader sees.  Executors reach the folder through Arrow's file systems (local,
HDFS, S3, GCS), so its path or URI must mean the same on all of them.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.rstrip("/"))


def checked(name: str) -> str:
    """A name is a path below the folder and can't lead out of it."""
    found = posixpath.normpath(name.lstrip("/"))
    if found in ("", ".", "..") or found.startswith("../"):
        raise ValueError("a file's name must be a path below the folder")
    return found


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.work = folder, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = _opened(self.folder)
        mine, names = f"{self.work}/{uuid.uuid4().hex}", []
        for row in iterator:
            name = checked(row.name)
            path = f"{root}/{mine}/{name}"
            store.create_dir(posixpath.dirname(path), recursive=True)
            with store.open_output_stream(path) as out:
                out.write(bytes(row.content))
            names.append(name)
        return Written(mine, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _opened(self.folder)
        made: set[str] = set()
        for m in messages:
            for name in m.names if m else ():
                above = posixpath.dirname(f"{root}/{name}")
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                store.move(f"{root}/{m.folder}/{name}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.folder))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.work}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.work}")


class FileSink(DataSource):
    """df(name string, content binary).write.format("whole_files").mode("append").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Write rows(name, content) as files below a folder; a file of that name is replaced."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format("whole_files").mode("append").save(folder)
