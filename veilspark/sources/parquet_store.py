"""The mapping table and the log in a folder, for several writers, readable only with a passphrase if one is given.

Versions.  `versions/<n>.json` names the folders that make up version n.  A change writes new folders, then creates the
next version's file, which fails if another writer has created it; then the change is made anew on what that writer left.
So no writer loses another's rows, and a reader sees a whole version.

Keys.  A passphrase's key wraps the random data key of an epoch, which is kept in the version.  Rewriting the table
(deletion, import) begins a new epoch: the rows that stay are encrypted by a new key, and the old folders and versions,
with the old key in them, are deleted.  destroyed() keeps no key at all.

Look-up.  Every mapping stands under its full name and under each of its parts, by keyed hashes of these (the ids of
mappings are keyed hashes too).  Rows are in BUCKETS folders by hash, so a run reads the buckets of the names that it
met, and joins on hashes; only rows that match are decrypted.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto
from ..operators import assign, audit, store
from . import tables

MAPPINGS = (
    "id string, entity_type string, first_name string, last_name string, full_name string, pseudonym_first string, pseudonym_last string,"
    " pseudonym_full string, theme string, is_ambiguous boolean, ambiguity_reason string, confidence_score double, first_seen timestamp"
)
OPERATIONS = (
    "id string, ts timestamp, operation_type string, files_processed array<string>, user_modifications map<string,string>, model_name string,"
    " model_version string, theme_selected string, entity_count int, processing_time_seconds double, success boolean, error_message string"
)
BUCKETS = 64
#: Tries of a change that other writers keep overtaking.
TRIES = 50
#: What a row stands under.
_ROLES = ("full_name", "first_name", "last_name")


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """rows with a schema's columns, null where they are missing."""
    return rows.select(*[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.split(", "))])


class Overtaken(Exception):
    """Another writer has created the version first."""


@dataclass
class ParquetStore:
    """Mappings, encrypted if a passphrase is given, and operations as Parquet in a folder."""

    spark: SparkSession
    folder: str
    passphrase: str | None = field(default=None, repr=False)
    iterations: int = crypto.ITERATIONS

    def __post_init__(self):
        self.folder = self.folder.rstrip("/")
        if not self._versions():
            salt = crypto.new_salt()
            first = {"salt": salt.hex(), "iterations": self.iterations, "mappings": [], "operations": [], "numbers": {}}
            try:
                self._publish(0, first | {"key": self._locked(crypto.new_secret(), salt, self.iterations)})
            except Overtaken:
                pass
        self._secret(self.version()[1])

    # -- versions

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._path("versions")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def version(self) -> tuple[int, dict]:
        """The latest version's number and content."""
        for _ in range(TRIES):
            n = self._versions()[-1]
            try:
                rows = self.spark.read.text(f"{self.folder}/versions/{n:012d}.json", wholetext=True).collect()
                return n, json.loads(rows[0].value)
            except (AnalysisException, IndexError):  # a rewriting has just deleted it
                continue
        raise RuntimeError("the store's versions can't be read")

    def _publish(self, n: int, content: dict) -> None:
        """Create version n, or raise Overtaken if it exists: of several writers one succeeds."""
        name = f"versions/{n:012d}.json"
        fs, beside = self._path(f"versions/_{uuid.uuid4().hex}")
        _, path = self._path(name)
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a local rename looks first and then replaces; a link is created or not
                os.link(beside.toUri().getPath(), path.toUri().getPath())
            else:
                jvm = self.spark._jvm
                none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, path, none)
        except Exception as error:
            if fs.exists(path):
                raise Overtaken(name) from error
            raise
        finally:
            fs.delete(beside, False)

    def change(self, make: Callable[[dict], dict], rewrites: bool = False) -> None:
        """Publish make(latest version) as the next version; after a failure its new folders go. rewrites: older versions and folders go."""
        for _ in range(TRIES):
            n, now = self.version()
            new: dict = {}
            try:
                new = make(dict(now))
                self._publish(n + 1, new)
            except BaseException as error:
                self._forget(self._folders(new) - self._folders(now))
                if isinstance(error, Overtaken):
                    continue
                raise
            if rewrites:
                self._forget(self._folders(now) - self._folders(new) | {f"versions/{k:012d}.json" for k in self._versions() if k <= n})
            return
        raise RuntimeError("other writers kept overtaking this one")

    @staticmethod
    def _folders(content: dict) -> set[str]:
        return {*content.get("mappings", []), *content.get("operations", [])}

    def _forget(self, names: set[str]) -> None:
        for name in names:
            fs, path = self._path(name)
            fs.delete(path, True)

    # -- keys

    def _locked(self, secret: bytes, salt: bytes, iterations: int) -> str:
        """A data key as a version keeps it: wrapped, or in clear where there is no passphrase."""
        return crypto.wrapped(self.spark, secret, crypto.derive(self.passphrase, salt, iterations)) if self.passphrase else "clear:" + secret.hex()

    def _secret(self, content: dict) -> crypto.Keys:
        found = content["key"]
        if found is None:
            raise PermissionError("the keys of this store are destroyed")
        if found.startswith("clear:") != (self.passphrase is None):
            raise PermissionError("the passphrase doesn't fit this store")
        if self.passphrase is None:
            return crypto.Keys.of(bytes.fromhex(found.removeprefix("clear:")))
        secret = crypto.unwrapped(self.spark, found, crypto.derive(self.passphrase, bytes.fromhex(content["salt"]), content["iterations"]))
        if secret is None:
            raise PermissionError("the passphrase doesn't fit this store")
        return crypto.Keys.of(secret)

    # -- mappings

    def _hashed(self, rows: DataFrame, value: str, keys: crypto.Keys) -> DataFrame:
        """rows with `token`, the keyed hash of a value, and its bucket."""
        return crypto.with_keyed_hashes(rows, {"token": F.col(value)}, keys).withColumn("bucket", F.pmod(F.crc32("token"), F.lit(BUCKETS)).cast("int"))

    def _written(self, rows: DataFrame, keys: crypto.Keys, keep_ids: bool) -> str:
        """Write mapping rows into a folder of their own, under their names and parts; the folder's name."""
        name = f"mappings/part={uuid.uuid4().hex}"
        rows = typed(rows, MAPPINGS)
        if not keep_ids:
            rows = crypto.with_keyed_hashes(rows, {"_id": F.concat_ws("|", "entity_type", "full_name")}, keys).withColumn("id", F.substring("_id", 1, 32)).drop("_id")
        roles = F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).alias("_value")) for c in _ROLES])
        rows = self._hashed(rows.select("*", F.inline(roles)).where("_value IS NOT NULL"), "_value", keys).drop("_value")
        rows = store.encrypted(rows, keys) if self.passphrase else rows
        rows.repartition("bucket").write.partitionBy("role", "bucket").parquet(f"{self.folder}/{name}")
        return name

    def _rows(self, content: dict) -> DataFrame:
        schema = f"{MAPPINGS}, token string, part string, role string, bucket int"
        paths = [f"{self.folder}/{name}" for name in content["mappings"]]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/mappings")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _opened(self, rows: DataFrame, keys: crypto.Keys) -> DataFrame:
        rows = rows.drop("token", "part", "role", "bucket")
        return store.decrypted(rows, keys) if self.passphrase else rows

    def mappings(self, content: dict | None = None) -> DataFrame:
        """All mapping rows."""
        content = content or self.version()[1]
        return self._opened(self._rows(content).where("role = 'full_name'"), self._secret(content))

    def lookup(self, names: DataFrame, content: dict | None = None) -> DataFrame:
        """Mapping rows whose full name, or a part of it, is one of names(value). Only the names' buckets are read."""
        content = content or self.version()[1]
        keys = self._secret(content)
        wanted = self._hashed(names.select("value").where("value IS NOT NULL").distinct(), "value", keys).select("token", "bucket")
        buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
        rows = self._rows(content).where(F.col("bucket").isin(buckets)).join(wanted.select("token"), "token", "left_semi")
        return self._opened(rows.dropDuplicates(["id"]), keys)

    def numbers(self, content: dict | None = None) -> DataFrame:
        """entity_type and base, the largest number given so far."""
        content = content or self.version()[1]
        return self.spark.createDataFrame(list(content["numbers"].items()), "entity_type string, base long")

    def _numbered(self, numbers: dict, rows: DataFrame) -> dict:
        found = {r.entity_type: int(r.base) for r in assign.counters(rows).collect()}  # a row a type
        return numbers | {kind: max(n, numbers.get(kind, 0)) for kind, n in found.items()}

    def added(self, content: dict, new: DataFrame) -> dict:
        """A version's content with new mapping rows; for change()."""
        name = self._written(new, self._secret(content), False)
        return content | {"mappings": [*content["mappings"], name], "numbers": self._numbered(content["numbers"], new)}

    def logged(self, content: dict, row: DataFrame) -> dict:
        """A version's content with a log row; for change()."""
        name = f"operations/{uuid.uuid4().hex}"
        typed(row, OPERATIONS).coalesce(1).write.parquet(f"{self.folder}/{name}")
        return content | {"operations": [*content["operations"], name]}

    def rewritten(self, content: dict, rows: DataFrame) -> dict:
        """A version's content with other mapping rows in place of all, under a new data key; for change()."""
        secret = crypto.new_secret()
        content = content | {"key": self._locked(secret, bytes.fromhex(content["salt"]), content["iterations"])}
        return content | {"mappings": [self._written(rows, crypto.Keys.of(secret), True)], "numbers": self._numbered(content["numbers"], rows)}

    def add(self, new: DataFrame) -> None:
        """Add mapping rows of names that have none yet; what another writer has added meanwhile isn't added again."""

        def make(content: dict) -> dict:
            known = self.lookup(new.select(F.col("full_name").alias("value")), content)
            return self.added(content, store.saved(known, typed(new, MAPPINGS)).join(known.select("full_name"), "full_name", "left_anti"))

        self.change(make)

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Put change(all mapping rows) in their place."""
        self.change(lambda content: self.rewritten(content, change(self.mappings(content))), True)

    # -- the log

    def operations(self) -> DataFrame:
        paths = [f"{self.folder}/{name}" for name in self.version()[1]["operations"]]
        return self.spark.read.schema(OPERATIONS).parquet(*paths) if paths else self.spark.createDataFrame([], OPERATIONS)

    def log(self, row: DataFrame) -> None:
        self.change(lambda content: self.logged(content, row))

    # -- erasure

    def erase(self, key: str) -> DataFrame:
        """Delete one mapping by name, id or unique id prefix, and log it without its name, both in one version."""
        rows: list = []

        def make(content: dict) -> dict:
            left, gone = store.deleted(self.mappings(content), key)
            rows[:] = audit.erasure(gone, F.current_timestamp()).collect()  # one row
            return self.logged(self.rewritten(content, left), self._row(rows))

        self.change(make, True)
        return self._row(rows)

    def _row(self, rows: list) -> DataFrame:
        return self.spark.createDataFrame(rows, "id string, ts timestamp, operation_type string, entity_count long, success boolean, user_modifications map<string,string>")

    def destroy(self) -> None:
        """Delete all mappings and keep no key: what copies of the folder may still be anywhere can't be read. The log stays."""
        self.change(lambda content: content | {"key": None, "mappings": [], "numbers": {}}, True)
