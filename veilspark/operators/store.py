"""The mapping table and the key-value metadata: lookups, saving, deletion, import, consistency.

Tables are DataFrames; a change returns the table as it is afterwards, and the caller
writes it where it belongs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions import text as T

SECRET = ("first_name", "last_name", "full_name", "pseudonym_first", "pseudonym_last", "pseudonym_full")


def by_full_name(mappings: DataFrame, name: str) -> DataFrame:
    return mappings.where(F.col("full_name") == name)


def by_component(mappings: DataFrame, component: str, role: str) -> DataFrame:
    """role: first_name or last_name."""
    if role not in ("first_name", "last_name"):
        raise ValueError(role)
    return mappings.where((F.col("entity_type") == "PERSON") & (F.col(role) == component))


def find_all(mappings: DataFrame, entity_type: str | None = None, ambiguous: bool | None = None) -> DataFrame:
    rows = mappings if entity_type is None else mappings.where(F.col("entity_type") == entity_type)
    return rows if ambiguous is None else rows.where(F.col("is_ambiguous") == ambiguous)


def search(mappings: DataFrame, term: str, columns: tuple[str, ...] = ("full_name", "pseudonym_full")) -> DataFrame:
    """Rows with the term, whatever its case, in a name."""
    rule = F.lit(False)
    for c in columns:
        rule |= F.lower(c).contains(term.lower())
    return mappings.where(F.coalesce(rule, F.lit(False)))


def saved(mappings: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """mappings and the rows of new whose full_name is not among them; of equal new names the smallest id's. strict: duplicates raise."""
    first = Window.partitionBy("full_name").orderBy("id")
    own = new.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    fresh = own.join(mappings.select("full_name"), "full_name", "left_anti").select(*mappings.columns)
    if strict and fresh.count() < new.count():
        raise ValueError("some of the names have a mapping already")
    return mappings.unionByName(fresh)


def replaced(mappings: DataFrame, new: DataFrame) -> DataFrame:
    """As saved(), but new rows take the place of old ones, whose id and first_seen stay."""
    first = Window.partitionBy("full_name").orderBy("id")
    own = new.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    kept = [c for c in ("id", "first_seen") if c in mappings.columns]
    old = mappings.select("full_name", *[F.col(c).alias(f"_{c}") for c in kept])
    changed = own.join(old, "full_name", "left")
    changed = changed.select(*[(F.coalesce(f"_{c}", c) if c in kept else F.col(c)).alias(c) for c in mappings.columns])
    return mappings.join(own.select("full_name"), "full_name", "left_anti").select(*mappings.columns).unionByName(changed)


def import_counts(mappings: DataFrame, new: DataFrame) -> DataFrame:
    """n_imported and n_skipped of an import that skips what exists."""
    known = mappings.select("full_name", F.lit(True).alias("_old")).distinct()
    rows = new.join(known, "full_name", "left").groupBy("full_name").agg(F.count("*").alias("n"), F.max("_old").alias("old"))
    imported = F.count_if(F.col("old").isNull())
    return rows.agg(imported.alias("n_imported"), (F.coalesce(F.sum("n"), F.lit(0)) - imported).alias("n_skipped"))


def deleted(mappings: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what is left, what goes) for a full name, an id or a prefix that only one id has."""
    exact = (F.col("full_name") == key) | (F.col("id") == key)
    if mappings.where(exact).limit(1).count():
        return mappings.where(~exact), mappings.where(exact)
    starts = F.col("id").startswith(key)
    n = mappings.where(starts).limit(2).count() if key else 0
    if n != 1:
        raise KeyError(f"{key!r} is not one mapping")
    return mappings.where(~starts), mappings.where(starts)


def bulk_deleted(mappings: DataFrame, ids: DataFrame) -> DataFrame:
    return mappings.join(ids.select("id").distinct(), "id", "left_anti").select(*mappings.columns)


def encrypted(mappings: DataFrame, keys: crypto.Keys) -> DataFrame:
    return crypto.encrypted(mappings, [c for c in SECRET if c in mappings.columns], keys)


def decrypted(mappings: DataFrame, keys: crypto.Keys) -> DataFrame:
    return crypto.decrypted(mappings, [c for c in SECRET if c in mappings.columns], keys)


def duplicates(mappings: DataFrame) -> DataFrame:
    """kind, value, n: full names and pseudonyms that stand more than once."""
    rows = mappings.select(F.explode(F.array(F.struct(F.lit("full_name").alias("kind"), F.col("full_name").alias("value")), F.struct(F.lit("pseudonym").alias("kind"), F.col("pseudonym_full").alias("value")))).alias("x"))
    return rows.groupBy("x.kind", "x.value").agg(F.count("*").alias("n")).where("n > 1")


def consistency(mappings: DataFrame, log: DataFrame) -> DataFrame:
    """measure, n: size of the table, names and pseudonyms that several people have, and operations by outcome."""
    people = mappings.where("entity_type = 'PERSON'")

    twice = lambda column: people.groupBy(column).count().where("count > 1")
    told = lambda df, measure: df.agg(F.lit(measure).alias("measure"), F.count("*").alias("n"))
    sizes = [
        (mappings, "mappings"),
        (twice("pseudonym_full"), "shared_pseudonyms"),
        (twice("full_name"), "shared_names"),
        (log, "operations"),
        (log.where("success"), "succeeded"),
        (log.where("NOT success"), "failed"),
    ]
    return reduce(DataFrame.unionAll, [told(df, measure) for df, measure in sizes])


# -- metadata


def upserted(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value, updated_at: the latest of each key; a null value deletes it."""
    order = Window.partitionBy("key").orderBy(F.desc("updated_at"), F.desc("value"))
    rows = metadata.unionByName(changes).withColumn("_r", F.row_number().over(order))
    return rows.where("_r = 1 AND value IS NOT NULL").drop("_r")


def file_hashes(files: DataFrame) -> DataFrame:
    """key and value of file-hash entries, from path and content."""
    return files.select(F.concat(F.lit("file:"), "path", F.lit(":hash")).alias("key"), F.sha2("content", 256).alias("value"))


def processed_paths(metadata: DataFrame) -> DataFrame:
    return metadata.select(T.path_of_key("key").alias("path")).where("path IS NOT NULL")


def unprocessed(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files whose content has no entry under their path yet."""
    known = metadata.select(T.path_of_key("key").alias("path"), F.col("value").alias("_h")).where("path IS NOT NULL")
    rows = files.withColumn("_h", F.sha2("content", 256))
    return rows.join(known, ["path", "_h"], "left_anti").select(*files.columns)
