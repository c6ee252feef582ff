"""Whole runs: a folder of documents in, pseudonymised ones out, with the mapping table and the log kept in a store.

A run has two phases where people decide: preview() shows the spans, with keys that stay the same, and process() applies
what was decided about them.  Tables are documents of many units: each cell is detected and rewritten by itself, names
are given to the document as a whole.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lookup
from ..functions import patterns as P
from ..functions import text as T
from ..operators import assign, review, rewrite, spans, store
from ..sources import cells, file_sink, files
from ..sources.parquet_store import MAPPINGS, OPERATIONS, ParquetStore, typed  # noqa: F401
from ..sources.tables import dropped, kept, scope

#: A span's order has its unit's number and its place among the unit's spans in it; spans added by hand come after all.
SPAN_BITS, ADDED = 20, 1 << 62


class Detector(Protocol):
    """What finds spans: documents (doc_id, text) to doc_id, text, entity_type, start_pos, end_pos, confidence.

    A detector may have `info`, a dict with its name and version, which the log keeps.
    """

    def __call__(self, docs: DataFrame) -> DataFrame: ...


class Assigner(Protocol):
    """What gives pseudonyms: mentions and stored mappings to mentions with `pseudonym`, and new mapping rows.

    With `by_lookup` set, it gets only the mappings that the mentions' names stand under, and the largest numbers in use.
    """

    def __call__(self, mentions: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class Store(Protocol):
    """Where mappings and operations are. change(make) publishes make(content), and makes it anew if it was overtaken."""

    def mappings(self, content: dict | None = None) -> DataFrame: ...

    def lookup(self, names: DataFrame, content: dict | None = None) -> DataFrame: ...

    def numbers(self, content: dict | None = None) -> DataFrame: ...

    def change(self, make: Callable[[dict], dict]) -> None: ...

    def added(self, content: dict, new: DataFrame) -> dict: ...

    def logged(self, content: dict, row: DataFrame) -> dict: ...

    def log(self, row: DataFrame) -> None: ...


def neutral(mentions: DataFrame, mappings: DataFrame, numbers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbers as pseudonyms."""
    found = kept(assign.neutral_ids(mentions, mappings, numbers=numbers))
    return found, assign.new_mappings(found)


neutral.by_lookup = True


def themed(library: dict, secret: str) -> Assigner:
    """Names of a library as pseudonyms; stored names, and the parts of stored people, stay as they are."""

    def run(mentions: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark = mentions.sparkSession
        pool = lookup.pool(spark, lookup.pool_rows(library))
        return assign.library_ids(mentions, pool, library["theme"], secret, lookup.genders(spark), mappings)

    return run


# -- documents and their units


def found_spans(docs: DataFrame, detector: Detector, types: list[str] = P.ENTITY_TYPES) -> DataFrame:
    """Spans of docs(doc_id, text) or of their units (doc_id, unit_ord, text): doc_id, unit_ord, span_ord, span_id, ...

    span_id is made of the unit, the text and its place: a later run on the same text finds the same one.
    """
    if "unit_ord" not in docs.columns:
        docs = docs.withColumn("unit_ord", F.lit(0).cast("long"))
    own = docs.select(F.struct("doc_id", "unit_ord").alias("doc_id"), "text")
    rows = spans.only_types(detector(own), list(types))
    rows = rows.withColumn("unit_ord", F.col("doc_id.unit_ord")).withColumn("doc_id", F.col("doc_id.doc_id"))
    rows = rows.withColumn("span_ord", F.shiftleft("unit_ord", SPAN_BITS) + F.col("span_ord"))
    key = T.span_key("text", "start_pos")
    return rows.withColumn("span_id", F.when(F.col("unit_ord") == 0, key).otherwise(F.concat_ws(":", "unit_ord", key)))


def given(found: DataFrame, keep_mappings: DataFrame, assigner: Assigner, numbers: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if getattr(assigner, "by_lookup", False):
        return assigner(found, keep_mappings, numbers)
    return assigner(found, keep_mappings)


def preview(docs: DataFrame, detector: Detector = spans.all_detected, assigner: Assigner = neutral, mappings: DataFrame | None = None) -> DataFrame:
    """Each span that would be replaced, overlaps resolved as in rewriting, with its replacement and its key for decisions.

    Nothing is stored, so no number is used up. The rows are names in clear: inside tables.scope() their files go with it.
    """
    found = kept(found_spans(docs, detector))
    none = docs.sparkSession.createDataFrame([], MAPPINGS)
    ids, _ = given(found, none if mappings is None else mappings, assigner, None)
    rows = rewrite.without_overlaps(found, ["doc_id", "unit_ord"])
    rows = rows.join(ids.select("doc_id", "span_ord", "pseudonym"), ["doc_id", "span_ord"], "left")
    shown = F.coalesce(F.concat(T.preview_title("text"), "pseudonym"), F.concat(F.lit("["), "entity_type", F.lit("_PREVIEW]")))
    return rows.withColumn("preview", F.when(F.col("entity_type") == "PERSON", shown).otherwise(F.coalesce("pseudonym", shown)))


def decided(docs: DataFrame, found: DataFrame, decisions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Spans as people left them, with `chosen`, a pseudonym of their own choice.

    Spans whose name has a mapping are accepted as they are. Of the others those stay that were confirmed, under their new
    text if it was modified, and those that were added by hand follow; without a place they get the text's first one.
    decisions: as review.validated() has them, with unit_ord where documents have units.
    """
    known = mappings.select(F.col("full_name").alias("_key")).distinct()
    keyed = found.withColumn("_key", T.normal_form("text", "entity_type"))
    accepted = keyed.join(known, "_key", "left_semi").withColumn("chosen", F.lit(None).cast("string"))
    rows = review.validated(keyed.join(known, "_key", "left_anti").drop("_key"), decisions.where("action <> 'ADD'"), custom=True)
    order = found.select("doc_id", "span_id", "unit_ord", "span_ord")
    unit = F.coalesce("unit_ord", F.lit(0)).cast("long") if "unit_ord" in decisions.columns else F.lit(0).cast("long")
    added = decisions.where("action = 'ADD'").select("doc_id", unit.alias("unit_ord"), F.col("new_text").alias("text"), "entity_type", "start_pos", "end_pos", F.col("new_pseudonym").alias("chosen"))
    text = docs.select("doc_id", docs["unit_ord"] if "unit_ord" in docs.columns else F.lit(0).cast("long").alias("unit_ord"), F.col("text").alias("_text"))
    first = F.call_function("locate", F.col("text"), F.col("_text"))
    added = added.join(text, ["doc_id", "unit_ord"]).withColumn("_at", F.coalesce("start_pos", F.when((first > 0) & (F.col("text") != ""), first - 1)))
    added = added.where("_at IS NOT NULL").withColumn("start_pos", F.col("_at").cast("int")).withColumn("end_pos", F.coalesce("end_pos", F.col("_at") + F.length("text")).cast("int"))
    # spans added by hand are few
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_ord", "start_pos", "end_pos", "text", "entity_type"))
    added = added.withColumn("span_ord", F.lit(ADDED) + place)
    columns = ["doc_id", "unit_ord", "span_ord", "text", "entity_type", "start_pos", "end_pos", "chosen"]
    return accepted.select(columns).unionByName(rows.join(order.hint("merge"), ["doc_id", "span_id"]).select(columns)).unionByName(added.select(columns))


def own_choices(rows: DataFrame, theme: str) -> DataFrame:
    """Mapping rows of the pseudonyms that people chose: of several for one name the first by document and place."""
    mine = assign.mentions(rows.where("chosen IS NOT NULL")).where("key <> ''")
    first = F.min_by(F.struct("entity_type", "first", "last", "chosen"), F.struct("doc_id", "span_ord"))
    mine = mine.groupBy("key").agg(first.alias("m"))
    person = F.col("m.entity_type") == "PERSON"
    return typed(
        mine.select(
            F.substring(F.sha2("key", 256), 1, 32).alias("id"),
            "m.entity_type",
            F.when(person, F.col("m.first")).alias("first_name"),
            F.when(person, F.col("m.last")).alias("last_name"),
            F.col("key").alias("full_name"),
            F.col("m.chosen").alias("pseudonym_full"),
            F.lit(theme).alias("theme"),
        ),
        MAPPINGS,
    )


_LOGGED = "id string, operation_type string, model_name string, model_version string, theme_selected string, entity_count int, processing_time_seconds double, success boolean, error_message string, user_modifications map<string,string>"


def process(
    docs: DataFrame,
    keep: Store,
    detector: Detector = spans.all_detected,
    assigner: Assigner = neutral,
    types: list[str] = P.ENTITY_TYPES,
    theme: str = "neutral_id",
    notify: Callable[[str], None] | None = None,
    decisions: DataFrame | None = None,
) -> DataFrame:
    """doc_id, text (rewritten) and n_replaced of docs(doc_id, text), or of their units with unit_ord.

    New mappings and a log row go to the store, in one version; a failure leaves a log row that says so, without names.
    decisions: what people decided about the spans that preview() showed; without it all are accepted. The same
    decisions again change nothing. notify is called on the driver with a message after each step; messages have numbers,
    never names. Work tables with names are deleted at the end.
    """
    spark, began, info = docs.sparkSession, time.time(), spans.detector_info(detector)

    def row(n: int | None, error: str | None = None, counts: dict | None = None) -> DataFrame:
        one = (uuid.uuid4().hex, "PROCESS", info.get("name"), info.get("version"), theme, n, time.time() - began, error is None, error, counts)
        return spark.createDataFrame([one], _LOGGED).withColumn("ts", F.current_timestamp())

    with scope(spark):
        try:
            return _processed(docs, keep, detector, assigner, types, theme, notify or (lambda message: None), decisions, row)
        except Exception as error:
            message = spark.createDataFrame([(f"{type(error).__name__}: {str(error).splitlines()[0][:200] if str(error) else ''}",)], "m string")
            keep.log(row(None, message.select(T.redacted("m")).first()[0]))
            raise


def _processed(docs, keep, detector, assigner, types, theme, tell, decisions, row) -> DataFrame:
    spark = docs.sparkSession
    found = kept(found_spans(docs, detector, types))
    n_found = found.count()
    tell(f"{n_found} spans found")
    counts = None
    if decisions is not None:
        decisions = kept(decisions)
        counts = {r.action: str(r["count"]) for r in decisions.groupBy("action").count().collect()}  # a row an action
    keys = ["doc_id", "unit_ord"] if "unit_ord" in docs.columns else ["doc_id"]
    results: list[DataFrame] = []

    def make(content: dict) -> dict:
        while results:  # another writer was faster
            dropped(results.pop())
        rows, own = found, None
        names = assign.wanted(found)
        if decisions is not None:
            names = names.unionByName(assign.wanted(decisions.where("new_text IS NOT NULL").select("doc_id", F.col("new_text").alias("text"), F.coalesce("entity_type", F.lit("PERSON")).alias("entity_type"), F.lit(0).alias("span_ord"))))
            names = kept(names.distinct())
        known = keep.lookup(names, content) if getattr(assigner, "by_lookup", False) else keep.mappings(content)
        if decisions is not None:
            rows = kept(decided(docs, found, decisions, known))
            own = kept(own_choices(rows, theme).join(known.select("full_name"), "full_name", "left_anti").select(*[c.split(" ")[0] for c in MAPPINGS.split(", ")]))
            known = known.unionByName(own)
        ids, new = given(rows, known, assigner, keep.numbers(content))
        new = typed(new, MAPPINGS)
        new = kept((new if own is None else new.unionByName(own)).withColumn("first_seen", F.current_timestamp()))
        # a row a span on both sides, whatever their packed files' size
        replaced = rows.join(ids.select("doc_id", "span_ord", "pseudonym").hint("merge"), ["doc_id", "span_ord"], "left")
        replaced = replaced.withColumn("replacement", F.concat(T.replacement_prefix("text", "entity_type"), "pseudonym"))
        results.append(kept(rewrite.rewritten(docs.select(*keys, "text"), replaced, keys), stays=True))
        if not new.isEmpty():
            content = keep.added(content, store.saved(new.limit(0), new))
        return keep.logged(content, row(n_found if decisions is None else rows.count(), None, counts))

    keep.change(make)
    tell("mappings stored")
    return results[0]


def process_folder(spark: SparkSession, source: str, target: str, keep: Store, recursive: bool = False, **more) -> DataFrame:
    """Process all documents under a folder into another, in their formats, with one table of names.

    path, output, n_replaced and error of each. A bad file stops no other. Files are named <stem>_pseudonymized<ext> below
    the target as they are below the source; PDF and DOCX become text. decisions, if given, are about doc_id and unit_ord
    of files.read_units().
    """
    with scope(spark):
        units = kept(files.read_units(spark, source, recursive))
        out = process(units.where("error IS NULL AND text IS NOT NULL").select("doc_id", "unit_ord", "text"), keep, **more)
        folder = spark._jvm.org.apache.hadoop.fs.Path(source)
        base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/") + "/"
        # the path below the folder, so that equal names in different folders stay apart
        below = F.regexp_replace(F.regexp_replace(T.output_path("path"), "^[a-z0-9]+:/+", "/"), "^" + re.escape(base), "")
        named = units.withColumn("name", below)
        done = named.drop("text").join(out, ["doc_id", "unit_ord"], "left").where("error IS NULL")
        texts = done.where("sheet_no IS NULL").select("name", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
        file_sink.write_files(texts.unionByName(cells.table_files(done.where("sheet_no IS NOT NULL"))), target)
        told = named.groupBy("doc_id").agg(F.first("path").alias("path"), F.max("error").alias("error"), F.first("name").alias("name"))
        told = told.join(out.groupBy("doc_id").agg(F.sum("n_replaced").cast("int").alias("n_replaced")), "doc_id", "left")
        n = F.when(F.col("error").isNull(), F.coalesce("n_replaced", F.lit(0)))
        told = kept(told.select("path", F.when(F.col("error").isNull(), F.col("name")).alias("output"), n.alias("n_replaced"), "error"), stays=True)
        dropped(out)
        return told


# -- settings

DEFAULTS = {"theme": "neutral_id", "engine": "arrow", "entity_types": list(P.ENTITY_TYPES), "recursive": False, "database": "mappings"}


def settings(*layers: tuple[str, dict], defaults: dict = DEFAULTS) -> dict[str, tuple[object, str]]:
    """Each setting's value and the name of the layer it is from; later layers win. A passphrase in a layer is refused."""
    out = {k: (v, "default") for k, v in defaults.items()}
    for name, layer in layers:
        if "passphrase" in json.dumps(layer).lower():
            raise ValueError(f"{name}: a passphrase doesn't belong in settings")
        out |= {k: (v, name) for k, v in layer.items() if v is not None}
    return out


def known_by_text(found: DataFrame, mappings: DataFrame) -> DataFrame:
    """found with whether the text, as it stands, has a mapping."""
    names = mappings.select(F.col("full_name").alias("text"), F.lit(True).alias("_k")).distinct()
    return found.join(names, "text", "left").withColumn("known", F.col("_k").isNotNull()).drop("_k")


