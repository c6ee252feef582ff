"""Span extraction, deduplication and the merge of two detectors.

A span table has doc_id, text, entity_type, start_pos, end_pos (code points, end
exclusive), confidence and source; order columns are added where an operator needs
them.  Everything runs over all documents at once: patterns are expressions on one
scan, overlaps are joins on doc_id, and no operator depends on row order.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookup
from ..functions import patterns as P
from ..functions import text as T
from ..sources.tables import kept

SPAN = "array<struct<start_pos int, end_pos int, text string, entity_type string, confidence double, pattern string, pattern_ord int>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column) -> Column:
    """Running sums of an array of integers. The distance that is added over doubles each time, so n values take n log n additions."""

    def step(sums: Column, far: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0), far), F.slice(sums, 1, F.size(sums) - far))
        return F.zip_with(sums, moved, lambda a, b: a + b)

    def summed(own: Column) -> Column:
        return F.aggregate(F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda far: far < F.size(own)), own, step)

    return _once(values, summed)


def matches(text: Column | str, regex: str, ignore_case: bool = False) -> Column:
    """array<struct(start_pos, end_pos, text)> of a pattern's matches, none of which may be empty.

    Matches and the gaps between them interleave, so positions are running sums of their lengths.
    """
    t = T.col(text)
    rule = ("(?iU)" if ignore_case else "(?U)") + regex
    both = F.struct(F.regexp_extract_all(t, F.lit(rule), F.lit(0)).alias("found"), F.split(t, rule, -1).alias("gaps"))

    def placed(b: Column) -> Column:
        gaps = F.slice(b["gaps"], 1, F.size(b["found"]))
        ends = running_sums(F.zip_with(b["found"], gaps, lambda m, g: F.length(m) + F.length(g)))
        return F.zip_with(b["found"], ends, lambda m, end: F.struct((end - F.length(m)).alias("start_pos"), end.alias("end_pos"), m.alias("text")))

    none = F.array().cast("array<struct<start_pos int, end_pos int, text string>>")
    return F.coalesce(_once(both, placed), none)


def _of(pattern: P.Pattern, k: int, text: Column) -> Column:
    spans = matches(text, pattern.regex)
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start_pos"].alias("start_pos"),
            s["end_pos"].alias("end_pos"),
            s["text"].alias("text"),
            F.lit(pattern.entity_type).alias("entity_type"),
            F.lit(pattern.confidence).alias("confidence"),
            F.lit(pattern.name).alias("pattern"),
            F.lit(k).alias("pattern_ord"),
        ),
    )


def _finder(rule: P.Pattern) -> Callable[[str], Iterable[re.Match]]:
    """A function from a text to the rule's matches.

    A rule with an ending is sought only in the runs of its characters that have one, and no further than the last of them.
    """
    regex = re.compile(rule.regex)
    if rule.ending is None:
        return regex.finditer
    within, ending = re.compile(rule.within), re.compile(rule.ending)

    def found(text: str) -> Iterable[re.Match]:
        at = 0
        for run in within.finditer(text):
            last = None
            for last in ending.finditer(text, run.start(), min(run.end() + 1, len(text))):  # noqa: B007
                pass
            while last is not None and (m := regex.search(text, max(at, run.start()), min(last.end() + 1, len(text)))):
                at = m.end()
                yield m

    return found


#: Spans that are handed on at once.
SPANS = 1 << 14


def _arrow(rules: list[P.Pattern], keys: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32())
    names = ["start_pos", "end_pos", "text", "entity_type", "confidence", "pattern", "pattern_ord"]

    def run(batches):
        compiled = [(k, r, _finder(r)) for k, r in enumerate(rules)]

        def spans(column):
            for i, text in enumerate(column):
                text = text.as_py()  # one text at a time
                for k, rule, find in compiled if text else ():
                    for m in find(text):
                        yield i, (m.start(), m.end(), m.group(0), rule.entity_type, rule.confidence, rule.name, k)

        for batch in batches:
            found = spans(batch.column("text"))
            while some := list(islice(found, SPANS)):
                rows, out = zip(*some, strict=True)
                own = batch.select(keys).take(pa.array(rows))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*keys, *names])

    return run


def regex_spans(docs: DataFrame, rules: Iterable[P.Pattern] = P.PATTERNS, keys: list[str] | None = None, engine: str = "native") -> DataFrame:
    """Spans of all enabled patterns in one scan of docs(keys..., text).

    engine `native` stays in the JVM; `arrow` makes one pass with Python's re, which
    is the faster one when many patterns run. Both give the same rows.
    """
    keys = keys or ["doc_id"]
    rules = [r for r in rules if r.enabled]
    if engine == "arrow":
        kinds = dict(docs.dtypes)
        schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
        schema += ", start_pos int, end_pos int, text string, entity_type string, confidence double, pattern string, pattern_ord int"
        return docs.select(*keys, "text").mapInArrow(_arrow(rules, keys), schema)
    spans = F.flatten(F.array(*[_of(r, k, F.col("text")) for k, r in enumerate(rules)]))
    # outer: a filter for empty arrays would be pushed down and match every pattern once more
    rows = docs.select(*keys, F.explode_outer(spans).alias("_s")).where("_s IS NOT NULL")
    return rows.select(*keys, "_s.*")


#: Terms that one automaton holds; more are sought in several passes.
TERMS_AT_ONCE = 1_000_000


def term_spans(docs: DataFrame, terms: DataFrame, keys: list[str] | None = None, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """keys, term, entity_type, start_pos and end_pos of every place of terms(term, entity_type) in docs(keys..., text).

    One automaton over all terms reads each text once, so time doesn't grow with the number of terms. Places of one term
    don't overlap: the first counts. An automaton has at_once terms at most and is built once a worker.
    """
    keys, spark = keys or ["doc_id"], docs.sparkSession
    own = kept(terms.where("term <> ''").select("term", "entity_type").distinct())
    passes = max(1, -(-own.count() // at_once))
    schema = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keys) + ", term string, entity_type string, start_pos int, end_pos int"
    found = []
    for k in range(passes):
        mine = own.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k).groupBy("term").agg(F.sort_array(F.collect_set(F.coalesce("entity_type", F.lit("")))).alias("kinds"))
        shared = spark.sparkContext.broadcast([(r.term, list(r.kinds)) for r in mine.collect()])  # at_once terms, by and large
        found.append(docs.select(*keys, "text").mapInArrow(_automaton(shared, uuid.uuid4().hex, keys), schema))
    return reduce(DataFrame.unionAll, found)


#: A worker's automaton, and the name of the terms it is of.
_OWN_AUTOMATON: list = [None, None]


def _automaton(shared, name: str, keys: list[str]):
    def run(batches):
        import ahocorasick

        if _OWN_AUTOMATON[0] != name:
            own = ahocorasick.Automaton()
            for term, kinds in shared.value:
                own.add_word(term, (term, kinds))
            if len(own):
                own.make_automaton()
            _OWN_AUTOMATON[:] = name, own
        own = _OWN_AUTOMATON[1]
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("text")):
                text, last = text.as_py(), {}
                for stop, (term, kinds) in own.iter(text) if text and len(own) else ():
                    low = stop + 1 - len(term)
                    if low >= last.get(term, 0):
                        last[term] = stop + 1
                        for kind in kinds:
                            rows.append(i)
                            out.append((term, kind or None, low, stop + 1))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(rows)).columns, *columns], [*keys, "term", "entity_type", "start_pos", "end_pos"])

    return run


def literal_spans(docs: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Every place of every (term, entity_type) in the texts, terms taken literally. A small fixed list; term_spans() is for tables of terms."""
    rules = [P.Pattern(term, kind, 1.0, java_quoted(term)) for term, kind in terms]
    return regex_spans(docs, rules)


def java_quoted(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", term)


def full_name_spans(docs: DataFrame, first_names: DataFrame, last_names: DataFrame) -> DataFrame:
    """Two capitalised words of which the first is a known first name and the second a known last name (column `value`)."""
    rows = regex_spans(docs, [P.FULL_NAME])
    parts = F.split(F.regexp_replace("text", r"(?U)\s+", " "), " ")
    rows = rows.withColumns({"_first": F.get(parts, F.lit(0)), "_last": F.get(parts, F.lit(1))})
    rows = known(rows, "_first", first_names)
    rows = known(rows, "_last", last_names)
    return rows.withColumn("text", F.concat_ws(" ", "_first", "_last")).drop("_first", "_last")


def known(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows whose column, as it stands or capitalised, is a name (column `value`)."""
    own = names.select(F.col("value").alias("_value")).distinct()
    # a dictionary is small: both forms are looked up by broadcast where the planner sees that it is
    plain = own.select(F.col("_value").alias("_a"), F.lit(True).alias("_in_a"))
    upper = own.select(F.col("_value").alias("_b"), F.lit(True).alias("_in_b"))
    found = rows.join(plain, F.col(column) == F.col("_a"), "left").join(upper, T.capitalized(column) == F.col("_b"), "left")
    return found.where("_in_a OR _in_b").select(*rows.columns)


def geography_spans(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Candidate place names that are in the dictionary (column `value`), letter for letter."""
    rows = regex_spans(docs, [P.GEOGRAPHY])
    return rows.join(places.select(F.col("value").alias("text")).distinct(), "text", "left_semi").select(*rows.columns)


def pos_filtered(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Geography spans that a tagger's tokens (doc_id, start_pos, end_pos, pos, ent_type) don't speak against.

    A span that begins or ends inside a token, or without tokens, stays; else one token must be PROPN or without a label.
    """
    t = tokens.select("doc_id", F.col("start_pos").alias("_a"), F.col("end_pos").alias("_b"), "pos", "ent_type")
    rows = spans.withColumn("_id", F.struct("doc_id", "start_pos", "end_pos", "text"))
    inside = (F.col("_a") < F.col("end_pos")) & (F.col("start_pos") < F.col("_b"))
    joined = rows.select("doc_id", "start_pos", "end_pos", "_id").distinct().join(t, "doc_id").where(inside)
    fits = (F.min("_a") == F.first("start_pos")) & (F.max("_b") == F.first("end_pos"))
    good = F.bool_or((F.col("pos") == "PROPN") | (F.coalesce("ent_type", F.lit("")) == ""))
    bad = joined.groupBy("_id").agg(fits.alias("fits"), good.alias("good")).where("fits AND NOT good")
    return rows.join(bad, "_id", "left_anti").select(*spans.columns)


def dedup_spans(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One span a place: the most confident, of equals the first in the order of patterns."""
    keys = keys or ["doc_id"]
    order = Window.partitionBy(*keys, "start_pos", "end_pos").orderBy(F.desc("confidence"), "pattern_ord", "text", "entity_type")
    return spans.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pattern_stats(rules: Iterable[P.Pattern], spark) -> DataFrame:
    rows = [(r.name, r.entity_type, r.confidence, r.enabled) for r in rules]
    table = spark.createDataFrame(rows, "name string, entity_type string, confidence double, enabled boolean")
    return table.groupBy("entity_type").agg(
        F.count("*").alias("n_patterns"), F.count_if("enabled").alias("n_enabled"), F.avg("confidence").alias("avg_confidence")
    )


def mapped_labels(spans: DataFrame, label: str = "label") -> DataFrame:
    """entity_type from a model's label, whatever its case; other labels go."""
    table = F.create_map(*[F.lit(x) for pair in P.LABELS.items() for x in pair])
    return spans.withColumn("entity_type", F.try_element_at(table, F.upper(label))).where("entity_type IS NOT NULL")


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.start_pos") < F.col(f"{b}.end_pos")) & (F.col(f"{b}.start_pos") < F.col(f"{a}.end_pos"))


def only_types(spans: DataFrame, types: list[str]) -> DataFrame:
    valid = [t.upper() for t in types if t.upper() in P.ENTITY_TYPES]
    if not valid:
        raise ValueError(f"no valid entity type in {types}")
    return spans.where(F.col("entity_type").isin(valid))


def without_bare_titles(spans: DataFrame) -> DataFrame:
    return spans.where((F.col("entity_type") != "PERSON") | (T.strip_titles("text") != ""))


def without_labels(spans: DataFrame) -> DataFrame:
    return spans.where(~F.lower(T.strip(F.col("text"))).isin(*P.LABEL_WORDS))


#: Length of the stretches in which spans meet.
STRETCH = 512


def stretch_of(place: Column) -> Column:
    return F.floor(place / STRETCH).cast("int")


def in_stretches(spans: DataFrame) -> DataFrame:
    """spans with `stretch`: a row for each stretch of the text that a span reaches into."""
    return spans.withColumn("stretch", F.explode(F.sequence(stretch_of(F.col("start_pos")), stretch_of(F.greatest(F.col("start_pos"), F.col("end_pos") - 1)))))


def merged(ner: DataFrame, regex: DataFrame) -> DataFrame:
    """One span table of two: doc_id, span_ord, text, entity_type, start_pos, end_pos, confidence, is_ambiguous, source.

    A regex span meets the first model span that it overlaps (by start, end and text). Equal in place or
    title-free text: it goes. An organisation that holds a person: the person goes. Otherwise it is ambiguous.
    Spans meet within stretches of a document, so a long one with many spans is dealt over tasks.
    """
    columns = ["doc_id", "text", "entity_type", "start_pos", "end_pos", "confidence"]
    order = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos", "text", "entity_type")
    n = ner.select(*columns).withColumn("ord", F.row_number().over(order))
    r = regex.select(*columns).withColumn("ord", F.row_number().over(order))
    pairs = in_stretches(r).alias("r").join(in_stretches(n).alias("n"), (F.col("r.doc_id") == F.col("n.doc_id")) & (F.col("r.stretch") == F.col("n.stretch")))
    # two spans share several stretches: they meet where the later one begins
    pairs = pairs.where(overlaps("r", "n") & (F.col("r.stretch") == stretch_of(F.greatest("r.start_pos", "n.start_pos"))))
    same = (F.col("r.start_pos") == F.col("n.start_pos")) & (F.col("r.end_pos") == F.col("n.end_pos"))
    same |= T.strip_titles(F.col("r.text")) == T.strip_titles(F.col("n.text"))
    begins = F.lit(False)
    for word in P.ORG_OVER_PERSON:
        begins |= F.col("r.text").startswith(word)
    holds = (F.col("r.start_pos") <= F.col("n.start_pos")) & (F.col("r.end_pos") >= F.col("n.end_pos"))
    over = (F.col("r.entity_type") == "ORG") & (F.col("n.entity_type") == "PERSON") & begins & holds
    kind = F.when(same, "same").when(over, "over").otherwise("ambiguous")
    first = F.min_by(F.struct(kind.alias("kind"), F.col("n.ord").alias("ner_ord")), F.col("n.ord"))
    met = pairs.groupBy(F.col("r.doc_id").alias("doc_id"), F.col("r.ord").alias("ord")).agg(first.alias("f"))
    met = met.select("doc_id", "ord", "f.kind", "f.ner_ord")
    superseded = met.where("kind = 'over'").select("doc_id", F.col("ner_ord").alias("ord")).distinct()
    left = n.join(superseded, ["doc_id", "ord"], "left_anti").select(*columns, F.lit(False).alias("is_ambiguous"), F.lit("ner").alias("source"), F.lit(0).alias("_s"), "ord")
    right = r.join(met.select("doc_id", "ord", "kind"), ["doc_id", "ord"], "left").where("kind IS NULL OR kind <> 'same'")
    right = right.select(*columns, F.coalesce(F.col("kind") == "ambiguous", F.lit(False)).alias("is_ambiguous"), F.lit("regex").alias("source"), F.lit(1).alias("_s"), "ord")
    rows = without_labels(without_bare_titles(left.unionByName(right)))
    place = Window.partitionBy("doc_id").orderBy("start_pos", "_s", "ord")
    return rows.withColumn("span_ord", F.row_number().over(place)).select("doc_id", "span_ord", *columns[1:], "is_ambiguous", "source")


def detector_spans(docs: DataFrame, detector: Callable[[], Callable[[str], list[tuple]]]) -> DataFrame:
    """Spans of any detector: a factory, called once a task, of a function from a text to (start, end, text, label, confidence) tuples."""

    def run(batches):
        detect = detector()
        for batch in batches:
            out = [(d, *span) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for span in detect(text)]
            if out:
                kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
                names = ["doc_id", "start_pos", "end_pos", "text", "label", "confidence"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start_pos int, end_pos int, text string, label string, confidence double"
    return mapped_labels(docs.select("doc_id", "text").mapInArrow(run, schema)).drop("label")


def _in_dictionaries(rows: DataFrame, names: DataFrame | None, places: DataFrame | None) -> DataFrame:
    """rows of regex_spans() without the candidates of FULL_NAME and GEOGRAPHY that aren't in the dictionaries; full names with one blank.

    The dictionaries are broadcast: their size is that of a language's names and doesn't grow with the texts.
    """
    columns = rows.columns
    if names is not None:
        full = F.col("pattern") == P.FULL_NAME.name
        parts = F.when(full, F.split(F.regexp_replace("text", r"(?U)\s+", " "), " "))
        rows = rows.withColumns({"_first": F.get(parts, F.lit(0)), "_last": F.get(parts, F.lit(1))})
        for part, kind in (("_first", "first"), ("_last", "last")):
            rows = lookup.is_name(rows, part, F.broadcast(names.where(F.col("kind") == kind)), f"_is{part}")
        rows = rows.where(~full | F.col("_is_first") & F.col("_is_last"))
        rows = rows.withColumn("text", F.when(full, F.concat_ws(" ", "_first", "_last")).otherwise(F.col("text"))).select(*columns)
    if places is not None:
        geography = F.col("pattern") == P.GEOGRAPHY.name
        own = places.select(F.col("value").alias("_place")).distinct()
        rows = rows.join(F.broadcast(own), geography & (F.col("text") == F.col("_place")), "left").where(~geography | F.col("_place").isNotNull()).select(*columns)
    return rows


#: Documents whose spans a task sorts.
DOCS = 1 << 13


def by_document(spans: DataFrame, docs: DataFrame, at_once: int = DOCS) -> DataFrame:
    """spans by document over as many tasks as have at_once documents each, so that a task's sorts don't grow with the input.

    Windows and joins by document, or by document and place, need no other exchange.
    """
    return spans.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // at_once)), "doc_id")


def detected(
    docs: DataFrame,
    ner: DataFrame | None = None,
    rules: Iterable[P.Pattern] = P.PATTERNS,
    engine: str = "native",
    names: DataFrame | None = None,
    places: DataFrame | None = None,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """Spans of rules and of the dictionaries that are given, deduplicated and merged with a model's spans if there are any.

    names (kind, value) add full names, places (value) add place names, which a tagger's tokens, if given, are held against.
    One scan finds the candidates of all.
    """
    more = ([P.FULL_NAME] if names is not None else []) + ([P.GEOGRAPHY] if places is not None else [])
    found = _in_dictionaries(regex_spans(docs, [*rules, *more], engine=engine), names, places)
    if places is not None and tokens is not None:
        geography = F.col("pattern") == P.GEOGRAPHY.name
        found = found.where(~geography).unionByName(pos_filtered(found.where(geography), tokens))
    regex = dedup_spans(by_document(found, docs))
    if ner is None:
        ner = regex.select("doc_id", "text", "entity_type", "start_pos", "end_pos", "confidence").limit(0)
    return merged(ner, regex)


def all_detected(
    docs: DataFrame,
    ner: DataFrame | None = None,
    rules: Iterable[P.Pattern] = P.PATTERNS,
    engine: str = "arrow",
    names: DataFrame | None = None,
    places: DataFrame | None = None,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """detected() with both dictionaries, by default the ones of lookup."""
    spark = docs.sparkSession
    names = lookup.names(spark) if names is None else names
    places = lookup.places(spark) if places is None else places
    return detected(docs, ner, rules, engine, names, places, tokens)


all_detected.info = {"name": "patterns", "version": "1.0", "language": "fr", "patterns": str(len(P.PATTERNS))}


def detector_info(detector) -> dict[str, str]:
    """What is known of a detector: its own `info`, or its name alone."""
    return dict(getattr(detector, "info", None) or {"name": getattr(detector, "__name__", type(detector).__name__)})
