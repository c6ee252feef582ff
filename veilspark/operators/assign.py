"""Pseudonym assignment, restated on sets.

A mention's key is its normal form, whatever its type.  Keys without a mapping get
one, in the order of their first mention, so the result depends neither on
partitions nor on the order of rows.  Numbers come from row_number over distinct
keys only.  Pseudonym names come from a pool in the order of a keyed hash, matched
by rank with the names they stand for, so that equal components have equal
pseudonyms and different ones different ones, over all runs on one mapping table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookup
from ..functions import text as T
from ..sources.tables import kept
from .numbering import numbered

PREFIX = {"PERSON": "PER", "LOCATION": "LOC", "ORG": "ORG"}
FALLBACK = {"PERSON": "Person", "LOCATION": "Location", "ORG": "Org"}
WARN_AT = 0.8


def _label(table: dict[str, str], entity_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), entity_type)


def of_texts(rows: DataFrame, forms: dict[str, Column]) -> DataFrame:
    """rows(text, entity_type, ...) with forms, which depend on these two alone and are worked out once for each two.

    Patterns take far longer than a join, and a name occurs again and again.
    """
    own = rows.groupBy(F.col("text").alias("_text"), F.col("entity_type").alias("_type")).agg(F.count("*").alias("_n"))
    # _n is never 0: a filter on a form that needs it isn't pushed below the grouping, where each row would be worked out
    own = own.select("_text", "_type", *[F.when(F.col("_n") > 0, form).alias(name) for name, form in forms.items()])
    same = F.col("text").eqNullSafe(F.col("_text")) & F.col("entity_type").eqNullSafe(F.col("_type"))
    return rows.join(own, same).drop("_text", "_type")


def mentions(spans: DataFrame) -> DataFrame:
    """spans with their key and name parts; doc_ord is doc_id where there is none."""
    rows = spans if "doc_ord" in spans.columns else spans.withColumn("doc_ord", F.col("doc_id"))
    key, name = T.normal_form("_text", "_type"), T.parse_name("_text")
    return of_texts(rows, {"key": key, "first": name["first"], "last": name["last"], "n_words": F.size(T.words(key))})


def keys_of(rows: DataFrame) -> DataFrame:
    """A row a key: type, parts and place of its first mention."""
    at = F.struct("doc_ord", "span_ord")
    own = F.struct("entity_type", "first", "last", "n_words", "text", at.alias("at"))
    return rows.groupBy("key").agg(F.min_by(own, at).alias("m")).select("key", "m.entity_type", "m.first", "m.last", "m.n_words", "m.text", "m.at")


def wanted(spans: DataFrame) -> DataFrame:
    """value: the keys and name parts of spans, which a mapping may stand under."""
    rows = mentions(spans)
    return rows.select(F.explode(F.array("key", "first", "last")).alias("value")).where("value <> ''").distinct()


def counters(mappings: DataFrame, table: dict[str, str] = PREFIX) -> DataFrame:
    """entity_type and the largest number given so far."""
    found = mappings.select(T.numbered("pseudonym_full", tuple(table.values())).alias("n")).where("n.prefix IS NOT NULL")
    back = _label({v: k for k, v in table.items()}, F.col("n.prefix"))
    return found.groupBy(back.alias("entity_type")).agg(F.max("n.number").alias("base"))


def neutral_ids(rows: DataFrame, mappings: DataFrame | None = None, labels: dict[str, str] = PREFIX, numbers: DataFrame | None = None) -> DataFrame:
    """Each mention with its `pseudonym`, and `is_new` where the mention is the first of a new mapping.

    rows: doc_id, doc_ord, span_ord, text, entity_type. A person's single word takes, in this order: a mapping of that
    word; the part of a bearer that is new in the same document and mentioned before; the part of a bearer known from
    an earlier document, which is then the word's mapping; a number of its own. numbers (entity_type, base): the largest
    numbers in use, where mappings aren't all there are.
    """
    m = mentions(rows).where("key <> ''")
    at = F.struct("doc_ord", "span_ord")
    if mappings is not None:
        have = mappings.select(F.col("full_name").alias("key"), F.col("pseudonym_full").alias("old"))
        m = m.join(have, "key", "left")
    else:
        m = m.withColumn("old", F.lit(None).cast("string"))
    m = kept(m)  # ten joins read it
    new = m.where("old IS NULL")
    single = (F.col("entity_type") == "PERSON") & (F.col("n_words") == 1)
    kinds = keys_of(new)
    # bearers: new names of two words or more, by each of their parts, at their first mention
    whole = kinds.where((F.col("entity_type") == "PERSON") & (F.col("n_words") > 1))
    parts = whole.select("key", "at", F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("first").alias("part")), F.struct(F.lit(1).alias("role"), F.col("last").alias("part")))).alias("p"))
    parts = parts.select(F.col("key").alias("bearer"), F.col("at").alias("b_at"), "p.role", F.col("p.part").alias("part"))
    if mappings is not None:
        mapped = mappings.where("entity_type = 'PERSON' AND last_name IS NOT NULL AND pseudonym_first IS NOT NULL")
        old_parts = mapped.select(F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("first_name").alias("part"), F.col("pseudonym_first").alias("given")), F.struct(F.lit(1).alias("role"), F.col("last_name").alias("part"), F.col("pseudonym_last").alias("given")))).alias("p"))
        old_parts = old_parts.where("p.given IS NOT NULL").groupBy("p.part").agg(F.min_by("p.given", F.struct("p.role", "p.given")).alias("given"))
    words = new.where(single).groupBy("doc_ord", "key").agg(F.min("span_ord").alias("span_ord"))
    words = words.withColumn("w_at", at)
    near = words.join(parts, words["key"] == parts["part"])
    same = near.where((F.col("b_at.doc_ord") == F.col("doc_ord")) & (F.col("b_at") < F.col("w_at")))
    same = same.groupBy("doc_ord", "key").agg(F.min_by(F.struct("bearer", "role"), F.struct("role", "b_at")).alias("same"))
    words = words.join(same, ["doc_ord", "key"], "left")
    # the first document in which the word is not its own document's bearer's: there its mapping is made
    made = words.where("same IS NULL").groupBy("key").agg(F.min("w_at").alias("made_at"))
    earlier = made.join(parts, made["key"] == parts["part"]).where(F.col("b_at") < F.col("made_at"))
    earlier = earlier.groupBy("key").agg(F.min_by(F.struct("bearer", "role"), F.struct("role", "b_at")).alias("known"))
    made = made.join(earlier, "key", "left")
    if mappings is not None:
        made = made.join(old_parts.withColumnRenamed("part", "key"), "key", "left")
    else:
        made = made.withColumn("given", F.lit(None).cast("string"))
    others = kinds.where(~single | F.col("entity_type").isNull()).select("key", "entity_type", "at")
    own = made.where("known IS NULL AND given IS NULL").select("key", F.lit("PERSON").alias("entity_type"), F.col("made_at").alias("at"))
    counted = others.unionByName(own)
    ids = numbered(counted, ["at", "key"], "entity_type")
    if mappings is not None:
        ids = ids.join(F.broadcast(counters(mappings) if numbers is None else numbers), "entity_type", "left")  # a row a type
    else:
        ids = ids.withColumn("base", F.lit(0))
    number = F.col("n") + F.coalesce("base", F.lit(0))
    ids = ids.select("key", F.format_string("%s-%03d", _label(labels, F.col("entity_type")), number).alias("id"), F.col("at").alias("id_at"))
    tail = lambda role: F.when(role == 0, "-P").otherwise("-N")
    bearer = ids.select(F.col("key").alias("_b"), F.col("id").alias("_bid"))
    made = made.withColumn("_b", F.col("known.bearer")).join(bearer, "_b", "left")
    made = made.select("key", "made_at", F.coalesce("given", F.concat("_bid", tail(F.col("known.role")))).alias("shared"))
    words = words.withColumn("_b", F.col("same.bearer")).join(bearer, "_b", "left")
    words = words.select(F.col("doc_ord").alias("_d"), F.col("key").alias("_w"), F.concat("_bid", tail(F.col("same.role"))).alias("in_doc"))
    out = m.join(ids, "key", "left").join(made, "key", "left")
    same_word = (F.col("key") == F.col("_w")) & (F.col("doc_ord") == F.col("_d"))
    out = out.join(words, same_word & F.col("old").isNull() & single, "left")
    stored = F.when(F.col("made_at").isNotNull() & (F.col("doc_ord") < F.col("made_at.doc_ord")), None).otherwise(F.coalesce("shared", "id"))
    name = F.when(F.col("old").isNotNull(), F.col("old")).when(single, F.coalesce(stored_when_known(stored), "in_doc", stored)).otherwise(F.col("id"))
    first = F.coalesce("made_at", "id_at")
    return out.select(
        "doc_id",
        "doc_ord",
        "span_ord",
        "text",
        "entity_type",
        "key",
        "first",
        "last",
        name.alias("pseudonym"),
        (F.col("old").isNull() & (F.coalesce(first == at, F.lit(False)))).alias("is_new"),
    )


def stored_when_known(stored: Column) -> Column:
    """The word's mapping, in documents after the one that made it; there it goes before the document's own bearer."""
    return F.when(F.col("doc_ord") > F.col("made_at.doc_ord"), stored)


def new_mappings(assigned: DataFrame, theme: str = "neutral_id") -> DataFrame:
    """Mapping rows of what neutral_ids() made new."""
    rows = assigned.where("is_new")
    person = F.col("entity_type") == "PERSON"
    two = person & F.col("last").isNotNull()
    return rows.select(
        F.substring(F.sha2(F.concat_ws("|", "key"), 256), 1, 32).alias("id"),
        "entity_type",
        F.when(person, F.col("first")).alias("first_name"),
        F.when(person, F.col("last")).alias("last_name"),
        F.col("key").alias("full_name"),
        F.when(two, F.concat("pseudonym", F.lit("-P"))).when(person, F.col("pseudonym")).alias("pseudonym_first"),
        F.when(two, F.concat("pseudonym", F.lit("-N"))).alias("pseudonym_last"),
        F.col("pseudonym").alias("pseudonym_full"),
        F.lit(theme).alias("theme"),
    )


# -- names from a library


def _ranked(rows: DataFrame, value: str, secret: str) -> DataFrame:
    """rows with _n, the rank of a value by its keyed hash.

    The hash's first digits deal values into ranges in that very order, so each range is sorted apart, and only the
    ranges' counts, a fixed number of them, are added up in one place.
    """
    rows = rows.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(secret), value), 256)).withColumn("_range", F.substring("_h", 1, 3))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_h", value))
    rows = rows.withColumn("_own", own).join(F.broadcast(counts), "_range")  # 4,096 ranges
    return rows.withColumn("_n", F.col("_own") + F.col("_before")).drop("_h", "_range", "_own", "_before")


def _unused(pool: DataFrame, kind: str, theme: str, used: DataFrame) -> DataFrame:
    rows = pool.where((F.col("kind") == kind) & (F.col("theme") == theme)).groupBy("value").agg(F.min_by("category", "ord").alias("category"))
    return rows.join(used.select(F.col("used").alias("value")).distinct(), "value", "left_anti")


def fallback_names(rows: DataFrame, entity_type: str, used: DataFrame) -> DataFrame:
    """rows(value) with `pseudonym` Person-001 and so on, after the largest number in use (column `used`)."""
    label = FALLBACK[entity_type]
    base = used.select(T.numbered("used", (label,))["number"].alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("base"))
    ranked = numbered(rows, ["value"], name="_n")
    return ranked.join(F.broadcast(base)).withColumn("pseudonym", F.format_string(label + "-%03d", F.col("base") + F.col("_n"))).drop("_n", "base")


def matched(names: DataFrame, pool: DataFrame, secret: str) -> DataFrame:
    """value, pseudonym: each distinct name with one of the pool (value), by rank; null beyond the pool."""
    ranked = _ranked(names.select("value").distinct(), "value", secret + "/real")
    free = _ranked(pool.select("value").distinct(), "value", secret).select(F.col("value").alias("pseudonym"), "_n")
    return ranked.join(free, "_n", "left").select("value", "pseudonym")


def _with_fallback(rows: DataFrame, entity_type: str, used: DataFrame, secret: str, strict: bool) -> DataFrame:
    """rows(role, value, pseudonym) with numbered names where the pool had none: one counter a type, after the largest number in use."""
    label = FALLBACK[entity_type]
    rows = kept(rows)
    none = rows.where("pseudonym IS NULL").withColumn("_v", F.concat_ws("|", "role", "value"))
    if strict and none.limit(1).count():
        raise ValueError(f"the library has too few names for {entity_type}")
    base = used.select(T.numbered("used", (label,))["number"].alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("base"))
    none = _ranked(none, "_v", secret + "/rest").join(F.broadcast(base))  # one row
    none = none.select("role", "value", F.format_string(label + "-%03d", F.col("base") + F.col("_n")).alias("pseudonym"))
    return rows.where("pseudonym IS NOT NULL").select("role", "value", "pseudonym").unionByName(none)


def _parts_given(mappings: DataFrame, real: str, made: str) -> DataFrame:
    """value, given: pseudonyms that stored people's parts have; a number for a whole name is none of a part."""
    rows = mappings.where(f"entity_type = 'PERSON' AND {real} IS NOT NULL AND {made} IS NOT NULL AND pseudonym_first IS NOT NULL")
    return rows.groupBy(F.col(real).alias("value")).agg(F.min(made).alias("given"))


def _people(own: DataFrame, pool: DataFrame, theme: str, secret: str, genders: DataFrame, mappings: DataFrame, strict: bool) -> DataFrame:
    """id, key, pseudonym_first, pseudonym_last and pseudonym_full of new people (id, key, first, last, at).

    A part that a stored person has keeps its pseudonym; the others are matched with what no stored person has, first
    names within their gender's pool, unknown and neutral ones with what is left over. A single word is a first name
    and gets a last name of its own.
    """
    taken = lambda column: mappings.select(F.col(column).alias("used")).where("used IS NOT NULL")
    alone = F.concat(F.lit("\u0000"), F.col("first"))
    own = own.withColumn("_last", F.coalesce("last", alone))
    old_first, old_last = _parts_given(mappings, "first_name", "pseudonym_first"), _parts_given(mappings, "last_name", "pseudonym_last")
    firsts = kept(own.select(F.col("first").alias("value")).distinct().join(old_first, "value", "left_anti"))
    firsts = lookup.with_gender(firsts.withColumn("_w", F.get(T.words(F.col("value")), F.lit(0))), "_w", genders).drop("_w")
    free = _unused(pool, "first", theme, taken("pseudonym_first"))
    parts = [matched(firsts.where(F.col("gender") == g), free.where(F.col("category") == g), f"{secret}/{g}").where("pseudonym IS NOT NULL") for g in ("male", "female")]
    named = kept(parts[0].unionByName(parts[1]))
    rest = firsts.join(named.select("value"), "value", "left_anti")
    left = free.join(named.select(F.col("pseudonym").alias("value")), "value", "left_anti")
    named = named.unionByName(matched(rest, left, secret))
    lasts = own.select(F.col("_last").alias("value")).distinct().join(old_last, "value", "left_anti")
    lasts = matched(lasts, _unused(pool, "last", theme, taken("pseudonym_last")), secret)
    both = named.select(F.lit(0).alias("role"), "value", "pseudonym").unionByName(lasts.select(F.lit(1).alias("role"), "value", "pseudonym"))
    used = taken("pseudonym_first").unionAll(taken("pseudonym_last")).unionAll(taken("pseudonym_full"))
    both = kept(_with_fallback(both, "PERSON", used, secret, strict))
    part = lambda role, old, name, out: both.where(F.col("role") == role).select(F.col("value").alias(name), F.col("pseudonym").alias(out)).unionByName(old.select(F.col("value").alias(name), F.col("given").alias(out)))
    people = own.join(part(0, old_first, "first", "pseudonym_first"), "first").join(part(1, old_last, "_last", "pseudonym_last"), "_last")
    people = people.withColumn("pseudonym_full", F.concat_ws(" ", "pseudonym_first", "pseudonym_last"))
    # spellings of one name have the same parts; the first keeps them, another gets a number, so no full name stands for two keys
    order = Window.partitionBy("pseudonym_full").orderBy("at", "key")
    stored = taken("pseudonym_full").distinct().select(F.col("used").alias("pseudonym_full"), F.lit(1).alias("_old"))
    people = people.withColumn("_r", F.row_number().over(order)).join(stored, "pseudonym_full", "left")
    again = (F.col("_r") > 1) | F.col("_old").isNotNull()
    numbers = people.where(again).select(F.lit(2).alias("role"), F.col("key").alias("value"), F.lit(None).cast("string").alias("pseudonym"))
    numbers = _with_fallback(numbers, "PERSON", used.unionAll(both.select(F.col("pseudonym").alias("used"))), secret, False)
    people = people.join(numbers.select(F.col("value").alias("key"), F.col("pseudonym").alias("_number")), "key", "left")
    return people.select(
        "id",
        "key",
        F.when(F.col("_number").isNull(), F.col("pseudonym_first")).alias("pseudonym_first"),
        F.coalesce("_number", "pseudonym_last").alias("pseudonym_last"),
        F.coalesce("_number", "pseudonym_full").alias("pseudonym_full"),
    )


STORED = "entity_type string, first_name string, last_name string, full_name string, pseudonym_first string, pseudonym_last string, pseudonym_full string"
#: Numbers that stand for new keys until names are drawn for them.
DRAFT = {"PERSON": "~PER", "LOCATION": "~LOC", "ORG": "~ORG"}


def library_ids(rows: DataFrame, pool: DataFrame, theme: str, secret: str, genders: DataFrame, mappings: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Mentions with `pseudonym` from a library, and the new mapping rows.

    Who is meant is decided as for numbers, by neutral_ids(): a stored name keeps its pseudonym, a single word takes the
    part of its bearer, in this run or in an earlier one. Then new keys get names that no stored mapping has.
    """
    if mappings is None:
        mappings = rows.sparkSession.createDataFrame([], STORED)
    found = kept(neutral_ids(rows, mappings, DRAFT))
    at = F.struct("doc_ord", "span_ord").alias("at")
    new = found.where("is_new").select("key", "entity_type", "first", "last", F.col("pseudonym").alias("id"), at)
    own = new.where("id RLIKE '^~[A-Z]+-[0-9]+$'")
    names = kept(_people(own.where("entity_type = 'PERSON'"), pool, theme, secret, genders, mappings, strict))
    for entity_type, kind in (("LOCATION", "location"), ("ORG", "organization")):
        used = mappings.where(F.col("entity_type") == entity_type).select(F.col("pseudonym_full").alias("used"))
        mine = own.where(F.col("entity_type") == entity_type)
        drawn = matched(mine.select(F.col("key").alias("value")), _unused(pool, kind, theme, used), secret)
        drawn = _with_fallback(drawn.select(F.lit(0).alias("role"), "value", "pseudonym"), entity_type, used, secret, False)
        none = F.lit(None).cast("string")
        drawn = drawn.select(F.col("value").alias("key"), none.alias("pseudonym_first"), none.alias("pseudonym_last"), F.col("pseudonym").alias("pseudonym_full"))
        names = names.unionByName(mine.select("id", "key").join(drawn, "key"))
    names = kept(names)
    # a draft number is a new key's name, or with a tail one of its parts
    role = lambda tail, name: names.select(F.concat("id", F.lit(tail)).alias("_id"), F.col(name).alias("_name"))
    by_id = role("", "pseudonym_full").unionAll(role("-P", "pseudonym_first")).unionAll(role("-N", "pseudonym_last"))
    out = found.join(by_id, found["pseudonym"] == by_id["_id"], "left")
    out = kept(out.withColumn("_draft", F.col("pseudonym")).withColumn("pseudonym", F.coalesce("_name", F.when(~F.col("pseudonym").startswith("~"), F.col("pseudonym")))).drop("_id", "_name"))
    rows = out.where("is_new").select("key", "entity_type", "first", "last", "pseudonym", "_draft")
    rows = rows.join(names.select("key", "pseudonym_first", "pseudonym_last", F.lit(True).alias("_own")), "key", "left")
    person = F.col("entity_type") == "PERSON"
    # a bearer's part is the word's first or last name, as it is the bearer's
    shared = lambda tail, own: F.when(F.col("_own").isNotNull(), F.col(own)).when(F.col("_draft").endswith(tail), F.col("pseudonym"))
    new = rows.select(
        F.substring(F.sha2("key", 256), 1, 32).alias("id"),
        "entity_type",
        F.when(person, F.col("first")).alias("first_name"),
        F.when(person, F.col("last")).alias("last_name"),
        F.col("key").alias("full_name"),
        shared("-P", "pseudonym_first").alias("pseudonym_first"),
        shared("-N", "pseudonym_last").alias("pseudonym_last"),
        F.col("pseudonym").alias("pseudonym_full"),
        F.lit(theme).alias("theme"),
    )
    return out.drop("_draft"), new


def library_names(rows: DataFrame, pool: DataFrame, theme: str, secret: str, genders: DataFrame, strict: bool = False, mappings: DataFrame | None = None) -> DataFrame:
    """key, entity_type, pseudonym_first, pseudonym_last, pseudonym_full of the new mappings that mentions make."""
    _, new = library_ids(rows, pool, theme, secret, genders, mappings, strict)
    return new.select(F.col("full_name").alias("key"), "entity_type", "pseudonym_first", "pseudonym_last", "pseudonym_full")


def exhaustion(mappings: DataFrame, pool: DataFrame, theme: str) -> DataFrame:
    """theme, used, capacity, share and whether to warn: names in use against all that the library can make."""
    own = pool.where(F.col("theme") == theme).agg(
        F.count_distinct(F.when(F.col("kind") == "first", F.col("value"))).alias("f"),
        F.count_distinct(F.when(F.col("kind") == "last", F.col("value"))).alias("l"),
        F.count_distinct(F.when(F.col("kind").isin("location", "organization"), F.struct("kind", "value"))).alias("o"),
    )
    used = mappings.where(F.col("theme") == theme).agg(F.count_distinct("pseudonym_full").alias("used"))
    rows = own.join(F.broadcast(used)).withColumn("capacity", F.col("f") * F.col("l") + F.col("o"))
    share = F.when(F.col("capacity") > 0, F.col("used") / F.col("capacity")).otherwise(0.0)
    return rows.select(F.lit(theme).alias("theme"), "used", "capacity", share.alias("share"), (share >= WARN_AT).alias("warn"))
