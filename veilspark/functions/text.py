"""Scalar functions on entity texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import PREPOSITION, TITLE

_ALL_SPACE = r"(?U)^\s+|\s+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, _ALL_SPACE, "")


def words(text: Column) -> Column:
    """White-space separated words; none for a blank text."""
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")


def strip_titles(text: Column | str) -> Column:
    """Titles removed wherever they stand; a second pass takes what the first one uncovers."""
    once = lambda t: strip(F.regexp_replace(t, "(?iU)" + TITLE, ""))
    return once(once(col(text)))


def strip_prepositions(text: Column | str) -> Column:
    """One leading preposition removed; articles that belong to a name stay."""
    return strip(F.regexp_replace(col(text), "(?iU)" + PREPOSITION, ""))


def normal_form(text: Column | str, entity_type: Column | str) -> Column:
    """The key under which an entity is assigned: titles off, and for a location its preposition too."""
    bare = strip_titles(text)
    return F.when(col(entity_type) == "LOCATION", strip_prepositions(bare)).otherwise(bare)


def grouping_form(text: Column | str, entity_type: Column | str) -> Column:
    """The key under which variants are grouped."""
    t, kind = col(text), col(entity_type)
    return (
        F.when(kind == "PERSON", strip_titles(t))
        .when(kind == "LOCATION", F.lower(strip_prepositions(t)))
        .otherwise(F.lower(strip(t)))
    )


def parse_name(text: Column | str) -> Column:
    """struct(first, last, ambiguous): the last of several words is the last name."""
    return F.transform(
        F.array(words(strip_titles(text))),
        lambda w: F.struct(
            F.when(F.size(w) == 1, F.get(w, F.lit(0))).when(F.size(w) > 1, F.array_join(F.slice(w, 1, F.size(w) - 1), " ")).alias("first"),
            F.when(F.size(w) > 1, F.element_at(w, -1)).alias("last"),
            (F.size(w) != 2).alias("ambiguous"),
        ),
    )[0]


def capitalized(word: Column | str) -> Column:
    w = col(word)
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))


def gender_key(name: Column | str) -> Column:
    """How a first name is looked up: the part before the first hyphen, capitalised."""
    return F.substring_index(capitalized(col(name)), "-", 1)


def replacement_prefix(text: Column | str, entity_type: Column | str) -> Column:
    """What stands before the normal form in an entity's text, to be kept in front of its pseudonym."""
    t, kind = col(text), col(entity_type)
    bare = strip_titles(t)
    place = strip_prepositions(bare)

    def before(whole: Column, part: Column) -> Column:
        at = F.call_function("locate", part, whole)
        return F.when((part != whole) & (part != "") & (at > 1), whole.substr(F.lit(1), at - 1)).otherwise("")

    return F.when(kind == "PERSON", before(t, bare)).when(kind == "LOCATION", before(bare, place)).otherwise("")


def preview_title(text: Column | str) -> Column:
    """A leading title with one space after it, or nothing."""
    found = F.regexp_extract(col(text), "(?iU)^(?:" + TITLE + ")", 0)
    bare = F.regexp_replace(found, r"(?U)\s+$", "")
    return F.when(bare != "", F.concat(bare, F.lit(" "))).otherwise("")


def context(text: Column | str, start: Column | str, end: Column | str, n: int = 10, mark: tuple[str, str] = ("[", "]")) -> Column:
    """The entity, marked, with up to n words on each side and ... where there are any."""
    t, a, b = col(text), col(start), col(end)
    before, after = words(t.substr(F.lit(1), a)), words(t.substr(b + 1, F.length(t)))
    last = F.when(F.size(before) > n, F.slice(before, -n, n)).otherwise(before)
    head = F.when(F.size(before) > 0, F.concat(F.lit("..."), F.array_join(last, " ")))
    tail = F.when(F.size(after) > 0, F.concat(F.array_join(F.slice(after, 1, n), " "), F.lit("...")))
    return F.concat_ws(" ", head, F.concat(F.lit(mark[0]), t.substr(a + 1, b - a), F.lit(mark[1])), tail)


def span_key(text: Column | str, start: Column | str) -> Column:
    return F.concat_ws("_", col(text), col(start).cast("string"))


def redacted(message: Column | str) -> Column:
    """Quoted strings and runs of capitalised words taken out of an error message."""
    out = F.regexp_replace(col(message), "'[^']*'", "'[REDACTED]'")
    out = F.regexp_replace(out, '"[^"]*"', '"[REDACTED]"')
    return F.regexp_replace(out, r"(?U)\b[A-ZÀ-Ÿ][a-zà-ÿ]+(?:\s+[A-ZÀ-Ÿ][a-zà-ÿ]+)+\b", "[REDACTED]")


def ambiguity_reason(text: Column | str, confidence: Column | str) -> Column:
    t = col(text)
    return (
        F.when(col(confidence) < 0.6, "Low confidence score from NLP model")
        .when(t.contains(" ") & (F.size(words(t)) == 1), "Partial compound name detected")
        .otherwise("Entity flagged as ambiguous by detection algorithm")
    )


def review_flags(ambiguous: Column | str, confidence: Column | str) -> Column:
    c = col(confidence)
    flags = F.concat_ws(" ", F.when(col(ambiguous), "AMB"), F.when((c != 0) & (c < 0.85), "LOW"))
    return F.when(flags == "", "OK").otherwise(flags)


def size_label(size: Column | str) -> Column:
    s = col(size).cast("double")
    out = F.format_string("%.1f TB", s / 1024.0**4)
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(s / 1024.0**k < 1024, F.format_string(f"%.1f {unit}", s / 1024.0**k)).otherwise(out)
    return out


def duration_label(seconds: Column | str) -> Column:
    s = col(seconds)
    long = F.format_string("%dm %ds", F.floor(s / 60), F.floor(s % 60))
    return F.when(s < 60, "< 1m").otherwise(long)


def days_ago(then: Column | str, now: Column | str) -> Column:
    """In whole days of 24 hours."""
    days = F.floor((F.unix_timestamp(col(now)) - F.unix_timestamp(col(then))) / 86400)
    label = F.when(days == 0, "aujourd'hui").when(days == 1, "hier")
    return F.when(col(then).isNull(), "aucune").otherwise(label.otherwise(F.concat(F.lit("il y a "), days.cast("string"), F.lit(" jours"))))


def passphrase_strength(passphrase: Column | str) -> Column:
    """invalid, weak, medium or strong, by length and the number of kinds of characters."""
    p = F.coalesce(col(passphrase), F.lit(""))
    kinds = sum(p.rlike(r).cast("int") for r in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[^\p{L}\p{N}]"))
    n = F.length(p)
    return F.when(n < 12, "invalid").when((n >= 30) & (kinds >= 3), "strong").when((n >= 20) & (kinds >= 2), "medium").otherwise("weak")


def numbered(name: Column | str, prefixes: tuple[str, ...]) -> Column:
    """struct(prefix, number) of names like PER-007; nulls for others."""
    rule = f"^({'|'.join(prefixes)})-([0-9]+)$"
    found = F.regexp_extract(col(name), rule, 1)
    number = F.regexp_extract(col(name), rule, 2)
    return F.struct(F.nullif(found, F.lit("")).alias("prefix"), F.nullif(number, F.lit("")).cast("int").alias("number"))


def edge_cases(text: Column | str, entity_type: Column | str) -> Column:
    """The names of the hard cases that an entity belongs to."""
    t, kind = col(text), col(entity_type)
    # Names and patterns.
    title = r"(?iU)^(?:Dr\.?|Pr\.?|Prof\.?|M\.?|Mme\.?|Mlle\.?|Me\.?|Docteur|Professeur|Madame|Monsieur|Mademoiselle|Maître)\s"
    cases = [
        ("compound_hyphenated", t.rlike("[A-ZÀ-ÖØ-Ÿa-zà-öø-ÿ]+-[A-ZÀ-ÖØ-Ÿa-zà-öø-ÿ]+")),
        ("title_with_name", t.rlike(title)),
        ("abbreviation", t.rlike(r"(?U)\b[A-ZÀ-ÖØ-Ÿ](?:-[A-ZÀ-ÖØ-Ÿ])?\.\s")),
        ("multi_word_org", (kind == "ORG") & t.rlike(r"(?U)\s")),
        ("french_diacritics", t.rlike("[àâäéèêëïîôùûüÿçœæÀÂÄÉÈÊËÏÎÔÙÛÜŸÇŒÆ]")),
        ("last_first_order", (kind == "PERSON") & t.rlike(r"(?U)^[A-ZÀ-ÖØ-Ÿ][a-zà-öø-ÿ]+,\s")),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in cases]))


def confidence_bucket(confidence: Column | str) -> Column:
    c = col(confidence)
    return (
        F.when(c.isNull(), "none")
        .when((c >= 0) & (c < 0.5), "0.0-0.5")
        .when((c >= 0.5) & (c < 0.7), "0.5-0.7")
        .when((c >= 0.7) & (c < 0.9), "0.7-0.9")
        .when((c >= 0.9) & (c < 1.01), "0.9-1.0")
        .otherwise("unknown")
    )


def path_of_key(key: Column | str) -> Column:
    """The path in file:<path>:hash, or null."""
    k = col(key)
    return F.when(k.like("file:%:hash"), k.substr(F.lit(6), F.length(k) - 10))


def column_letter(index: Column | str) -> Column:
    """1 -> A, 27 -> AA, for any long."""
    i, out = col(index).cast("long"), F.lit("")
    for n in range(14):  # a long has no more letters
        least = sum(26**k for k in range(n + 1))
        # whole numbers throughout: a double's quotient isn't exact beyond 2 ** 53
        place = F.pmod(F.call_function("div", i - F.lit(least), F.lit(26**n)), F.lit(26))
        out = F.concat(F.when(i >= least, F.char(F.lit(65) + place)).otherwise(""), out)
    return out


def extension(path: Column | str) -> Column:
    """Lower case, with its dot; empty for none."""
    return F.lower(F.regexp_extract(col(path), r"[^/]+(\.[^./]*)$", 1))


def output_path(path: Column | str) -> Column:
    """<stem>_pseudonymized<ext>; PDF and DOCX become text."""
    p = col(path)
    ext = extension(p)
    stem = p.substr(F.lit(1), F.length(p) - F.length(ext))
    return F.concat(stem, F.lit("_pseudonymized"), F.when(ext.isin(".pdf", ".docx"), ".txt").otherwise(p.substr(F.length(stem) + 1, F.length(p))))
