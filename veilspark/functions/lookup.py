"""Dictionaries: small originals of our own, larger ones by path, and lookups against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: A short dictionary to run and test with; a real one is read from files.
GENDERS = {
    "male": ["Jean", "Pierre", "Luc", "François", "Paul", "Hugo", "Louis", "Marc"],
    "female": ["Marie", "Sophie", "Claire", "Élise", "Anne", "Jeanne", "Alice", "Emma"],
    "ambiguous": ["Camille", "Claude", "Dominique"],
}
LAST_NAMES = ["Dubois", "Martin", "Lefebvre", "Moreau", "Durand", "Laurent", "Bernard", "Petit", "Mercier", "Fontaine"]
PLACES = {
    "city": ["Paris", "Lyon", "Marseille", "Toulouse", "Nice", "Lille", "La Rochelle", "Aix-en-Provence"],
    "region": ["Bretagne", "Occitanie", "Île-de-France"],
    "country": ["France", "Belgique", "Suisse"],
}


def table(spark: SparkSession, rows: dict[str, list[str]], key: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, values in rows.items() for v in values], f"{key} string, value string")


def genders(spark: SparkSession) -> DataFrame:
    """gender, value"""
    return table(spark, GENDERS, "gender")


def names(spark: SparkSession) -> DataFrame:
    """kind (first, last), value"""
    first = [n for kind in GENDERS.values() for n in kind]
    return table(spark, {"first": first, "last": LAST_NAMES}, "kind")


def places(spark: SparkSession) -> DataFrame:
    """category, value"""
    return table(spark, PLACES, "category")


def with_gender(rows: DataFrame, name: str, lookup: DataFrame, out: str = "gender") -> DataFrame:
    """rows with the gender of a first name; null for an ambiguous or unknown one."""
    own = lookup.groupBy("value").agg(F.collect_set("gender").alias("_g")).withColumnRenamed("value", "_name")
    found = rows.join(own, T.gender_key(name) == F.col("_name"), "left")
    has = lambda g: F.array_contains("_g", F.lit(g))
    gender = F.when(has("ambiguous"), None).when(has("male"), "male").when(has("female"), "female")
    return found.withColumn(out, gender).drop("_g", "_name")


def with_name_gender(rows: DataFrame, text: str, lookup: DataFrame, out: str = "gender") -> DataFrame:
    """rows with the gender of a person's first word; null for other entity types."""
    word = F.when(F.col("entity_type") == "PERSON", F.get(T.words(T.strip_titles(text)), F.lit(0)))
    return with_gender(rows.withColumn("_word", word), "_word", lookup, out).drop("_word")


def is_name(rows: DataFrame, column: str, values: DataFrame, out: str) -> DataFrame:
    """rows with whether a word, as it stands or capitalised, is in a dictionary (column `value`)."""
    own = values.select(F.col("value").alias("_v")).distinct()
    a = own.select(F.col("_v").alias("_a"))
    b = own.select(F.col("_v").alias("_b"))
    found = rows.join(a, F.col(column) == F.col("_a"), "left").join(b, T.capitalized(column) == F.col("_b"), "left")
    return found.withColumn(out, F.col("_a").isNotNull() | F.col("_b").isNotNull()).drop("_a", "_b")


# -- pseudonym pools


#: Least numbers that a library must have.
LEAST = {"first": 500, "last": 500, "location": 80, "organization": 35}


def load_pool(path: str, theme: str | None = None, least: dict[str, int] = LEAST) -> list[tuple[str, str, str, int, str]]:
    """(theme, kind, category, ord, value) of a library file, checked; a value counts once a kind.

    JSON: theme, first_names {male, female, neutral}, last_names, locations {category: [...]}, organizations {category: [...]}.
    """
    import json

    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    return pool_rows(found, theme, least)


def pool_rows(library: dict, theme: str | None = None, least: dict[str, int] = LEAST) -> list[tuple[str, str, str, int, str]]:
    own = library.get("theme")
    if not own or theme and own != theme:
        raise ValueError(f"the library's theme is {own!r}, not {theme!r}")
    kinds = {"first": "first_names", "last": "last_names", "location": "locations", "organization": "organizations"}
    rows, sizes = [], {}
    for kind, field in kinds.items():
        part = library.get(field)
        if part is None:
            raise ValueError(f"{field} is missing")
        seen: set[str] = set()
        listed = 0
        for category, values in (part if isinstance(part, dict) else {"any": part}).items():
            listed += len(values)
            for value in values:
                if value not in seen:
                    seen.add(value)
                    rows.append((own, kind, category, len(seen), value))
        sizes[kind] = listed
    short = {k: n for k, n in sizes.items() if n < least.get(k, 0)}
    if short:
        raise ValueError(f"too few names: {short}, at least {least}")
    return rows


def pool(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "theme string, kind string, category string, ord int, value string")


def made_up_library(theme: str = "plain", n: int = 500) -> dict:
    """A library from rules, for tests and where no file is at hand."""
    start, mid, end = ["Ba", "Do", "Fe", "Ga", "Li", "Mo", "Na", "Ri", "So", "Va"], ["l", "r", "n", "d", "m", "v", "s", "t"], ["in", "el", "an", "or", "is", "eau", "et", "on"]
    word = lambda k, tail: start[k % 10] + mid[k // 10 % 8] + end[k // 80 % 8] + tail
    every = [word(k, "") for k in range(n)]
    return {
        "theme": theme,
        "first_names": {"male": every[::3], "female": every[1::3], "neutral": every[2::3]},
        "last_names": [word(k, "ac") for k in range(n)],
        "locations": {"cities": [word(k, "ville") for k in range(60)], "regions": [word(k, "mont") for k in range(30)]},
        "organizations": {"companies": [word(k, " Conseil") for k in range(40)]},
    }
