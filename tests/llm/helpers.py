from __future__ import annotations

import random


def docs_of(spark, rows, extra=None):
    """(doc_id, text) or (doc_id, text, lang, source) rows as a documents table."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    for name, value in (extra or {}).items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda k: "".join(parts[(k // 12**j) % 12] for j in range(3))
    return [word(rng.randrange(vocabulary)) for _ in range(n)]


ODD = [None, "", "   \n\t ", "one", "Two words", "Été \U0001f600 naïve", "x " * 30_000, "a" * 200_000]
