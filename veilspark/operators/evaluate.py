"""Accuracy of detection against annotated text, and timing summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import numbered


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_scores(rows: DataFrame) -> DataFrame:
    """rows(tp, fp, fn) with precision, recall and f1 as shares, misses and false alarms in percent, 0 where undefined."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.withColumns(
        {
            "precision": p,
            "recall": r,
            "f1": _ratio(2 * p * r, p + r),
            "fn_rate": _ratio(F.col("fn") * 100, F.col("tp") + F.col("fn")),
            "fp_rate": _ratio(F.col("fp") * 100, F.col("tp") + F.col("fp")),
        }
    )


def _norm(text: str) -> Column:
    """A text as it is compared: without case and outer space, inner white space as one blank."""
    return F.lower(T.strip(F.regexp_replace(F.col(text), r"(?U)\s+", " ")))


def _cells(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Numbers of predicted and gold entities of each document, text and type; texts are compared as _norm() has them."""
    one = lambda text: _norm(text).alias("norm")
    p = predicted.select("doc_id", one("text"), "entity_type", *by).groupBy("doc_id", "norm", "entity_type", *by).agg(F.count("*").alias("n_pred"))
    g = gold.select("doc_id", one("entity_text"), "entity_type").groupBy("doc_id", "norm", "entity_type").agg(F.count("*").alias("n_gold"))
    rows = p.join(g, ["doc_id", "norm", "entity_type"], "full")
    return rows.na.fill(0, ["n_pred", "n_gold"])


def text_matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """entity_type (null: all), tp, fp, fn. In a cell of equal texts any pair may match, so the smaller number does."""
    rows = _cells(predicted, gold, [])
    tp = F.least("n_pred", "n_gold")
    return rows.rollup("entity_type").agg(
        F.sum(tp).alias("tp"), F.sum(F.col("n_pred") - tp).alias("fp"), F.sum(F.col("n_gold") - tp).alias("fn")
    )


def _matched(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """doc_id, norm, entity_type, start_pos, end_pos, by..., gold_start and gold_end (null without a match) of every prediction.

    In a document, gold entities of one text and type each take in order of place the unused prediction that begins
    nearest, of equally near ones the first. A fold over the gold entities of such a cell does it.
    """
    key = ["doc_id", "norm", "entity_type"]
    p = predicted.withColumn("norm", _norm("text")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", *by))).alias("p"))
    g = gold.withColumn("norm", _norm("entity_text")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))).alias("g"))
    none = F.lit(None).cast("int")

    def step(state: Column, own: Column) -> Column:
        free = F.filter(state, lambda x: x["gold_start"].isNull())
        near = F.array_min(F.transform(free, lambda x: F.struct(F.abs(x["s"]["start_pos"] - own["start_pos"]).alias("far"), x["k"].alias("k"))))
        one = lambda x, field, at: F.when(x["k"] == near["k"], own[at]).otherwise(x[field]).cast("int").alias(field)
        return F.transform(state, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), one(x, "gold_start", "start_pos"), one(x, "gold_end", "end_pos")))

    open_ = F.transform("p", lambda s, k: F.struct(s.alias("s"), k.alias("k"), none.alias("gold_start"), none.alias("gold_end")))
    rows = p.join(g, key, "left").select(*key, F.explode(F.when(F.col("g").isNull(), open_).otherwise(F.aggregate("g", open_, step))).alias("m"))
    return rows.select(*key, "m.s.*", "m.gold_start", "m.gold_end")


def nearest_matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Matched pairs of one text and type in a document: each gold entity with the nearest unused prediction.

    One to one; as many pairs as text_matches() counts.
    """
    return _matched(predicted, gold, []).where("gold_start IS NOT NULL")


def source_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """source, tp, fp and precision, by the pairs of nearest_matches()."""
    hit = F.col("gold_start").isNotNull()
    out = _matched(predicted, gold, ["source"]).groupBy("source").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))
    return out.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def edge_case_recall(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """edge_case, n_gold, n_found and recall; a gold entity belongs to all cases that fit."""
    norm = _norm("entity_text")
    order = Window.partitionBy("doc_id", "norm", "entity_type").orderBy("start_pos", "end_pos")
    rows = gold.withColumn("norm", norm).withColumn("_r", F.row_number().over(order))
    p = predicted.groupBy("doc_id", _norm("text").alias("norm"), "entity_type").agg(F.count("*").alias("n_pred"))
    rows = rows.join(p, ["doc_id", "norm", "entity_type"], "left").withColumn("hit", F.col("_r") <= F.coalesce("n_pred", F.lit(0)))
    rows = rows.withColumn("edge_case", F.explode(T.edge_cases("entity_text", "entity_type")))
    out = rows.groupBy("edge_case").agg(F.count("*").alias("n_gold"), F.count_if("hit").alias("n_found"))
    return out.withColumn("recall", _ratio(F.col("n_found"), F.col("n_gold")))


def bucket_precision(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """bucket, n, tp and precision by confidence, by the pairs of nearest_matches()."""
    hit = F.col("gold_start").isNotNull()
    rows = _matched(predicted, gold, ["confidence"])
    out = rows.groupBy(T.confidence_bucket("confidence").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(hit).alias("tp"))
    return out.withColumn("precision", _ratio(F.col("tp"), F.col("n")))


def span_matches(predicted: DataFrame, gold: DataFrame, by: list[str] = ()) -> DataFrame:
    """tp, fp and fn of exact spans, as sets of (document, start, end, type)."""
    key = ["doc_id", "start_pos", "end_pos", "entity_type"]
    p = predicted.select(*key).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*key).distinct().withColumn("_g", F.lit(1))
    both, rows = F.col("_p").isNotNull() & F.col("_g").isNotNull(), p.join(g, key, "full")
    return rows.groupBy(*by).agg(
        F.count_if(both).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn")
    )


def micro_average(scores: DataFrame) -> DataFrame:
    return with_scores(scores.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def detector_comparison(runs: DataFrame) -> DataFrame:
    """Per detector: files, spans by type, and time. runs: detector, seconds, n_person, n_location, n_org."""
    n = F.col("n_person") + F.col("n_location") + F.col("n_org")
    return runs.groupBy("detector").agg(
        F.count("*").alias("n_files"), F.sum(n).alias("n_spans"), F.sum("n_person").alias("n_person"), F.sum("n_location").alias("n_location"), F.sum("n_org").alias("n_org"),
        F.sum("seconds").alias("total_s"), F.avg("seconds").alias("avg_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"),
    )


def entity_counts(gold: DataFrame, least: dict[str, int]) -> DataFrame:
    """Per document the number of each type and whether all the least numbers are met."""
    types = ["PERSON", "LOCATION", "ORG"]
    rows = gold.groupBy("doc_id").pivot("entity_type", types).count().na.fill(0)
    enough = F.lit(True)
    for t in types:
        enough &= F.col(t) >= least.get(t, 0)
    return rows.select("doc_id", *types, enough.alias("enough"))


def adjacent_overlaps(gold: DataFrame) -> DataFrame:
    """Annotations that begin before the one in front of them ends."""
    order = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos", "entity_text")
    rows = gold.withColumns({"next_text": F.lead("entity_text").over(order), "next_start": F.lead("start_pos").over(order)})
    return rows.where("next_start < end_pos").select("doc_id", "entity_text", "start_pos", "end_pos", "next_text", "next_start")


# Words of the annotation checks.
JOB_TITLES = ("Directeur", "Directrice", "Chef", "Responsable", "Manager", "Président", "Présidente", "Secrétaire", "Trésorier", "Ingénieur", "Développeur", "Analyste", "Consultant", "Professeur", "Docteur")
SITE_WORDS = ("Siège", "Bureau", "Site")
FRAGMENT_STARTS = ("Mon ", "Ma ", "Le ", "La ", "Les ", "Chez ")
SENTENCE_STARTS = ("Je ", "Nous ", "Il ", "Elle ", "Mais ")
STANDALONE_TITLES = ("Directeur", "Directrice", "Chef", "Responsable", "Manager", "Président", "Présidente", "Secrétaire", "Trésorier", "Analyste")
PLACE_WORDS = ("Siège", "Bureau", "Site", "Région", "Chambre", "Ministère", "Métropole", "Caisse")
COMPANY_WORDS = ("Corp", "France", "Europe", "Microsoft", "Google", "IBM", "Huawei", "Accenture", "Deloitte", "McKinsey", "Cisco", "Solutions", "Promotion", "Wagon", "Direct", "Banque", "Kinsey", "Corporation")
FRAGMENTS = ("égion", "ée également", "éveloppeuse,", "Mais avec")
VERBS = ("suis", "avec", "pour", "pendant", "avant", "après")


def _any(text: Column, values: tuple[str, ...], how: str) -> Column:
    out = F.lit(False)
    for v in values:
        out |= getattr(text, how)(v)
    return out


def _capital(word: Column) -> Column:
    return F.substring(word, 1, 1).rlike(r"\p{Lu}")


def suspicious(gold: DataFrame) -> DataFrame:
    """gold with the reasons for which an annotation looks wrong, where there are any."""
    t, w = F.col("entity_text"), T.words(F.col("entity_text"))
    head = T.strip(F.substring_index(t, ",", 1))
    listed = t.contains(",") & _capital(head)
    named = F.exists(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x: _capital(x) & ~x.isin(*JOB_TITLES))
    person = (F.col("entity_type") == "PERSON") & ~listed
    org = F.col("entity_type") == "ORG"
    reasons = F.array_compact(
        F.array(
            F.when(person & _any(t, JOB_TITLES, "contains") & ~named, "job_title"),
            F.when(person & _any(t, SITE_WORDS, "contains"), "site"),
            F.when(person & _any(t, FRAGMENT_STARTS, "startswith"), "fragment"),
            F.when(person & _any(t, ("Corp", "France"), "contains"), "organisation"),
            F.when(org & (F.size(w) > 5), "too_long"),
            F.when(org & _any(t, SENTENCE_STARTS, "startswith"), "sentence"),
        )
    )
    return gold.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def without_false_positives(gold: DataFrame) -> DataFrame:
    """gold without PERSON and ORG annotations that are surely none."""
    t, w = F.col("entity_text"), T.words(F.col("entity_text"))
    title = t.contains(",") & T.strip(F.substring_index(t, ",", 1)).isin(*STANDALONE_TITLES)
    titled = t.rlike(r"(?U)^(?:Dr\.|Pr\.|M\.|Mme|Me|Professeur|Docteur)\s+[A-ZÀ-Ö]")
    proper = F.size(F.filter(w, lambda x: _capital(x) & ~x.isin(*COMPANY_WORDS) & (F.length(x) > 2)))
    company = _any(t, COMPANY_WORDS, "contains") & ~titled & (proper < 2)
    starts = (*FRAGMENT_STARTS, "En ")
    person = title | _any(t, PLACE_WORDS, "contains") | _any(t, starts, "startswith") | company | _any(t, FRAGMENTS, "contains") | (F.length(t) < 3)
    org = (F.size(w) > 6) | _any(t, (*SENTENCE_STARTS, "Ensuite", "Avec "), "startswith") | _any(F.lower(t), VERBS, "contains")
    wrong = F.when(F.col("entity_type") == "PERSON", person).when(F.col("entity_type") == "ORG", org).otherwise(False)
    return gold.where(~wrong)


def compound_rate(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Of gold people with a hyphen, the number and share that some prediction overlaps."""
    g = gold.where((F.col("entity_type") == "PERSON") & F.col("entity_text").contains("-")).select("doc_id", "start_pos", "end_pos").distinct()
    p = predicted.select("doc_id", F.col("start_pos").alias("a"), F.col("end_pos").alias("b"))
    met = g.join(p, (g["doc_id"] == p["doc_id"]) & (F.col("a") < F.col("end_pos")) & (F.col("start_pos") < F.col("b")), "left_semi").withColumn("hit", F.lit(1))
    rows = g.join(met, ["doc_id", "start_pos", "end_pos"], "left")
    return rows.agg(F.count("*").alias("n_compound"), F.count("hit").alias("n_found"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("rate"))


def index_percentiles(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, 95th and 99th percentile by index into the sorted values, and runs a minute.

    Values are ranked by ranges of their order, and three ranks a group are picked out, so no group's values meet in one
    list or one task.
    """
    total = runs.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    rows = runs.select(F.struct(*by).alias("_g"), F.col(value).alias("_v"), F.monotonically_increasing_id().alias("_t"))
    rows = numbered(rows, ["_v", "_t"], "_g", "_k").select("_g.*", "_v", (F.col("_k") - 1).alias("_k"))
    rows = rows.join(total, by)
    at = lambda share: F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
    pick = lambda k: F.max(F.when(F.col("_k") == k, F.col("_v")))
    rows = rows.groupBy(*by).agg(
        pick(F.floor(F.col("_n") / 2)).alias("p50"), pick(at(F.lit(0.95))).alias("p95"), pick(at(F.lit(0.99))).alias("p99"),
        (F.first("_n") / F.first("_s") * 60).alias("per_minute"),
    )
    return rows


def utility(scores: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return scores.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
