"""Literature support of signals from a table of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselens.functions import text

DRUG, EVENT = "drug_name_normalized", "adverse_event"


def candidate_pairs(emerging: DataFrame, scores: DataFrame, top: int = 25, least: int = 25) -> DataFrame:
    """(drug, event): the top emerging pairs and then the top flagged ones, each once, where
    the first source that names a pair wins."""
    first = emerging.orderBy(F.desc("priority_score"), DRUG, EVENT).limit(top).select(DRUG, EVENT, F.lit(0).alias("source"), F.col("priority_score").alias("value"))
    second = scores.filter(F.col("disproportionality_flag") & (F.col("a_drug_event") >= least)).orderBy(F.desc("ror"), DRUG, EVENT).limit(top).select(DRUG, EVENT, F.lit(1).alias("source"), F.col("ror").alias("value"))
    w = Window.partitionBy(DRUG, EVENT).orderBy("source", F.desc("value"))
    return first.unionByName(second).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(DRUG, EVENT, "source")


def evidence(pairs: DataFrame, articles: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """A row for each pair and article that names the item, or a synonym, and the event.

    pairs: a bounded list of pairs, matched against all articles in one pass over them;
    articles: (pmid, title, abstract, journal, publication_year); synonyms: (drug, synonym),
    matched without case.
    """
    p = pairs.select(DRUG, EVENT)
    names = p.select(DRUG, EVENT, F.col(DRUG).alias("name"))
    if synonyms is not None:
        s = synonyms.select(F.upper("drug").alias("d"), F.col("synonym"))
        names = names.unionByName(p.join(s, F.upper(DRUG) == F.col("d")).select(DRUG, EVENT, F.col("synonym").alias("name"))).distinct()
    blob = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    hits = articles.join(F.broadcast(names), text.mentions(blob, F.col("name")) & text.event_present(blob, F.col(EVENT)))  # the pairs are a top-k
    r = text.relevance(F.col("title"), F.col("abstract"), F.col("name"), F.col(EVENT))
    best = hits.withColumn("r", r).groupBy(DRUG, EVENT, "pmid").agg(F.max_by(F.struct("title", "journal", "publication_year", "r"), F.struct("r.relevance_score", "name")).alias("x"))
    return best.select(DRUG, EVENT, "pmid", "x.title", "x.journal", "x.publication_year", "x.r.*")


def support_level(score: Column) -> Column:
    return F.when(score <= 0, "None").when(score < 0.25, "Weak").when(score < 0.55, "Moderate").otherwise("Strong")


def support_summary(evidence: DataFrame, recent_from: int = 2022) -> DataFrame:
    """(drug, event, literature_support_count, literature_support_score, support_level)."""
    t = evidence.groupBy(DRUG, EVENT).agg(F.count("*").alias("n"), F.count_if(F.coalesce("publication_year", F.lit(0)) >= recent_from).alias("recent"), F.max("relevance_score").alias("best"), F.count_if("adverse_context").alias("adverse"))
    score = 0.35 * F.least(F.lit(1.0), F.col("n") / 20) + 0.25 * F.least(F.lit(1.0), F.col("recent") / 10) + 0.25 * F.col("best") + 0.15 * F.least(F.lit(1.0), F.col("adverse") / F.col("n"))
    t = t.withColumn("literature_support_score", F.round(score, 3))
    return t.select(DRUG, EVENT, F.col("n").alias("literature_support_count"), "literature_support_score", support_level(F.col("literature_support_score")).alias("support_level"))


def by_year(evidence: DataFrame) -> DataFrame:
    return evidence.filter("publication_year is not null").groupBy("publication_year").agg(F.count("*").alias("articles"))
