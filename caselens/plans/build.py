"""The whole pipeline: extracts to silver, silver to marts, marts enriched."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.config import Thresholds, Weights
from caselens.operators import cases, enrich, interactions, labels, literature, marts, pairs, subgroups, trend
from caselens.session import stored
from caselens.sources import bronze, lake
from caselens.sources.lake import Gold

REQUIRED = ("reports", "drugs", "reactions")


def ingest(spark: SparkSession, bronze_root: str, silver_root: str, quarters: list[tuple[int, int]] | None = None, force: bool = False) -> list[str]:
    """Writes each table's new quarters; quarters already there stay unless forced."""
    quarters = quarters or bronze.discover_quarters(spark, bronze_root)
    written = []
    for table in bronze.FILES:
        todo = [q for q in quarters if force or not lake.is_ingested(spark, f"{silver_root}/{table}", *q)]
        t = bronze.silver_table(spark, bronze_root, table, todo) if todo else None
        if t is not None:
            lake.write_silver(t, f"{silver_root}/{table}")
            written.append(table)
    gone = bronze.silver_deleted(spark, bronze_root, quarters)
    lake.write_silver(gone, f"{silver_root}/deleted_cases")
    return written


def read_silver(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables there are; raises where a required one is missing."""
    names = (*bronze.FILES, "deleted_cases")
    found = {n: t for n in names if (t := lake.read_table(spark, f"{root}/{n}")) is not None}
    if missing := [n for n in REQUIRED if n not in found]:
        raise FileNotFoundError(f"silver tables missing: {missing}")
    return found


def build_gold(spark: SparkSession, silver: dict[str, DataFrame], gold: Gold, dimension: DataFrame | None = None, top_k: int = 200, roles=cases.SUSPECT_ROLES, thresholds: Thresholds = Thresholds(), weights: Weights = Weights()) -> DataFrame:
    """All marts of the matrix. The matrix is written first; the others read what is written,
    so nothing is computed twice and none of it comes to the driver."""
    began = time.time()
    t = cases.case_tables(silver, roles, dimension, keep=True)
    gold.write(pairs.score_pairs(pairs.pair_table(t), thresholds), "signal_scores")
    scores = gold.read("signal_scores")
    gold.write(marts.scatter_sample(scores), "signal_scores_sample", 1)
    gold.write(marts.summary_stats(scores), "signal_scores_stats", 1)
    gold.write(marts.drug_facets(scores), "signal_drugs", 1)
    gold.write(marts.event_facets(scores), "signal_events", 1)
    keys = trend.top_pairs(scores, top_k)
    calendar = t.latest.select("faers_quarter").withColumnRenamed("faers_quarter", "quarter").distinct()
    gold.write(trend.emerging_signals(trend.quarterly_trend(t, keys), scores, top_k, thresholds, weights, calendar), "emerging_signals", 1)
    checks = marts.quality_checks(scores)
    gold.write(checks, "data_quality_checks", 1)
    span = calendar.selectExpr("concat(min(quarter), '..', max(quarter)) as s").first()["s"] or ""
    health = marts.pipeline_health(spark, gold.read("data_quality_checks"), "silver", span, {"gold": scores.count()}, time.time() - began)
    gold.write(health, "pipeline_health", 1)
    return scores


def enrich_gold(
    spark: SparkSession,
    silver: dict[str, DataFrame],
    gold: Gold,
    label_texts: DataFrame | None = None,
    articles: DataFrame | None = None,
    synonyms: DataFrame | None = None,
    population: DataFrame | None = None,
    dimension: DataFrame | None = None,
    base_least: int = 100,
    roles=cases.SUSPECT_ROLES,
    thresholds: Thresholds = Thresholds(),
    weights: Weights = Weights(),
) -> list[str]:
    """The marts that stand on the matrix, in order: label flags (folded into the matrix),
    subgroups, interactions, literature and the enriched priorities. Marts whose input is
    not given are left out; enrichment then counts them as absent. Returns those written."""
    t = cases.case_tables(silver, roles, dimension, keep=True)
    scores, written = gold.read("signal_scores"), []

    def put(table: DataFrame, name: str) -> DataFrame:
        gold.write(stored(table, name), name)  # a mart may be made from itself
        written.append(name)
        return gold.read(name)

    if label_texts is not None:
        flags = put(labels.label_flags(scores.select("drug_name_normalized", "adverse_event"), label_texts), "drug_label_flags")
        scores = put(labels.fold_flags(scores, flags), "signal_scores")
        put(marts.summary_stats(scores), "signal_scores_stats")
        put(marts.scatter_sample(scores), "signal_scores_sample")
    r = silver["reports"]
    if {"patient_sex", "patient_age"} <= set(r.columns):
        strata = r.select(F.col("primaryid").cast("string").alias("primaryid"), F.explode(subgroups.strata_of(F.col("patient_sex"), F.expr("try_cast(patient_age as double)"))).alias("s")).select("primaryid", "s.*")
        put(subgroups.subgroup_signals(t, strata, subgroups.base_signals(scores, least=base_least)), "subgroup_signals")
    put(interactions.interaction_signals(t, scores), "interaction_signals")
    emerging = gold.read("emerging_signals")
    support = spark.createDataFrame([], "drug_name_normalized string, adverse_event string, literature_support_count long, literature_support_score double")
    if articles is not None:
        found = put(literature.evidence(literature.candidate_pairs(emerging, scores), articles, synonyms), "pubmed_evidence")
        support = put(literature.support_summary(found), "pubmed_support_summary")
    people = spark.createDataFrame([], "medication_name_normalized string, drug_class string, unweighted_sample_count long")
    if population is not None:
        people = put(population, "nhanes_population_context")
        people = people if "drug_class" in people.columns else people.withColumn("drug_class", F.lit(None).cast("string"))
    put(enrich.enrich(emerging, scores, support, people, thresholds, weights), "emerging_signals")
    return written
