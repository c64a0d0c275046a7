"""Priorities of emerging signals, with literature and population context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.config import Thresholds, Weights
from caselens.functions import stats
from caselens.operators import trend

DRUG, EVENT = "drug_name_normalized", "adverse_event"
DERIVED = ("bayesian_shrunken_score", "literature_support_count", "literature_support_score", "nhanes_context_available", "disproportionality_component", "trend_component", "seriousness_component", "literature_component", "population_component", "priority_score", "priority_level")


def enrich(emerging: DataFrame, scores: DataFrame, support: DataFrame, population: DataFrame, thresholds: Thresholds = Thresholds(), weights: Weights = Weights()) -> DataFrame:
    """emerging with five components and the priority made of them.

    What an earlier run derived is dropped first, so enriching twice changes nothing.
    population: (medication_name_normalized, drug_class, unweighted_sample_count); names and
    classes compare without case. An item counts 1 with at least 30 sampled users, 0.6 with
    fewer, 0.4 when only its class was sampled, else 0.
    """
    e = emerging.drop(*DERIVED)
    s = scores.select(DRUG, EVENT, "bayesian_shrunken_score")
    lit = support.select(DRUG, EVENT, "literature_support_count", "literature_support_score")
    meds = population.groupBy(F.upper("medication_name_normalized").alias("med")).agg(F.max("unweighted_sample_count").alias("users"))
    classes = population.filter("drug_class is not null").select(F.upper("drug_class").alias("class")).distinct().withColumn("class_known", F.lit(True))
    t = e.join(s, [DRUG, EVENT], "left").join(lit, [DRUG, EVENT], "left").join(meds, F.upper(DRUG) == F.col("med"), "left").join(classes, F.upper("drug_class") == F.col("class"), "left")
    context = F.when(F.col("users") >= thresholds.small_n, 1.0).when(F.col("users").isNotNull(), 0.6).when(F.col("class_known"), 0.4).otherwise(0.0)
    t = t.withColumns(
        {
            "literature_support_count": F.coalesce("literature_support_count", F.lit(0)).cast("long"),
            "literature_support_score": F.coalesce("literature_support_score", F.lit(0.0)),
            "disproportionality_component": F.round(stats.clip01(F.col("bayesian_shrunken_score") / 3), 4),
            "trend_component": F.round(stats.clip01(F.col("anomaly_score") / 3), 4),
            "seriousness_component": F.round(stats.clip01(F.col("seriousness_rate")), 4),
            "population_component": context,
            "nhanes_context_available": context > 0,
        }
    )
    t = t.withColumn("literature_component", F.round(stats.clip01(F.col("literature_support_score")), 4))
    score = trend.priority(F.col("bayesian_shrunken_score") / 3, F.col("anomaly_score") / 3, F.col("seriousness_rate"), F.col("literature_support_score"), context, weights)
    t = t.withColumn("priority_level", trend.priority_level(score, thresholds)).withColumn("priority_score", F.round(score, 4))
    return t.drop("med", "users", "class", "class_known").orderBy(F.desc("priority_score"), DRUG, EVENT)
