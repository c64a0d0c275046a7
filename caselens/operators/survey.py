"""Population context from a weighted survey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.config import Thresholds
from caselens.functions import text


def eligible(participants: DataFrame, weight: str) -> DataFrame:
    return participants.filter(F.col(weight) > 0)


def medications(rx: DataFrame, id: str, drug: str, names: dict[str, str] | None = None) -> DataFrame:
    """(id, medication), each once: combination products split at semicolons, names mapped
    where a mapping is given and left out where it has none."""
    t = rx.select(id, F.explode(text.split_products(F.upper(drug))).alias("medication"))
    if names is not None:
        t = t.withColumn("medication", text.lookup({k.upper(): v for k, v in names.items()}, F.col("medication"))).filter("medication is not null")
    return t.distinct()


def population_context(participants: DataFrame, users: DataFrame, id: str, weight: str, age: str, female: str, bmi: str, diabetes: str, hba1c: str, t: Thresholds = Thresholds()) -> DataFrame:
    """A row for each medication: weighted prevalence among the eligible, and its users'
    profile. Shares count a missing covariate as false; medians skip it. One join of users
    with participants serves all medications; the total weight is a one-row join."""
    base = eligible(participants, weight)
    total = base.agg(F.sum(weight).alias("total_weight"))
    u = users.join(base, id)

    def share(cond):
        return 100 * F.avg(F.when(cond, 1.0).otherwise(0.0))

    g = u.groupBy("medication").agg(
        F.sum(weight).alias("estimated_users"),
        F.count("*").alias("unweighted_sample_count"),
        F.median(age).alias("median_age"),
        share(F.col(female)).alias("female_percent"),
        share(F.col(bmi) >= 30).alias("bmi_ge_30_percent"),
        share(F.col(diabetes)).alias("diabetes_percent"),
        F.median(hba1c).alias("hba1c_median"),
    )
    g = g.crossJoin(F.broadcast(total))
    n = F.col("unweighted_sample_count")
    return g.select(
        F.col("medication").alias("medication_name_normalized"),
        F.try_divide("estimated_users", F.when(F.col("total_weight") > 0, F.col("total_weight"))).alias("weighted_prevalence"),
        "estimated_users",
        "unweighted_sample_count",
        "median_age",
        "female_percent",
        "bmi_ge_30_percent",
        "diabetes_percent",
        "hba1c_median",
        (n < t.small_n).alias("small_n_flag"),
        (n < t.very_small_n).alias("very_small_n_flag"),
    )
