"""Names resolved to ingredients by a waterfall of mapping tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions import text

#: Main groups of the anatomical classification by their letter. Fixed values.
ATC_GROUPS = {
    "A": "Alimentary tract and metabolism",
    "B": "Blood and blood forming organs",
    "C": "Cardiovascular system",
    "D": "Dermatologicals",
    "G": "Genito-urinary system and sex hormones",
    "H": "Systemic hormonal preparations",
    "J": "Antiinfectives for systemic use",
    "L": "Antineoplastic and immunomodulating agents",
    "M": "Musculo-skeletal system",
    "N": "Nervous system",
    "P": "Antiparasitic products",
    "R": "Respiratory system",
    "S": "Sensory organs",
    "V": "Various",
}


def name_frequency(drugs: DataFrame) -> DataFrame:
    """(name, report_count): distinct cases of each name, most first."""
    t = drugs.select("primaryid", F.coalesce(F.when(F.trim("drug_name_normalized") != "", F.col("drug_name_normalized")), F.col("drug_name_raw")).alias("drug_name_normalized")).filter("drug_name_normalized is not null")
    return t.distinct().groupBy("drug_name_normalized").agg(F.count("*").alias("report_count")).orderBy(F.desc("report_count"), "drug_name_normalized")


def ingredients(mapping: DataFrame) -> DataFrame:
    """(name, method, ingredient, ingredient_rxcui): of a name's ingredients the one with the
    lowest numeric code, codes that are no numbers last.

    mapping: (name, method, rxcui, ingredient), a row for each ingredient of a product.
    """
    code = F.coalesce(F.expr("try_cast(rxcui as bigint)"), F.lit(1 << 62))
    t = mapping.groupBy("name", "method").agg(F.min(F.struct(code.alias("code"), F.col("rxcui"), F.col("ingredient"))).alias("x"))
    return t.select("name", "method", "x.ingredient", F.col("x.rxcui").alias("ingredient_rxcui"))


def drug_dimension(names: DataFrame, exact: DataFrame, normalized: DataFrame | None = None, approximate: DataFrame | None = None, atc: DataFrame | None = None) -> DataFrame:
    """(drug_name_normalized, analysis_key, ingredient, ingredient_rxcui, rxnorm_method,
    rxnorm_confidence, drug_class_atc, report_count).

    The tiers are (name, rxcui, ingredient) tables, tried in order with confidence high,
    medium and low; atc: (rxcui, class_id), of which the longest code counts. The key is the
    ingredient in upper case, else the name.
    """
    t = names
    tiers = [("rxnorm_exact", "high", exact), ("rxnorm_normalized", "medium", normalized), ("rxnorm_approximate", "low", approximate)]
    tiers = [(m, c, x) for m, c, x in tiers if x is not None]
    for i, (method, _, table) in enumerate(tiers):
        x = ingredients(table.withColumn("method", F.lit(method))).select(F.upper(F.trim("name")).alias(f"_k{i}"), F.struct("ingredient", "ingredient_rxcui").alias(f"_t{i}"))
        x = x.groupBy(f"_k{i}").agg(F.min(f"_t{i}").alias(f"_t{i}"))
        t = t.join(x, F.upper(F.trim("drug_name_normalized")) == F.col(f"_k{i}"), "left")
    pick = F.coalesce(*(F.col(f"_t{i}") for i in range(len(tiers))))
    method, confidence = F.lit("unmatched"), F.lit("unknown")
    for i, (m, c, _) in reversed(list(enumerate(tiers))):
        method = F.when(F.col(f"_t{i}").isNotNull(), m).otherwise(method)
        confidence = F.when(F.col(f"_t{i}").isNotNull(), c).otherwise(confidence)
    t = t.withColumn("_p", pick).select("drug_name_normalized", F.coalesce(F.upper("_p.ingredient"), "drug_name_normalized").alias("analysis_key"), F.col("_p.ingredient").alias("ingredient"), F.col("_p.ingredient_rxcui").alias("ingredient_rxcui"), method.alias("rxnorm_method"), confidence.alias("rxnorm_confidence"), "report_count")
    if atc is None:
        return t.withColumn("drug_class_atc", F.lit(None).cast("string"))
    a = atc.groupBy(F.col("rxcui").alias("_r")).agg(F.max_by("class_id", F.struct(F.length("class_id"), F.col("class_id"))).alias("class_id"))
    return t.join(a, F.col("ingredient_rxcui") == F.col("_r"), "left").withColumn("drug_class_atc", text.lookup(ATC_GROUPS, F.substring("class_id", 1, 1))).drop("_r", "class_id")
