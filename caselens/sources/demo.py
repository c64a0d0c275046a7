"""Made-up case tables for demonstrations and tests: distributed, and alike for a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.config import CURATED

EVENTS = ("NAUSEA", "VOMITING", "DIARRHOEA", "PANCREATITIS ACUTE", "HEADACHE", "RASH", "LACTIC ACIDOSIS", "HYPOGLYCAEMIA")


def demo_silver(spark: SparkSession, cases: int = 2000, seed: int = 42) -> dict[str, DataFrame]:
    """Reports of eight quarters with one or two items and events each; every item has one
    event that it names more often, from the sixth quarter on ever more."""
    names = sorted(CURATED.names)
    items, events = F.array(*(F.lit(n) for n in names)), F.array(*(F.lit(e) for e in EVENTS))

    def lot(salt: str, n: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(n)).cast("int")

    t = spark.range(cases).withColumns({"item": lot("item", len(names)), "quarter_no": lot("quarter", 8)})
    own = lot("own", 100) < F.when(F.col("quarter_no") >= 5, 45 + 10 * (F.col("quarter_no") - 4)).otherwise(45)
    t = t.withColumn("event", F.when(own, F.col("item") % len(EVENTS)).otherwise(lot("event", len(EVENTS))))
    day = F.date_add(F.add_months(F.lit("2022-01-01").cast("date"), F.col("quarter_no") * 3), lot("day", 80))
    t = t.withColumns({"primaryid": F.col("id").cast("string"), "fda_date": day})
    quarter = F.concat(F.year("fda_date").cast("string"), F.lit("Q"), F.quarter("fda_date").cast("string"))
    reports = t.select("primaryid", F.concat(F.lit("c"), "primaryid").alias("caseid"), F.lit(1).alias("case_version"), "fda_date", F.when(lot("sex", 2) == 0, "M").otherwise("F").alias("patient_sex"), lot("age", 95).cast("double").alias("patient_age"), F.lit("YR").alias("patient_age_unit"), quarter.alias("faers_quarter"))
    more = F.array_distinct(F.array("item", lot("second", len(names))))
    drugs = t.select("primaryid", F.explode(more).alias("i")).select("primaryid", F.get(items, F.col("i")).alias("drug_name_normalized"), F.upper(F.get(items, F.col("i"))).alias("drug_name_raw"), F.get(F.array(*(F.lit(CURATED.names[n][0]) for n in names)), F.col("i")).alias("drug_class"), F.lit("PS").alias("role_code"))
    reactions = t.select("primaryid", F.explode(F.array_distinct(F.array("event", lot("other", len(EVENTS))))).alias("e")).select("primaryid", F.get(events, F.col("e").cast("int")).alias("reaction_term"), F.get(events, F.col("e").cast("int")).alias("reaction_term_normalized"))
    outcomes = t.filter(lot("serious", 3) == 0).select("primaryid", F.lit("HO").alias("outcome_code"))
    return {"reports": reports, "drugs": drugs, "reactions": reactions, "outcomes": outcomes}
