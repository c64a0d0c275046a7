"""Signals within strata of cases, against the overall signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import stats
from caselens.operators.cases import CaseTables

#: Closed bands of whole years; ages between bands belong to none. Fixed values.
AGE_BANDS = (("0-17", 0, 17), ("18-64", 18, 64), ("65+", 65, 120))


def strata_of(sex: Column, age: Column, bands=AGE_BANDS) -> Column:
    """An array of (subgroup_type, subgroup) of a case."""
    parts = [F.when(F.upper(sex) == code, F.struct(F.lit("sex").alias("subgroup_type"), F.lit(name).alias("subgroup"))) for code, name in (("M", "male"), ("F", "female"))]
    parts += [F.when(age.between(low, high), F.struct(F.lit("age").alias("subgroup_type"), F.lit(name).alias("subgroup"))) for name, low, high in bands]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def base_signals(scores: DataFrame, top: int = 30, least: int = 100) -> DataFrame:
    """Flagged pairs with enough reports, most reports first."""
    t = scores.filter(F.col("disproportionality_flag") & (F.col("a_drug_event") >= least))
    return t.orderBy(F.desc("a_drug_event"), "drug_name_normalized", "adverse_event").limit(top)


def subgroup_signals(t: CaseTables, strata: DataFrame, base: DataFrame, least: int = 3) -> DataFrame:
    """strata: (primaryid, subgroup_type, subgroup); base: overall scores of few pairs.

    All strata are counted at once: populations, totals of the pairs' items and events and
    joint counts are groupings by stratum, joined.
    """
    by = ["subgroup_type", "subgroup"]
    pairs = base.select(F.col("drug_name_normalized").alias("drug"), F.col("adverse_event").alias("event"), F.col("ror").alias("overall_ror"))
    s = strata.join(t.latest.select("primaryid"), "primaryid")
    drugs = t.case_drug.select("primaryid", "drug").join(F.broadcast(pairs.select("drug").distinct()), "drug", "left_semi")  # the base pairs are a top-k
    events = t.case_reaction.join(F.broadcast(pairs.select("event").distinct()), "event", "left_semi")
    population = s.groupBy(*by).agg(F.count("*").alias("stratum_population"))
    d = drugs.join(s, "primaryid")
    drug_total = d.groupBy(*by, "drug").agg(F.count("*").alias("drug_total"))
    event_total = events.join(s, "primaryid").groupBy(*by, "event").agg(F.count("*").alias("event_total"))
    a = d.join(events, "primaryid").join(F.broadcast(pairs), ["drug", "event"], "left_semi").groupBy(*by, "drug", "event").agg(F.count("*").alias("a"))
    both = a.filter(F.col("a") >= least).join(drug_total, [*by, "drug"]).join(event_total, [*by, "event"]).join(population, by).join(F.broadcast(pairs), ["drug", "event"])
    c = stats.cells(F.col("a"), F.col("drug_total"), F.col("event_total"), F.col("stratum_population"))
    both = both.withColumns({k: v for k, v in c.items() if k != "a"})
    abcd = tuple(F.col(k) for k in "abcd")
    low, high = stats.ror_interval(*abcd)
    return both.select(
        F.col("drug").alias("drug_name_normalized"),
        F.col("event").alias("adverse_event"),
        *by,
        F.col("a").alias("stratum_reports"),
        "stratum_population",
        stats.ror(*abcd).alias("ror"),
        low.alias("ror_ci_lower"),
        high.alias("ror_ci_upper"),
        stats.prr(*abcd).alias("prr"),
        stats.chi_square_yates(*abcd).alias("chi_square"),
        "overall_ror",
    )


def concentration(subgroups: DataFrame, top: int = 8) -> DataFrame:
    t = subgroups.withColumn("concentration_ratio", F.col("ror") / F.greatest(F.col("overall_ror"), F.lit(0.01)))
    return t.orderBy(F.desc_nulls_last("concentration_ratio"), "drug_name_normalized", "adverse_event", "subgroup_type", "subgroup").limit(top)
