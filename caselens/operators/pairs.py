"""Counts of item x event pairs and their totals, and the scored matrix.

Items and events are deduplicated per case before they meet, so plain counts count cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.config import Thresholds
from caselens.functions import bayes, stats
from caselens.operators.cases import CaseTables
from caselens.session import stored

PAIR_COLUMNS = ("drug", "event", "a", "serious_a", "drug_total", "event_total", "n")
KEYS = ["drug_name_normalized", "adverse_event"]


def drug_marginals(case_drug: DataFrame) -> DataFrame:
    return case_drug.groupBy("drug").agg(F.count("*").alias("drug_total"), F.min("drug_class").alias("drug_class"))


def event_marginals(case_reaction: DataFrame) -> DataFrame:
    return case_reaction.groupBy("event").agg(F.count("*").alias("event_total"))


def pair_counts(t: CaseTables) -> DataFrame:
    """(drug, event, a, serious_a): cases with both, and those of them with an outcome.

    The flag of seriousness joins items, which have fewer rows than the pairs; all joins are
    by case, so one partitioning by case serves them all.
    """
    flagged = t.case_drug.join(t.serious.withColumn("serious", F.lit(True)), "primaryid", "left")
    both = flagged.join(t.case_reaction, "primaryid")
    return both.groupBy("drug", "event").agg(F.count("*").alias("a"), F.count_if(F.coalesce("serious", F.lit(False))).alias("serious_a"))


def pair_table(t: CaseTables) -> DataFrame:
    """Pair counts with their totals and the number of cases, which is a one-row join."""
    n = t.latest.agg(F.count("*").alias("n"))
    return pair_counts(t).join(drug_marginals(t.case_drug), "drug").join(event_marginals(t.case_reaction), "event").crossJoin(F.broadcast(n))


def with_cells(pairs: DataFrame) -> DataFrame:
    c = stats.cells(F.col("a"), F.col("drug_total"), F.col("event_total"), F.col("n"))
    return pairs.withColumns({k: v for k, v in c.items() if k != "a"})


def score_pairs(pairs: DataFrame, thresholds: Thresholds = Thresholds(), ebgm: bool = True) -> DataFrame:
    """The matrix of signal scores. ebgm: with empirical-Bayes scores, fitted over the table."""
    if missing := [c for c in PAIR_COLUMNS if c not in pairs.columns]:
        raise ValueError(f"pairs lack {missing}")
    t = with_cells(pairs)
    abcd = tuple(F.col(c) for c in "abcd")
    low, high = stats.ror_interval(*abcd)
    t = t.select(
        F.col("drug").alias("drug_name_normalized"),
        (F.col("drug_class") if "drug_class" in pairs.columns else F.lit(None).cast("string")).alias("drug_class"),
        F.col("event").alias("adverse_event"),
        F.col("a").cast("long").alias("a_drug_event"),
        F.col("b").cast("long").alias("b_drug_other_events"),
        F.col("c").cast("long").alias("c_other_drugs_event"),
        F.col("d").cast("long").alias("d_other_drugs_other_events"),
        stats.prr(*abcd).alias("prr"),
        stats.ror(*abcd).alias("ror"),
        low.alias("ror_ci_lower"),
        high.alias("ror_ci_upper"),
        stats.chi_square_yates(*abcd).alias("chi_square"),
        stats.expected(*abcd).alias("expected_count"),
        stats.shrunken(*abcd).alias("bayesian_shrunken_score"),
        F.col("serious_a").cast("long").alias("serious_count"),
        stats.clip01(stats.safe_ratio(F.col("serious_a"), F.col("a"))).alias("seriousness_rate"),
        (F.col("a") < thresholds.minimum_reports).alias("min_count_flag"),
        stats.needs_correction(*abcd).alias("continuity_correction"),
    )
    t = t.withColumn("disproportionality_flag", stats.is_signal(F.col("a_drug_event"), F.col("ror_ci_lower"), F.col("prr"), F.col("chi_square"), thresholds))
    return with_ebgm(stored(t, "matrix")) if ebgm else t


def with_ebgm(scores: DataFrame) -> DataFrame:
    """scores, a written table as it is read three times, with empirical-Bayes columns fitted
    over it; nulls where it is empty."""
    if scores.isEmpty():
        return scores.withColumns({c: F.lit(None).cast("double") for c in ("ebgm", "eb05", "eb95")})
    theta = bayes.fit_sample(scores, KEYS, "a_drug_event", "expected_count")
    t = scores.withColumn("_eb", bayes.score_columns(F.col("a_drug_event"), F.col("expected_count"), theta))
    return t.withColumns({c: F.col(f"_eb.{c}") for c in ("ebgm", "eb05", "eb95")}).drop("_eb")
