"""Quarterly series, their anomalies and the composite priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselens.config import Thresholds, Weights
from caselens.functions import stats
from caselens.operators.cases import CaseTables


def top_pairs(scores: DataFrame, k: int, by: str = "eb05") -> DataFrame:
    """(drug, event) of the k first by the score, ties by name."""
    by = by if by in scores.columns else "ror"
    return scores.orderBy(F.col(by).desc_nulls_last(), "drug_name_normalized", "adverse_event").limit(k).select(F.col("drug_name_normalized").alias("drug"), F.col("adverse_event").alias("event"))


def quarterly_trend(t: CaseTables, keys: DataFrame | None = None) -> DataFrame:
    """(drug, event, quarter, report_count), for the pairs of keys alone where given: items of
    other pairs go before the join by case."""
    drugs, events = t.case_drug.select("primaryid", "drug"), t.case_reaction
    if keys is not None:
        drugs = drugs.join(keys.select("drug").distinct(), "drug", "left_semi")
        events = events.join(keys.select("event").distinct(), "event", "left_semi")
    both = drugs.join(events, "primaryid").join(t.latest.select("primaryid", F.col("faers_quarter").alias("quarter")), "primaryid")
    if keys is not None:
        both = both.join(keys, ["drug", "event"], "left_semi")
    return both.filter("quarter is not null").groupBy("drug", "event", "quarter").agg(F.count("*").alias("report_count"))


def dense_series(trend: DataFrame, quarters: DataFrame) -> DataFrame:
    """Every pair in every quarter of the calendar (a column of quarters, a few hundred rows
    at most), missing counts as 0."""
    keys = trend.select("drug", "event").distinct()
    grid = keys.crossJoin(F.broadcast(quarters.select("quarter").distinct()))
    return grid.join(trend, ["drug", "event", "quarter"], "left").select("drug", "event", "quarter", F.coalesce("report_count", F.lit(0)).cast("long").alias("report_count"))


def baseline(series: DataFrame, quarters: int = 4) -> DataFrame:
    """Each quarter's count with the mean and deviation of the quarters before it, and their
    array, oldest first."""
    w = Window.partitionBy("drug", "event").orderBy("quarter").rowsBetween(-quarters, -1)
    n = F.count("report_count").over(w)
    std = F.when(n > 1, F.stddev_samp("report_count").over(w)).when(n == 1, 0.0)
    return series.select("*", F.avg("report_count").over(w).alias("baseline_mean"), std.alias("baseline_std"), F.collect_list("report_count").over(w).alias("baseline"))


def anomalies(t: DataFrame) -> DataFrame:
    """percent_change, anomaly_score, poisson_anomaly_score and ewma of a baseline table;
    null where there is no baseline to compare with."""
    mean, std, now = F.col("baseline_mean"), F.col("baseline_std"), F.col("report_count").cast("double")
    return t.select(
        "*",
        F.try_divide(now - mean, mean).alias("percent_change"),
        F.try_divide(now - mean, F.when(std > 0, std)).alias("anomaly_score"),
        F.when(mean > 0, stats.poisson_tail(F.col("report_count"), mean)).alias("poisson_anomaly_score"),
        F.when(F.size("baseline") > 0, stats.ewma(F.col("baseline"))).alias("ewma"),
    )


def priority(d: Column, t: Column, s: Column, lit: Column, p: Column, w: Weights = Weights()) -> Column:
    parts = zip((d, t, s, lit, p), (w.disproportionality, w.trend_anomaly, w.seriousness, w.literature_support, w.population_context))
    first, *rest = [weight * stats.clip01(x) for x, weight in parts]
    for x in rest:
        first = first + x
    return first


def priority_level(score: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(score >= t.high_priority, "High").when(score >= t.moderate_priority, "Moderate").otherwise("Low")


def emerging_signals(trend: DataFrame, scores: DataFrame, top_k: int = 200, thresholds: Thresholds = Thresholds(), weights: Weights = Weights(), quarters: DataFrame | None = None) -> DataFrame:
    """The top pairs with their last quarter against the quarters before, by priority.

    The calendar is the quarters given, or else those of the trend; with fewer than two
    quarters there is nothing to compare and no row.
    """
    calendar = (quarters if quarters is not None else trend).select("quarter").filter("quarter is not null").distinct()
    edge = calendar.agg(F.max("quarter").alias("last"), F.count("*").alias("n_quarters"))
    keys = top_pairs(scores, top_k)
    series = dense_series(trend.join(F.broadcast(keys), ["drug", "event"], "left_semi"), calendar)  # keys: top_k rows
    now = anomalies(baseline(series, thresholds.baseline_quarters)).crossJoin(F.broadcast(edge)).filter("quarter = last and n_quarters >= 2")
    s = scores.select(F.col("drug_name_normalized").alias("drug"), F.col("adverse_event").alias("event"), "drug_class", "bayesian_shrunken_score", "seriousness_rate", *(F.col(c) if c in scores.columns else F.lit(None).cast("double").alias(c) for c in ("ebgm", "eb05")))
    t = now.join(s, ["drug", "event"])
    score = priority(F.col("bayesian_shrunken_score") / 3, F.col("anomaly_score") / 3, F.col("seriousness_rate"), F.lit(0.0), F.lit(0.0), weights)
    return t.select(
        F.col("drug").alias("drug_name_normalized"),
        "drug_class",
        F.col("event").alias("adverse_event"),
        F.col("quarter").alias("current_quarter"),
        F.col("report_count").alias("current_count"),
        F.col("baseline_mean").alias("trailing_baseline_count"),
        "percent_change",
        "anomaly_score",
        "poisson_anomaly_score",
        "ebgm",
        "eb05",
        "seriousness_rate",
        F.lit(0).cast("long").alias("literature_support_count"),
        F.lit(False).alias("nhanes_context_available"),
        F.round(score, 4).alias("priority_score"),
        priority_level(score, thresholds).alias("priority_level"),
    ).orderBy(F.desc("priority_score"), "drug_name_normalized", "adverse_event")
