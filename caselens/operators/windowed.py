"""The matrix of a few listed items within a window of days, each item by all its spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselens.config import CURATED, Domain, Thresholds
from caselens.functions import clauses
from caselens.operators import cases, pairs


def windowed_scores(silver: dict[str, DataFrame], start: str, end: str, domain: Domain = CURATED, top_events: int = 100, roles=None, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Scores of each listed item with its most reported events among cases of the window,
    with the window's days. Spellings become the canonical name before pairs are counted, so a
    case that names an item twice counts once; totals of events are over all cases."""
    reports = silver["reports"].filter(clauses.within(F.to_date("fda_date"), start, end))
    t = cases.case_tables(silver | {"reports": reports}, roles)
    names = silver["drugs"].sparkSession.createDataFrame([(a, n, c) for n, (c, more) in domain.names.items() for a in {n.upper(), *(m.upper() for m in more)}], "alias string, canonical string, cls string")
    drugs = t.case_drug.join(F.broadcast(names), F.upper("drug") == F.col("alias")).select("primaryid", F.col("canonical").alias("drug"), F.col("cls").alias("drug_class")).distinct()  # the dictionary is fixed
    t = cases.CaseTables(t.latest, drugs, t.case_reaction, t.serious)
    rank = F.row_number().over(Window.partitionBy("drug").orderBy(F.desc("a"), "event"))
    top = pairs.pair_table(t).withColumn("rank", rank).filter(F.col("rank") <= top_events).drop("rank")
    return pairs.score_pairs(top, thresholds, ebgm=False).withColumns({"scoring_window_start": F.lit(start).cast("date"), "scoring_window_end": F.lit(end).cast("date")})


def event_counts(scores: DataFrame) -> DataFrame:
    """The counts alone, under the names of the count mart."""
    return scores.select("drug_name_normalized", "drug_class", "adverse_event", "scoring_window_start", "scoring_window_end", F.col("a_drug_event").alias("report_count"), "serious_count", F.col("a_drug_event").alias("distinct_case_count"))


def term_counts(t: cases.CaseTables, names: list[str], most: int = 100) -> DataFrame:
    """(event, reports): the most reported events among cases that name an item by any of the
    names, ties by name."""
    some = t.case_drug.filter(clauses.is_one_of(F.col("drug"), names)).select("primaryid").distinct()
    return t.case_reaction.join(some, "primaryid", "left_semi").groupBy("event").agg(F.count("*").alias("reports")).orderBy(F.desc("reports"), "event").limit(most)
