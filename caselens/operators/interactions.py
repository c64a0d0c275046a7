"""Signals of pairs of items reported together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselens.functions import stats
from caselens.operators.cases import CaseTables


def item_pairs(case_drug: DataFrame) -> DataFrame:
    """(primaryid, drug_a, drug_b), drug_a < drug_b: a case's own unordered pairs."""
    items = F.sort_array(F.collect_set("drug"))  # a case's items: few
    t = case_drug.groupBy("primaryid").agg(items.alias("items")).filter(F.size("items") > 1)
    return t.select("primaryid", F.explode(F.flatten(F.transform("items", lambda x: F.transform(F.filter("items", lambda y: y > x), lambda y: F.struct(x.alias("drug_a"), y.alias("drug_b")))))).alias("p")).select("primaryid", "p.*")


def co_reported(case_drug: DataFrame) -> DataFrame:
    """(drug, co_drug, co_reports): how often items stand in the same cases, both ways."""
    n = item_pairs(case_drug).groupBy("drug_a", "drug_b").agg(F.count("*").alias("co_reports"))
    one = n.select(F.col("drug_a").alias("drug"), F.col("drug_b").alias("co_drug"), "co_reports")
    return one.unionByName(n.select(F.col("drug_b").alias("drug"), F.col("drug_a").alias("co_drug"), "co_reports"))


def interaction_signals(t: CaseTables, scores: DataFrame, least_together: int = 50, top_events: int = 50, least_reports: int = 5, multiple: float = 2.0) -> DataFrame:
    """Each pair of items with each of its most reported events, against the larger of the
    known single odds ratios. A pair's events, and its single ratios, are joins; scores may
    hold no row for a single pair, which then has no ratio."""
    pairs = item_pairs(t.case_drug)
    together = pairs.groupBy("drug_a", "drug_b").agg(F.count("*").alias("co_reports")).filter(F.col("co_reports") >= least_together)
    pairs = pairs.join(together.select("drug_a", "drug_b"), ["drug_a", "drug_b"], "left_semi")
    a = pairs.join(t.case_reaction, "primaryid").groupBy("drug_a", "drug_b", "event").agg(F.count("*").alias("a"))
    rank = F.row_number().over(Window.partitionBy("drug_a", "drug_b").orderBy(F.desc("a"), "event"))
    a = a.withColumn("rank", rank).filter(F.col("rank") <= top_events).filter(F.col("a") >= least_reports).drop("rank")
    event_total = t.case_reaction.groupBy("event").agg(F.count("*").alias("event_total"))
    n = t.latest.agg(F.count("*").alias("n"))
    both = a.join(together, ["drug_a", "drug_b"]).join(event_total, "event").crossJoin(F.broadcast(n))
    c = stats.cells(F.col("a"), F.col("co_reports"), F.col("event_total"), F.col("n"))
    both = both.withColumns({k: v for k, v in c.items() if k != "a"})
    single = scores.select(F.col("drug_name_normalized").alias("d"), F.col("adverse_event").alias("e"), F.col("ror").alias("r"))
    for side in ("a", "b"):
        s = single.select(F.col("d").alias(f"drug_{side}"), F.col("e").alias("event"), F.col("r").alias(f"ror_drug_{side}"))
        both = both.join(s, [f"drug_{side}", "event"], "left")
    abcd = tuple(F.col(k) for k in "abcd")
    low, high = stats.ror_interval(*abcd)
    both = both.withColumns({"ror_combination": stats.ror(*abcd), "ror_ci_lower": low, "ror_ci_upper": high, "prr_combination": stats.prr(*abcd), "chi_square": stats.chi_square_yates(*abcd), "single_max_ror": F.greatest("ror_drug_a", "ror_drug_b")})
    known = F.col("ror_drug_a").isNotNull() | F.col("ror_drug_b").isNotNull()
    ratio = F.try_divide("ror_combination", "single_max_ror")
    flag = F.coalesce(known & (F.col("ror_ci_lower") > 1) & (ratio >= multiple), F.lit(False))
    return both.select("drug_a", "drug_b", F.col("event").alias("adverse_event"), "co_reports", F.col("a").alias("pair_event_reports"), "ror_combination", "ror_ci_lower", "ror_ci_upper", "prr_combination", "chi_square", "ror_drug_a", "ror_drug_b", "single_max_ror", ratio.alias("interaction_ratio"), known.alias("comparable"), flag.alias("interaction_flag"))
