"""Case tables: the latest version of every case, and its distinct items and events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.config import SUSPECT_ROLES
from caselens.session import stored


@dataclass(frozen=True)
class CaseTables:
    latest: DataFrame  # primaryid, caseid, fda_date, faers_quarter
    case_drug: DataFrame  # primaryid, drug, drug_class
    case_reaction: DataFrame  # primaryid, event
    serious: DataFrame  # primaryid


def latest_cases(reports: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The last version of each case that is not deleted: by date, version and id, nulls last.
    Ids compare as strings. Deleted cases go before anything is shuffled by case, and each
    task keeps one version of a case before the shuffle. Rows without a case id are one case."""
    t = reports.withColumn("primaryid", F.col("primaryid").cast("string")).withColumn("caseid", F.col("caseid").cast("string"))
    if deleted is not None:
        t = t.join(deleted.select(F.col("caseid").cast("string").alias("caseid")).filter("caseid is not null").distinct(), "caseid", "left_anti")
    version = F.expr("try_cast(case_version as int)") if "case_version" in t.columns else F.lit(None).cast("int")
    order = F.struct(F.col("fda_date"), version.alias("v"), F.col("primaryid"))  # nulls of a struct's fields compare lowest
    last = t.groupBy("caseid").agg(F.max_by(F.struct(*(c for c in t.columns if c != "caseid")), order).alias("_last"))
    return last.select(*(F.col(c) if c == "caseid" else F.col(f"_last.`{c}`").alias(c) for c in t.columns))


def analysis_key(normalized: Column, raw: Column) -> Column:
    """The normalized name unless it is blank, else the raw one."""
    return F.coalesce(F.when(F.trim(normalized) != "", normalized), raw)


def case_drugs(drugs: DataFrame, latest: DataFrame, roles: tuple[str, ...] | None = SUSPECT_ROLES, dimension: DataFrame | None = None) -> DataFrame:
    """(primaryid, drug, drug_class), each pair once, the smallest class of a pair.

    With a dimension names become its analysis keys, after a first dedup, and pairs are
    deduplicated again.
    """
    t = drugs.filter(F.upper("role_code").isin(*roles)) if roles else drugs
    t = t.select(F.col("primaryid").cast("string").alias("primaryid"), analysis_key(F.col("drug_name_normalized"), F.col("drug_name_raw")).alias("drug"), F.col("drug_class").cast("string").alias("drug_class")).filter("drug is not null")
    t = t.join(latest.select("primaryid"), "primaryid").groupBy("primaryid", "drug").agg(F.min("drug_class").alias("drug_class"))
    if dimension is None:
        return t
    d = dimension.select(F.col("drug_name_normalized").alias("name"), "analysis_key", "drug_class_atc")
    t = t.join(d, t["drug"] == d["name"], "left")
    t = t.select("primaryid", F.coalesce("analysis_key", "drug").alias("drug"), F.coalesce("drug_class", "drug_class_atc").alias("drug_class"))
    return t.groupBy("primaryid", "drug").agg(F.min("drug_class").alias("drug_class"))


def case_reactions(reactions: DataFrame, latest: DataFrame) -> DataFrame:
    """(primaryid, event), each pair once."""
    t = reactions.select(F.col("primaryid").cast("string").alias("primaryid"), analysis_key(F.col("reaction_term_normalized"), F.col("reaction_term")).alias("event")).filter("event is not null")
    return t.join(latest.select("primaryid"), "primaryid").distinct()


def serious_cases(outcomes: DataFrame | None, latest: DataFrame) -> DataFrame:
    """Ids of cases with any outcome; none where there is no table of outcomes."""
    if outcomes is None:
        return latest.select("primaryid").limit(0)
    return outcomes.select(F.col("primaryid").cast("string").alias("primaryid")).distinct()


def case_tables(silver: dict[str, DataFrame], roles: tuple[str, ...] | None = SUSPECT_ROLES, dimension: DataFrame | None = None, keep: bool = False) -> CaseTables:
    """keep: the tables are written and read again, for plans that use them more than once."""
    hold = stored if keep else lambda t, name: t
    latest = hold(latest_cases(silver["reports"], silver.get("deleted_cases")).select("primaryid", "caseid", "fda_date", "faers_quarter"), "latest")
    drugs, reactions = case_drugs(silver["drugs"], latest, roles, dimension), case_reactions(silver["reactions"], latest)
    return CaseTables(latest, hold(drugs, "case_drug"), hold(reactions, "case_reaction"), serious_cases(silver.get("outcomes"), latest))
