"""Case tables drawn from an order schema, on which the operators can be tried.

An order is a report and a case; brands of its parts are items, suppliers' nations events,
return flags roles, urgent orders serious outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.config import Thresholds
from caselens.functions import dates
from caselens.operators import cases, pairs
from caselens.session import once

ROLES = {"A": "PS", "R": "SS", "N": "C"}
SERIOUS = ("1-URGENT", "2-HIGH")
#: Limits that some pairs of random data pass.
LOOSE = Thresholds(prr=1.0, chi_square=1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str, case: str = "o_orderkey") -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("primaryid"), F.col(case).cast("string").alias("caseid"), F.col("o_orderdate").alias("fda_date"), dates.quarter_label(F.col("o_orderdate")).alias("faers_quarter"))


def drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    t = li.select("l_orderkey", "l_partkey", "l_returnflag").join(p.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return t.select(F.col("l_orderkey").cast("string").alias("primaryid"), F.col("p_brand").alias("drug_name_raw"), F.col("p_brand").alias("drug_name_normalized"), F.col("p_type").alias("drug_class"), F.try_element_at(role, F.col("l_returnflag")).alias("role_code"))


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s, n = (table(spark, sf_dir, x) for x in ("lineitem", "supplier", "nation"))
    where = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")  # 25 nations
    t = li.select("l_orderkey", "l_suppkey").join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    return t.select(F.col("l_orderkey").cast("string").alias("primaryid"), F.col("n_name").alias("reaction_term"), F.col("n_name").alias("reaction_term_normalized"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin(*SERIOUS))
    return o.select(F.col("o_orderkey").cast("string").alias("primaryid"), F.lit("HO").alias("outcome_code"))


def deleted_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("caseid"))


def silver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"reports": reports(spark, sf_dir), "drugs": drugs(spark, sf_dir), "reactions": reactions(spark, sf_dir), "outcomes": outcomes(spark, sf_dir)}


#: The tables that the matrix is made from.
INPUTS = ("orders", "lineitem", "part", "supplier", "nation")


def cases_of(spark: SparkSession, sf_dir: str, **more) -> cases.CaseTables:
    """Case tables as plans; those without options read the kept ones."""
    if more:
        return cases.case_tables(silver(spark, sf_dir), **more)
    kept = lambda name, t: once(spark, name, tuple(f"{sf_dir}/{x}.parquet" for x in INPUTS), t)
    s = silver(spark, sf_dir)
    latest = kept("latest", lambda: cases.case_tables(s).latest)
    drugs = kept("case_drug", lambda: cases.case_drugs(s["drugs"], latest))
    reactions = kept("case_reaction", lambda: cases.case_reactions(s["reactions"], latest))
    return cases.CaseTables(latest, drugs, reactions, cases.serious_cases(s["outcomes"], latest))


def scores(spark: SparkSession, sf_dir: str, thresholds: Thresholds = LOOSE, ebgm: bool = False) -> DataFrame:
    """The matrix as a mart: written by the first query of an application that needs it."""
    t = once(spark, f"matrix-{abs(hash(thresholds))}", tuple(f"{sf_dir}/{x}.parquet" for x in INPUTS), lambda: pairs.score_pairs(pairs.pair_table(cases_of(spark, sf_dir)), thresholds, ebgm=False))
    return pairs.with_ebgm(t) if ebgm else t


def rounded(t: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines which add in another order agree; no negative zero."""
    return t.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in t.dtypes))


def r6(x: Column) -> Column:
    return F.round(x, 6) + F.lit(0.0)
