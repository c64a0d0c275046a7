"""Every query of the analytics engine by name, over the order schema, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.config import Domain
from caselens.functions import bayes, dates, stats, text
from caselens.operators import cases, dimension, enrich, interactions, labels, literature, marts, pairs, subgroups, survey, trend, windowed
from caselens.plans import domain, serving
from caselens.plans.domain import LOOSE, r6, rounded, table
from caselens.session import shared_dir, stored
from caselens.sources import bronze, demo, lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DRUG, EVENT = "drug_name_normalized", "adverse_event"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- SQL that the oracles share ----------------------------------------------------------------

CASES = """
cd AS (SELECT l_orderkey::VARCHAR AS pid, p_brand AS drug, min(p_type) AS cls
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
       WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
cr AS (SELECT DISTINCT l_orderkey::VARCHAR AS pid, n_name AS event
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
ser AS (SELECT DISTINCT o_orderkey::VARCHAR AS pid FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
nn AS (SELECT count(*) AS n FROM orders),
dm AS (SELECT drug, count(*) AS dt, min(cls) AS cls FROM cd GROUP BY 1),
em AS (SELECT event, count(*) AS et FROM cr GROUP BY 1),
pc AS (SELECT drug, event, count(*) AS a, count(ser.pid) AS sa
       FROM cd JOIN cr ON cd.pid = cr.pid LEFT JOIN ser ON ser.pid = cd.pid GROUP BY 1, 2)"""


def cells_sql(source: str, name: str = "st", extra: str = "") -> str:
    """Statistics of (drug, event, a, dt, et, n, ...) in the CTE named."""
    return f"""
{name}0 AS (SELECT *, greatest(dt - a, 0) AS b, greatest(et - a, 0) AS c,
            greatest(n - a - greatest(dt - a, 0) - greatest(et - a, 0), 0) AS d FROM {source}),
{name}1 AS (SELECT *, least(a, b, c, d) = 0 AS z, CASE WHEN least(a, b, c, d) = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS k,
            a::DOUBLE AS ra, b::DOUBLE AS rb, c::DOUBLE AS rc, d::DOUBLE AS rd FROM {name}0),
{name}2 AS (SELECT *, ra + k AS ka, rb + k AS kb, rc + k AS kc, rd + k AS kd, ra + rb + rc + rd AS rn,
            (ra + rb) * (rc + rd) * (ra + rc) * (rb + rd) AS margins FROM {name}1),
{name} AS (SELECT *, (ka * kd) / (kb * kc) AS ror,
           exp(ln((ka * kd) / (kb * kc)) - 1.959963984540054::DOUBLE * sqrt(1 / ka + 1 / kb + 1 / kc + 1 / kd)) AS lo,
           exp(ln((ka * kd) / (kb * kc)) + 1.959963984540054::DOUBLE * sqrt(1 / ka + 1 / kb + 1 / kc + 1 / kd)) AS hi,
           (ka / (ka + kb)) / (kc / (kc + kd)) AS prr,
           CASE WHEN margins = 0 THEN 0 ELSE rn * pow(abs(ra * rd - rb * rc) - rn / 2, 2) / margins END AS chi2,
           CASE WHEN rn = 0 THEN 0 ELSE (ra + rb) * (ra + rc) / rn END AS ex{extra} FROM {name}2)"""


MATRIX = (
    CASES
    + ",\ntot AS (SELECT pc.*, dt, dm.cls, et, n FROM pc JOIN dm ON pc.drug = dm.drug JOIN em ON pc.event = em.event, nn),"
    + cells_sql("tot")
    + """,
scored AS (SELECT drug AS drug_name_normalized, cls AS drug_class, event AS adverse_event, a::BIGINT AS a_drug_event, b::BIGINT AS b_drug_other_events,
  c::BIGINT AS c_other_drugs_event, d::BIGINT AS d_other_drugs_other_events, prr, ror, lo AS ror_ci_lower, hi AS ror_ci_upper, chi2 AS chi_square, ex AS expected_count,
  CASE WHEN ex > 0 AND ra > 0 THEN ra / (ra + 0.5::DOUBLE) * ln(ra / ex) ELSE 0 END AS bayesian_shrunken_score,
  sa::BIGINT AS serious_count, least(1::DOUBLE, sa::DOUBLE / a) AS seriousness_rate, a < 3 AS min_count_flag, z AS continuity_correction,
  a >= 3 AND lo > 1 AND prr >= 1 AND chi2 >= 1 AS disproportionality_flag FROM st)"""
)

SIGNAL_COLUMNS = """drug_name_normalized, drug_class, adverse_event, a_drug_event, b_drug_other_events, c_other_drugs_event, d_other_drugs_other_events,
  round(prr, 6) AS prr, round(ror, 6) AS ror, round(ror_ci_lower, 6) AS ror_ci_lower, round(ror_ci_upper, 6) AS ror_ci_upper, round(chi_square, 6) AS chi_square,
  round(expected_count, 6) AS expected_count, round(bayesian_shrunken_score, 6) + 0.0::DOUBLE AS bayesian_shrunken_score, serious_count, round(seriousness_rate, 6) AS seriousness_rate,
  min_count_flag, continuity_correction, disproportionality_flag"""

# -- the matrix ----------------------------------------------------------------------------------


@query(f"WITH {MATRIX} SELECT {SIGNAL_COLUMNS} FROM scored")
def signal_matrix(spark, d):
    return rounded(domain.scores(spark, d)).orderBy(F.desc("ror"), DRUG, EVENT)


@query("""SELECT caseid, primaryid, faers_quarter FROM (
  SELECT o_custkey::VARCHAR AS caseid, o_orderkey::VARCHAR AS primaryid, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS faers_quarter,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey::VARCHAR DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_case_dedup(spark, d):
    return cases.latest_cases(domain.reports(spark, d, "o_custkey")).select("caseid", "primaryid", "faers_quarter")


@query("""SELECT caseid, primaryid FROM (
  SELECT o_custkey::VARCHAR AS caseid, o_orderkey::VARCHAR AS primaryid,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey::VARCHAR DESC) AS rn
  FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)) WHERE rn = 1""")
def deleted_case_anti_join(spark, d):
    return cases.latest_cases(domain.reports(spark, d, "o_custkey"), domain.deleted_cases(spark, d)).select("caseid", "primaryid")


@query(f"WITH {CASES} SELECT pid AS primaryid, drug, cls AS drug_class FROM cd")
def case_drug_suspect_roles(spark, d):
    return domain.cases_of(spark, d).case_drug.select("primaryid", "drug", "drug_class")


@query(f"WITH {CASES} SELECT pid AS primaryid, event FROM cr")
def case_reaction_distinct(spark, d):
    return domain.cases_of(spark, d).case_reaction


@query(f"WITH {CASES} SELECT drug, dt::BIGINT AS drug_total, cls AS drug_class FROM dm")
def drug_marginals(spark, d):
    return pairs.drug_marginals(domain.cases_of(spark, d).case_drug)


@query(f"WITH {CASES} SELECT event, et::BIGINT AS event_total FROM em")
def event_marginals(spark, d):
    return pairs.event_marginals(domain.cases_of(spark, d).case_reaction)


@query(f"WITH {CASES} SELECT drug, event, a::BIGINT AS a FROM pc")
def pair_counts(spark, d):
    return pairs.pair_counts(domain.cases_of(spark, d)).select("drug", "event", "a")


@query(f"WITH {CASES} SELECT drug, event, a::BIGINT AS a, sa::BIGINT AS serious_a, n::BIGINT AS n FROM pc, nn")
def serious_pair_counts(spark, d):
    return pairs.pair_table(domain.cases_of(spark, d)).select("drug", "event", "a", "serious_a", "n")


def _stat(columns: str) -> str:
    return f"WITH {MATRIX} SELECT drug_name_normalized, adverse_event, {columns} FROM scored"


def _scores(spark, d, *columns):
    return rounded(domain.scores(spark, d).select(DRUG, EVENT, *columns))


@query(_stat("a_drug_event, b_drug_other_events, c_other_drugs_event, d_other_drugs_other_events, continuity_correction"))
def contingency_cells(spark, d):
    return _scores(spark, d, "a_drug_event", "b_drug_other_events", "c_other_drugs_event", "d_other_drugs_other_events", "continuity_correction")


@query(_stat("round(ror, 6) AS ror, round(ror_ci_lower, 6) AS ror_ci_lower, round(ror_ci_upper, 6) AS ror_ci_upper"))
def ror_ci(spark, d):
    return _scores(spark, d, "ror", "ror_ci_lower", "ror_ci_upper")


@query(_stat("round(prr, 6) AS prr"))
def prr(spark, d):
    return _scores(spark, d, "prr")


@query(_stat("round(chi_square, 6) AS chi_square"))
def chi_square_yates(spark, d):
    return _scores(spark, d, "chi_square")


@query(_stat("round(expected_count, 6) AS expected_count, round(a_drug_event / expected_count, 6) AS oe_ratio"))
def expected_oe(spark, d):
    return rounded(domain.scores(spark, d).select(DRUG, EVENT, "expected_count", stats.safe_ratio(F.col("a_drug_event"), F.col("expected_count")).alias("oe_ratio")))


@query(_stat("round(bayesian_shrunken_score, 6) + 0.0::DOUBLE AS bayesian_shrunken_score"))
def shrunken_score(spark, d):
    return _scores(spark, d, "bayesian_shrunken_score")


@query(_stat("min_count_flag, disproportionality_flag, round(seriousness_rate, 6) AS seriousness_rate"))
def signal_flags(spark, d):
    return _scores(spark, d, "min_count_flag", "disproportionality_flag", "seriousness_rate")


REKEYED = (
    CASES.replace("p_brand AS drug, min(p_type) AS cls", "regexp_replace(p_brand, '[0-9]$', '') AS drug, min(p_type) AS cls")
    + ",\ntot AS (SELECT pc.*, dt, dm.cls, et, n FROM pc JOIN dm ON pc.drug = dm.drug JOIN em ON pc.event = em.event, nn),"
    + cells_sql("tot")
)


@query(f"WITH {REKEYED} SELECT drug AS drug_name_normalized, event AS adverse_event, a::BIGINT AS a_drug_event, b::BIGINT AS b_drug_other_events, round(ror, 6) AS ror FROM st")
def rekeyed_matrix(spark, d):
    names = table(spark, d, "part").select(F.col("p_brand").alias(DRUG)).distinct()
    dim = names.select(DRUG, F.regexp_replace(DRUG, "[0-9]$", "").alias("analysis_key"), F.lit(None).cast("string").alias("drug_class_atc"))
    t = pairs.score_pairs(pairs.pair_table(domain.cases_of(spark, d, dimension=dim)), LOOSE, ebgm=False)
    return rounded(t.select(DRUG, EVENT, "a_drug_event", "b_drug_other_events", "ror"))


@query(_stat("""round(lgamma(2.0::DOUBLE + a_drug_event) - lgamma(2.0::DOUBLE) - lgamma(a_drug_event + 1.0::DOUBLE)
  + 2.0::DOUBLE * ln(4.0::DOUBLE / (4.0::DOUBLE + expected_count)) + a_drug_event * ln(expected_count / (4.0::DOUBLE + expected_count)), 6) AS log_pmf"""))
def nb_log_pmf(spark, d):
    return rounded(domain.scores(spark, d).select(DRUG, EVENT, bayes.log_pmf_column(F.col("a_drug_event"), F.col("expected_count"), 2.0, 4.0).alias("log_pmf")))


@query()
def ebgm_scores(spark, d):
    return rounded(domain.scores(spark, d, ebgm=True).select(DRUG, EVENT, "a_drug_event", "expected_count", "ebgm", "eb05", "eb95"), 4)


#: Mixture parameters for which the posterior can be checked. Fixed values of the checks.
THETA = (0.5, 0.8, 3.0, 2.0, 0.4)


def _digamma_sql(x: str) -> str:
    z = f"({x} + 10)"
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} * {z}) + 1 / (120 * pow({z}, 4)) - 1 / (252 * pow({z}, 6)) + 1 / (240 * pow({z}, 8)) - " + " - ".join(f"1 / ({x} + {i})" for i in range(10)) + ")"


def _below_sql(a: str, x: str) -> str:
    """The regularised lower incomplete gamma function by its power series."""
    return f"(CASE WHEN {x} <= 0 THEN 0 ELSE list_sum(list_transform(range(0, (2 * {x} + 8 * sqrt({x}) + 80)::BIGINT), lambda k: exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1.0::DOUBLE)))) END)"


def _posterior_sql() -> str:
    a1, b1, a2, b2, p = THETA
    log_pmf = lambda a, b: f"(lgamma({a}::DOUBLE + n) - lgamma({a}::DOUBLE) - lgamma(n + 1.0::DOUBLE) + {a}::DOUBLE * ln({b}::DOUBLE / ({b}::DOUBLE + e)) + n * ln(e / ({b}::DOUBLE + e)))"
    return f"""
po0 AS (SELECT drug_name_normalized AS d, adverse_event AS v, a_drug_event::DOUBLE AS n, greatest(expected_count, 1e-9::DOUBLE) AS e FROM scored),
po1 AS (SELECT *, ln({p}::DOUBLE) + {log_pmf(a1, b1)} AS f1, ln({1 - p}::DOUBLE) + {log_pmf(a2, b2)} AS f2 FROM po0),
po AS (SELECT d, v, n, e, 1 / (1 + exp(f2 - f1)) AS w, {a1}::DOUBLE + n AS g1, {b1}::DOUBLE + e AS h1, {a2}::DOUBLE + n AS g2, {b2}::DOUBLE + e AS h2 FROM po1)"""


_BELOW = f"(w * {_below_sql('g1', '(q * h1)')} + (1 - w) * {_below_sql('g2', '(q * h2)')})"


@query(f"""WITH {MATRIX}, {_posterior_sql()} SELECT d AS drug_name_normalized, v AS adverse_event, round(w, 6) AS weight,
  round(exp(w * ({_digamma_sql('g1')} - ln(h1)) + (1 - w) * ({_digamma_sql('g2')} - ln(h2))), 6) AS ebgm FROM po""")
def ebgm_fixed(spark, d):
    """The posterior's geometric mean under given parameters."""
    s = domain.scores(spark, d)
    return rounded(s.withColumn("x", bayes.score_columns(F.col("a_drug_event"), F.col("expected_count"), THETA)).select(DRUG, EVENT, F.col("x.weight").alias("weight"), F.col("x.ebgm").alias("ebgm")))


@query(f"""WITH RECURSIVE {MATRIX}, {_posterior_sql()},
lvl AS (SELECT * FROM (VALUES (0.05::DOUBLE), (0.95::DOUBLE)) t(level)),
step(d, v, level, w, g1, h1, g2, h2, low, high, q, i) AS (
  SELECT d, v, level, w, g1, h1, g2, h2, 0::DOUBLE, 10 * greatest(g1 / h1, g2 / h2) + 10, 5 * greatest(g1 / h1, g2 / h2) + 5, 0 FROM po, lvl
  UNION ALL
  SELECT d, v, level, w, g1, h1, g2, h2, low2, high2, (low2 + high2) / 2, i + 1 FROM (
    SELECT *, CASE WHEN b < level THEN q ELSE low END AS low2, CASE WHEN b < level THEN high ELSE q END AS high2 FROM (SELECT *, {_BELOW} AS b FROM step WHERE i < 34)))
SELECT d AS drug_name_normalized, v AS adverse_event, round(max(q) FILTER (level = 0.05), 4) AS eb05, round(max(q) FILTER (level = 0.95), 4) AS eb95 FROM step WHERE i = 34 GROUP BY 1, 2""")
def ebgm_quantiles(spark, d):
    """The posterior's quantiles under given parameters; SQL bisects the same equation."""
    s = domain.scores(spark, d)
    return rounded(s.withColumn("x", bayes.score_columns(F.col("a_drug_event"), F.col("expected_count"), THETA)).select(DRUG, EVENT, F.col("x.eb05").alias("eb05"), F.col("x.eb95").alias("eb95")), 4)


@query(f"""WITH {MATRIX}, {_posterior_sql()} SELECT d AS drug_name_normalized, v AS adverse_event, 1 AS one FROM po
  ORDER BY round(exp(w * ({_digamma_sql('g1')} - ln(h1)) + (1 - w) * ({_digamma_sql('g2')} - ln(h2))), 6) DESC, d, v LIMIT 200""")
def top_by_shrunken_ratio(spark, d):
    """The trend's top pairs where a Bayes column is there to choose by."""
    s = domain.scores(spark, d)
    s = s.withColumn("ebgm", F.round(bayes.score_columns(F.col("a_drug_event"), F.col("expected_count"), THETA)["ebgm"], 6))
    return trend.top_pairs(s, 200, "ebgm").select(F.col("drug").alias(DRUG), F.col("event").alias(EVENT), F.lit(1).alias("one"))


@query(f"""WITH {CASES} SELECT event, count(DISTINCT cr.pid)::BIGINT AS reports FROM cr JOIN (SELECT DISTINCT pid FROM cd WHERE drug IN ('Brand#11', 'Brand#22')) x ON x.pid = cr.pid GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def term_counts(spark, d):
    """The most reported events among the reports of an item by any of its spellings."""
    return windowed.term_counts(domain.cases_of(spark, d), ["BRAND#11", "brand#22"], 10)


# -- trend and priority ----------------------------------------------------------------------------

TOP = 200
TREND = (
    MATRIX
    + f""",
keys AS (SELECT drug_name_normalized AS drug, adverse_event AS event FROM scored ORDER BY ror DESC, drug_name_normalized, adverse_event LIMIT {TOP}),
qs AS (SELECT DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter FROM orders),
tr AS (SELECT cd.drug, cr.event, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS report_count
       FROM cd JOIN cr ON cd.pid = cr.pid JOIN orders ON o_orderkey::VARCHAR = cd.pid JOIN keys ON keys.drug = cd.drug AND keys.event = cr.event GROUP BY 1, 2, 3),
dense AS (SELECT k.drug, k.event, qs.quarter, coalesce(report_count, 0)::BIGINT AS report_count
          FROM keys k CROSS JOIN qs LEFT JOIN tr ON tr.drug = k.drug AND tr.event = k.event AND tr.quarter = qs.quarter),
base AS (SELECT *, avg(report_count) OVER w AS mean,
         CASE WHEN count(*) OVER w > 1 THEN stddev_samp(report_count) OVER w WHEN count(*) OVER w = 1 THEN 0::DOUBLE END AS std,
         list(report_count) OVER w AS prev
         FROM dense WINDOW w AS (PARTITION BY drug, event ORDER BY quarter ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
anom AS (SELECT *, CASE WHEN mean <> 0 THEN (report_count - mean) / mean END AS percent_change,
         CASE WHEN std > 0 THEN (report_count - mean) / std END AS z,
         CASE WHEN mean > 0 THEN CASE WHEN report_count <= 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, greatest(0::DOUBLE,
           1 - list_sum(list_transform(range(0, report_count), lambda i: exp(i * ln(mean) - lgamma(i + 1.0::DOUBLE) - mean))))) END END AS tail
         FROM base)"""
)


def _trend(spark, d):
    """The trend of the top pairs by odds ratio, in every quarter of the reports."""
    t, s = domain.cases_of(spark, d), domain.scores(spark, d)
    keys = trend.top_pairs(s, TOP)
    calendar = t.latest.select(F.col("faers_quarter").alias("quarter")).distinct()
    return trend.quarterly_trend(t, keys), s, calendar


@query(f"WITH {TREND} SELECT drug, event, quarter, report_count::BIGINT AS report_count FROM tr")
def quarterly_trend(spark, d):
    return _trend(spark, d)[0]


@query(f"""WITH {CASES} SELECT drug, event, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*)::BIGINT AS report_count
  FROM cd JOIN cr ON cd.pid = cr.pid JOIN orders ON o_orderkey::VARCHAR = cd.pid GROUP BY 1, 2, 3""")
def quarterly_trend_all_pairs(spark, d):
    return trend.quarterly_trend(domain.cases_of(spark, d))


@query(f"WITH {TREND} SELECT drug, event, quarter, report_count FROM dense")
def dense_series(spark, d):
    t, _, calendar = _trend(spark, d)
    return trend.dense_series(t, calendar)


def _anomalies(spark, d):
    t, _, calendar = _trend(spark, d)
    return trend.anomalies(trend.baseline(trend.dense_series(t, calendar)))


@query(f"""WITH {TREND} SELECT drug, event, quarter, report_count, round(mean, 6) AS baseline_mean, round(std, 6) AS baseline_std,
  round(percent_change, 6) + 0.0::DOUBLE AS percent_change, round(z, 6) + 0.0::DOUBLE AS anomaly_score FROM anom""")
def baseline_zscore(spark, d):
    return rounded(_anomalies(spark, d).select("drug", "event", "quarter", "report_count", "baseline_mean", "baseline_std", "percent_change", "anomaly_score"))


@query(f"""WITH {TREND} SELECT drug, event, quarter, round(CASE len(prev) WHEN 1 THEN prev[1] WHEN 2 THEN 0.5 * prev[2] + 0.5 * prev[1]
  WHEN 3 THEN 0.5 * prev[3] + 0.25 * prev[2] + 0.25 * prev[1] WHEN 4 THEN 0.5 * prev[4] + 0.25 * prev[3] + 0.125 * prev[2] + 0.125 * prev[1] END::DOUBLE, 6) AS ewma FROM base""")
def ewma(spark, d):
    return rounded(_anomalies(spark, d).select("drug", "event", "quarter", "ewma"))


@query(f"WITH {TREND} SELECT drug, event, quarter, report_count, round(tail, 6) AS poisson_anomaly_score FROM anom")
def poisson_tail(spark, d):
    return rounded(_anomalies(spark, d).select("drug", "event", "quarter", "report_count", "poisson_anomaly_score"))


EMERGING = (
    TREND
    + """,
clipped AS (SELECT s.*, a.quarter AS current_quarter, a.report_count AS current_count, a.mean, a.percent_change, a.z, a.tail,
    least(1::DOUBLE, greatest(0::DOUBLE, bayesian_shrunken_score / 3)) AS dc, least(1::DOUBLE, greatest(0::DOUBLE, coalesce(z / 3, 0))) AS tc, seriousness_rate AS sc
  FROM anom a JOIN scored s ON s.drug_name_normalized = a.drug AND s.adverse_event = a.event WHERE a.quarter = (SELECT max(quarter) FROM qs)),
emerging AS (SELECT *, 0.30::DOUBLE * dc + 0.25::DOUBLE * tc + 0.20::DOUBLE * sc AS score FROM clipped)"""
)


def _emerging(spark, d):
    t, s, calendar = _trend(spark, d)
    return trend.emerging_signals(t, s, TOP, LOOSE, quarters=calendar), s


@query(f"""WITH {EMERGING} SELECT drug_name_normalized, drug_class, adverse_event, current_quarter, current_count, round(mean, 6) AS trailing_baseline_count,
  round(percent_change, 6) + 0.0::DOUBLE AS percent_change, round(z, 6) + 0.0::DOUBLE AS anomaly_score, round(tail, 6) AS poisson_anomaly_score, round(seriousness_rate, 6) AS seriousness_rate,
  round(score, 4) AS priority_score FROM emerging""")
def emerging_signals(spark, d):
    return rounded(_emerging(spark, d)[0].select(DRUG, "drug_class", EVENT, "current_quarter", "current_count", "trailing_baseline_count", "percent_change", "anomaly_score", "poisson_anomaly_score", "seriousness_rate", "priority_score"))


@query(f"""WITH {EMERGING}, x AS (SELECT *, round(score, 4) AS ps, CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Moderate' ELSE 'Low' END AS level FROM emerging)
  SELECT drug_name_normalized, adverse_event, ps AS priority_score, level AS priority_level FROM x WHERE level IN ('High', 'Low') AND coalesce(percent_change * 100, -999) >= -20""")
def emerging_filtered(spark, d):
    """Emerging signals of some levels whose change is at least so many percent."""
    return rounded(serving.emerging(_emerging(spark, d)[0], ["high", "LOW"], least_change=-20.0).select(DRUG, EVENT, "priority_score", "priority_level"))


@query(f"""WITH {EMERGING}, x AS (SELECT *, round(score, 4) AS ps FROM emerging)
  SELECT count(*)::BIGINT AS signals, count(*) FILTER (score >= 0.75)::BIGINT AS high, arg_max(drug_name_normalized || ' — ' || adverse_event, (coalesce(percent_change, -1e9::DOUBLE), drug_name_normalized, adverse_event)) AS top_mover, round(max(percent_change), 6) AS top_change FROM x""")
def emerging_headline(spark, d):
    return rounded(marts.emerging_headline(_emerging(spark, d)[0]))


@query(f"""WITH {MATRIX}, p AS (SELECT *, 0.30::DOUBLE * least(1::DOUBLE, greatest(0::DOUBLE, bayesian_shrunken_score / 3)) + 0.25::DOUBLE * least(1::DOUBLE, greatest(0::DOUBLE, ror - 0.5))
    + 0.20::DOUBLE * seriousness_rate + 0.15::DOUBLE + 0.10::DOUBLE * 0.6::DOUBLE AS score FROM scored)
  SELECT drug_name_normalized, adverse_event, round(score, 6) AS priority_score, CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Moderate' ELSE 'Low' END AS priority_level FROM p""")
def priority_scores(spark, d):
    s = domain.scores(spark, d)
    p = trend.priority(F.col("bayesian_shrunken_score") / 3, F.col("ror") - 0.5, F.col("seriousness_rate"), F.lit(1.0), F.lit(0.6))
    return s.select(DRUG, EVENT, r6(p).alias("priority_score"), trend.priority_level(p).alias("priority_level"))


@query(f"""WITH {EMERGING},
lit AS (SELECT drug_name_normalized AS d, adverse_event AS e, a_drug_event AS n, round(seriousness_rate, 3) AS s FROM scored WHERE disproportionality_flag),
med AS (SELECT upper(p_brand) AS m, count(*) AS users FROM part WHERE p_size < 20 GROUP BY 1),
cls AS (SELECT DISTINCT upper(p_type) AS c FROM part WHERE p_size < 20),
j AS (SELECT e.*, coalesce(n, 0)::BIGINT AS ln, coalesce(s, 0)::DOUBLE AS ls,
      CASE WHEN users >= 30 THEN 1.0::DOUBLE WHEN users IS NOT NULL THEN 0.6::DOUBLE WHEN c IS NOT NULL THEN 0.4::DOUBLE ELSE 0::DOUBLE END AS pc
      FROM emerging e LEFT JOIN lit ON d = drug_name_normalized AND lit.e = adverse_event LEFT JOIN med ON m = upper(drug_name_normalized) LEFT JOIN cls ON c = upper(drug_class)),
p AS (SELECT *, 0.30::DOUBLE * dc + 0.25::DOUBLE * tc + 0.20::DOUBLE * sc + 0.15::DOUBLE * ls + 0.10::DOUBLE * pc AS total FROM j)
SELECT drug_name_normalized, adverse_event, ln AS literature_support_count, ls AS literature_support_score, pc AS population_component, pc > 0 AS nhanes_context_available,
  round(total, 4) AS priority_score, CASE WHEN total >= 0.75 THEN 'High' WHEN total >= 0.5 THEN 'Moderate' ELSE 'Low' END AS priority_level FROM p""")
def enriched_priority(spark, d):
    e, s = _emerging(spark, d)
    support = s.filter("disproportionality_flag").select(DRUG, EVENT, F.col("a_drug_event").alias("literature_support_count"), F.round("seriousness_rate", 3).alias("literature_support_score"))
    people = table(spark, d, "part").filter("p_size < 20").groupBy(F.col("p_brand").alias("medication_name_normalized")).agg(F.count("*").alias("unweighted_sample_count"))
    people = people.withColumn("drug_class", F.lit(None).cast("string")).unionByName(table(spark, d, "part").filter("p_size < 20").select(F.lit(None).cast("string").alias("medication_name_normalized"), F.lit(0).cast("long").alias("unweighted_sample_count"), F.col("p_type").alias("drug_class")).distinct())
    t = enrich.enrich(enrich.enrich(e, s, support, people), s, support, people)  # twice: the second changes nothing
    return rounded(t.select(DRUG, EVENT, "literature_support_count", "literature_support_score", "population_component", "nhanes_context_available", "priority_score", "priority_level"))


# -- strata and interactions -------------------------------------------------------------------------

SUBGROUPS = (
    MATRIX
    + """,
bs AS (SELECT drug_name_normalized AS drug, adverse_event AS event, ror AS overall FROM scored WHERE disproportionality_flag AND a_drug_event >= 20
       ORDER BY a_drug_event DESC, drug_name_normalized, adverse_event LIMIT 30),
sg AS (SELECT o_orderkey::VARCHAR AS pid, 'segment' AS ty, c_mktsegment AS sub FROM orders JOIN customer ON c_custkey = o_custkey
       UNION ALL
       SELECT o_orderkey::VARCHAR, 'balance', CASE WHEN c_acctbal BETWEEN -1000 AND 2000 THEN 'low' WHEN c_acctbal BETWEEN 2001 AND 6000 THEN 'middle' ELSE 'high' END
       FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal BETWEEN -1000 AND 2000 OR c_acctbal BETWEEN 2001 AND 6000 OR c_acctbal BETWEEN 6001 AND 100000),
sp AS (SELECT ty, sub, count(*) AS n FROM sg GROUP BY 1, 2),
sd AS (SELECT ty, sub, drug, count(*) AS dt FROM cd JOIN sg ON cd.pid = sg.pid GROUP BY 1, 2, 3),
se AS (SELECT ty, sub, event, count(*) AS et FROM cr JOIN sg ON cr.pid = sg.pid GROUP BY 1, 2, 3),
sa AS (SELECT ty, sub, bs.drug, bs.event, overall, count(*) AS a FROM cd JOIN cr ON cd.pid = cr.pid JOIN sg ON sg.pid = cd.pid JOIN bs ON bs.drug = cd.drug AND bs.event = cr.event GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 3),
sj AS (SELECT sa.*, n, dt, et FROM sa JOIN sp ON sp.ty = sa.ty AND sp.sub = sa.sub JOIN sd ON sd.ty = sa.ty AND sd.sub = sa.sub AND sd.drug = sa.drug JOIN se ON se.ty = sa.ty AND se.sub = sa.sub AND se.event = sa.event),"""
    + cells_sql("sj", "sub_st")
)


def _subgroups(spark, d):
    t, s = domain.cases_of(spark, d), domain.scores(spark, d)
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    bands = [F.when(F.col("c_acctbal").between(low, high), F.struct(F.lit("balance").alias("subgroup_type"), F.lit(name).alias("subgroup"))) for name, low, high in (("low", -1000, 2000), ("middle", 2001, 6000), ("high", 6001, 100000))]
    each = F.filter(F.array(F.struct(F.lit("segment").alias("subgroup_type"), F.col("c_mktsegment").alias("subgroup")), *bands), lambda x: x.isNotNull())
    strata = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("primaryid"), F.explode(each).alias("s")).select("primaryid", "s.*")
    return subgroups.subgroup_signals(t, strata, subgroups.base_signals(s, 30, 20))


@query(f"""WITH {SUBGROUPS} SELECT drug AS drug_name_normalized, event AS adverse_event, ty AS subgroup_type, sub AS subgroup, a::BIGINT AS stratum_reports, n::BIGINT AS stratum_population,
  round(ror, 6) AS ror, round(lo, 6) AS ror_ci_lower, round(hi, 6) AS ror_ci_upper, round(prr, 6) AS prr, round(chi2, 6) AS chi_square, round(overall, 6) AS overall_ror FROM sub_st""")
def subgroup_signals(spark, d):
    return rounded(_subgroups(spark, d))


@query(f"""WITH {SUBGROUPS} SELECT drug AS drug_name_normalized, event AS adverse_event, ty AS subgroup_type, sub AS subgroup, round(ror / greatest(overall, 0.01), 6) AS concentration_ratio
  FROM sub_st ORDER BY ror / greatest(overall, 0.01) DESC, 1, 2, 3, 4 LIMIT 8""")
def subgroup_concentration(spark, d):
    return rounded(subgroups.concentration(_subgroups(spark, d)).select(DRUG, EVENT, "subgroup_type", "subgroup", "concentration_ratio"))


INTERACTIONS = (
    MATRIX
    + """,
ip AS (SELECT a.pid, a.drug AS da, b.drug AS db FROM cd a JOIN cd b ON a.pid = b.pid AND a.drug < b.drug),
it AS (SELECT da, db, count(*) AS dt FROM ip GROUP BY 1, 2),
ia AS (SELECT ip.da, ip.db, event, count(*) AS a FROM ip JOIN it ON it.da = ip.da AND it.db = ip.db JOIN cr ON cr.pid = ip.pid WHERE dt >= 5 GROUP BY 1, 2, 3),
ir AS (SELECT *, row_number() OVER (PARTITION BY da, db ORDER BY a DESC, event) AS rn FROM ia),
ij AS (SELECT ir.da, ir.db, ir.event, ir.a, dt, et, n, sx.ror AS ror_a, sy.ror AS ror_b FROM ir JOIN it ON it.da = ir.da AND it.db = ir.db JOIN em ON em.event = ir.event
       LEFT JOIN scored sx ON sx.drug_name_normalized = ir.da AND sx.adverse_event = ir.event LEFT JOIN scored sy ON sy.drug_name_normalized = ir.db AND sy.adverse_event = ir.event, nn
       WHERE rn <= 50 AND ir.a >= 2),"""
    + cells_sql("ij", "int_st")
)


@query(f"""WITH {INTERACTIONS} SELECT da AS drug_a, db AS drug_b, event AS adverse_event, dt::BIGINT AS co_reports, a::BIGINT AS pair_event_reports, round(ror, 6) AS ror_combination,
  round(lo, 6) AS ror_ci_lower, round(hi, 6) AS ror_ci_upper, round(prr, 6) AS prr_combination, round(chi2, 6) AS chi_square, round(ror_a, 6) AS ror_drug_a, round(ror_b, 6) AS ror_drug_b,
  round(greatest(ror_a, ror_b), 6) AS single_max_ror, round(ror / greatest(ror_a, ror_b), 6) AS interaction_ratio, ror_a IS NOT NULL OR ror_b IS NOT NULL AS comparable,
  coalesce(lo > 1 AND ror / greatest(ror_a, ror_b) >= 2, false) AS interaction_flag FROM int_st""")
def interaction_signals(spark, d):
    return rounded(interactions.interaction_signals(domain.cases_of(spark, d), domain.scores(spark, d), 5, 50, 2, 2.0))


@query(f"""WITH {CASES} SELECT a.drug, b.drug AS co_drug, count(*)::BIGINT AS co_reports FROM cd a JOIN cd b ON a.pid = b.pid AND a.drug <> b.drug GROUP BY 1, 2""")
def co_reported_items(spark, d):
    return interactions.co_reported(domain.cases_of(spark, d).case_drug)


# -- facets, sample, pages ---------------------------------------------------------------------------


@query(f"WITH {MATRIX} SELECT drug_name_normalized, min(drug_class) AS drug_class, max(a_drug_event + b_drug_other_events)::BIGINT AS report_count FROM scored GROUP BY 1")
def drug_facets(spark, d):
    return marts.drug_facets(domain.scores(spark, d))


@query(f"WITH {MATRIX} SELECT adverse_event, max(a_drug_event + c_other_drugs_event)::BIGINT AS report_count FROM scored GROUP BY 1")
def event_facets(spark, d):
    return marts.event_facets(domain.scores(spark, d))


@query(f"WITH {MATRIX} SELECT DISTINCT drug_class FROM scored WHERE drug_class IS NOT NULL")
def class_facets(spark, d):
    return marts.class_facets(domain.scores(spark, d))


@query(f"WITH {MATRIX} SELECT count(*)::BIGINT AS signal_total, count(*) FILTER (disproportionality_flag)::BIGINT AS flagged_total, count(*) FILTER (a_drug_event % 3 = 0)::BIGINT AS novel_total FROM scored")
def summary_stats(spark, d):
    return marts.summary_stats(domain.scores(spark, d).withColumn("novel_flag", F.when(F.col("a_drug_event") % 3 == 0, True)))


@query(f"WITH {MATRIX} SELECT drug_name_normalized, adverse_event, ntile(10) OVER (ORDER BY ror NULLS FIRST, drug_name_normalized, adverse_event)::INTEGER AS decile FROM scored")
def ror_deciles(spark, d):
    return marts.ror_deciles(domain.scores(spark, d)).select(DRUG, EVENT, "decile")


@query()
def stratified_sample(spark, d):
    return rounded(marts.scatter_sample(domain.scores(spark, d), 300).select(DRUG, EVENT, "ror"))


@query(f"WITH {MATRIX} SELECT drug_name_normalized, adverse_event, a_drug_event, round(ror, 6) AS ror FROM scored ORDER BY scored.ror DESC NULLS LAST, 1, 2 LIMIT 50 OFFSET 25")
def signals_page(spark, d):
    return rounded(serving.signals_page(domain.scores(spark, d), sort="ror", offset=25, limit=50)[1].select(DRUG, EVENT, "a_drug_event", "ror"))


@query(f"""WITH {MATRIX}, f AS (SELECT * FROM scored WHERE upper(drug_name_normalized) LIKE upper('%an%') OR upper(adverse_event) LIKE upper('%an%'))
  SELECT drug_name_normalized, adverse_event, a_drug_event, (SELECT count(*) FROM f)::BIGINT AS total FROM f ORDER BY a_drug_event ASC, 1, 2 LIMIT 100""")
def signals_search(spark, d):
    total, page = serving.signals_page(domain.scores(spark, d), q="an", sort="reports", desc=False)
    return page.select(DRUG, EVENT, "a_drug_event").crossJoin(F.broadcast(total))


@query(f"WITH {MATRIX} SELECT drug_name_normalized, adverse_event, a_drug_event, round(chi_square, 6) AS chi_square FROM scored WHERE disproportionality_flag AND a_drug_event >= 20 ORDER BY scored.chi_square DESC, 1, 2 LIMIT 1000")
def flagged_page(spark, d):
    return rounded(serving.signals_page(domain.scores(spark, d), flagged_only=True, min_reports=20, sort="chi_square", limit=5000)[1].select(DRUG, EVENT, "a_drug_event", "chi_square"))


def _kpis(key: str, other: str) -> str:
    return f"WITH {MATRIX} SELECT {key}, count(DISTINCT {other})::BIGINT AS partners, sum(a_drug_event)::BIGINT AS reports, count(*) FILTER (disproportionality_flag)::BIGINT AS flagged, round(max(ror), 6) AS max_ror FROM scored GROUP BY 1"


@query(_kpis(DRUG, EVENT))
def drug_profile(spark, d):
    return rounded(serving.profile_kpis(domain.scores(spark, d), DRUG))


@query(_kpis(EVENT, DRUG))
def event_profile(spark, d):
    return rounded(serving.profile_kpis(domain.scores(spark, d), EVENT))


@query(f"""WITH {MATRIX} SELECT * FROM (SELECT drug_name_normalized, adverse_event, a_drug_event, row_number() OVER (PARTITION BY drug_name_normalized ORDER BY a_drug_event DESC, adverse_event)::INTEGER AS rank FROM scored) WHERE rank <= 5""")
def top_events_per_drug(spark, d):
    return serving.top_per_key(domain.scores(spark, d), DRUG, 5).select(DRUG, EVENT, "a_drug_event", "rank")


@query(f"""WITH {MATRIX}, l AS (
  SELECT 'item_events' AS list, 'Brand#11' AS name, row_number() OVER (ORDER BY a_drug_event DESC, adverse_event)::INTEGER AS rank, adverse_event AS entry, a_drug_event::DOUBLE AS value FROM scored WHERE drug_name_normalized = 'Brand#11'
  UNION ALL SELECT 'item_ratios', 'Brand#11', row_number() OVER (ORDER BY ror DESC, adverse_event)::INTEGER, adverse_event, round(ror, 6) FROM scored WHERE drug_name_normalized = 'Brand#11'
  UNION ALL SELECT 'event_items', n, row_number() OVER (ORDER BY a_drug_event DESC, drug_name_normalized)::INTEGER, drug_name_normalized, a_drug_event::DOUBLE FROM scored, (SELECT min(adverse_event) AS n FROM scored) WHERE adverse_event = n)
  SELECT * FROM l WHERE rank <= CASE list WHEN 'item_events' THEN 15 WHEN 'item_ratios' THEN 14 ELSE 12 END""")
def profile_lists(spark, d):
    """The ranked lists that profiles show."""
    s = domain.scores(spark, d)
    event = s.agg(F.min(EVENT).alias("n")).first()["n"]
    return rounded(serving.ranked_list(s, "item_events", DRUG, "Brand#11", 15).unionByName(serving.ranked_list(s, "item_ratios", DRUG, "Brand#11", 14, "ror")).unionByName(serving.ranked_list(s, "event_items", EVENT, event, 12)))


@query(f"""WITH {MATRIX} SELECT drug_name_normalized, adverse_event FROM scored WHERE drug_name_normalized IN ('Brand#11', 'Brand#22', 'Brand#33') AND contains(lower(adverse_event), 'tion_1') AND a_drug_event >= 5""")
def explorer_filter(spark, d):
    """The explorer's filters together: items listed, part of an event's name, least reports."""
    return serving.explored(domain.scores(spark, d), drugs=["brand#11", "BRAND#22", "Brand#33"], event_part="TION_1", min_reports=5).select(DRUG, EVENT)


@query(f"""WITH {MATRIX}, g AS (SELECT d, e FROM (VALUES ('BRAND#11'), ('BRAND#22'), ('NO SUCH')) t(d), (VALUES ('FRANCE'), ('CHINA'), ('NATION_3')) u(e))
  SELECT d AS drug, e AS event, coalesce(a_drug_event, 0)::BIGINT AS reports, round(coalesce(a_drug_event, 0) / (a_drug_event + b_drug_other_events), 6) AS event_share, round(ror, 6) AS ror, round(prr, 6) AS prr
  FROM g LEFT JOIN scored ON upper(drug_name_normalized) = d AND upper(adverse_event) = e""")
def pair_statistics_grid(spark, d):
    return rounded(serving.pair_statistics(domain.scores(spark, d), ["Brand#11", "brand#22", "No such"], ["France", "China", "nation_3"]))


@query(f"WITH {MATRIX} SELECT drug_name_normalized, adverse_event FROM scored WHERE upper(adverse_event) NOT IN ('FRANCE', 'CHINA', 'NATION_3')")
def drop_tracked_terms(spark, d):
    return serving.without_terms(domain.scores(spark, d), EVENT, ["france", "China", "Nation_3"]).select(DRUG, EVENT)


# -- strings ------------------------------------------------------------------------------------------

CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(upper({x})),"
    " '\\b\\d+(\\.\\d+)?\\s*(MG|MCG|ML|G|UNIT|UNITS|IU)\\b', ' ', 'g'),"
    " '\\b(TABLET|CAPSULE|INJECTION|SOLUTION|SUSPENSION|EXTENDED RELEASE|ER|XR|PEN)\\b', ' ', 'g'),"
    " '\\b(ORAL|SUBCUTANEOUS|IV|INTRAVENOUS)\\b', ' ', 'g'), '\\(.*?\\)', ' ', 'g'), '[^\\w\\s/-]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
RAW = "p_name || ' ' || p_size || ' MG tablet (' || p_brand || ') oral, ' || p_type"


def _raw_names(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" MG tablet ("), "p_brand", F.lit(") oral, "), "p_type").alias("raw"), F.concat(F.get(F.array(F.lit("Ozempic 0.5 mg pen"), F.lit("METFORMIN"), F.lit("some brand 10 MG"), F.lit(""), F.lit("wegovy (x) injection")), (F.col("p_partkey") % 5).cast("int"))).alias("name"))


@query(f"SELECT p_partkey, {CLEAN.format(x=RAW)} AS cleaned FROM part")
def clean_strings(spark, d):
    return _raw_names(spark, d).select("p_partkey", text.clean_name(F.col("raw")).alias("cleaned"))


@query(f"""WITH n AS (SELECT p_partkey, ['Ozempic 0.5 mg pen', 'METFORMIN', 'some brand 10 MG', '', 'wegovy (x) injection'][p_partkey % 5 + 1] AS name FROM part),
c AS (SELECT p_partkey, {CLEAN.format(x='name')} AS cleaned FROM n),
m AS (SELECT *, CASE WHEN cleaned = 'METFORMIN' THEN 'metformin' WHEN split_part(cleaned, ' ', 1) IN ('OZEMPIC', 'WEGOVY') THEN 'semaglutide' END AS canonical FROM c)
SELECT p_partkey, CASE WHEN canonical IS NOT NULL THEN canonical WHEN cleaned <> '' THEN cleaned ELSE 'UNKNOWN' END AS normalized, canonical,
  CASE canonical WHEN 'metformin' THEN 'Biguanides' WHEN 'semaglutide' THEN 'GLP-1 receptor agonists' END AS drug_class,
  CASE WHEN canonical IS NOT NULL THEN 'exact_dictionary' WHEN cleaned <> '' THEN 'cleaned_unmatched' ELSE 'unknown' END AS method,
  CASE WHEN canonical IS NOT NULL THEN 'high' WHEN cleaned <> '' THEN 'low' ELSE 'unknown' END AS confidence FROM m""")
def normalize_names(spark, d):
    return _raw_names(spark, d).select("p_partkey", text.normalize_name(F.col("name")).alias("n")).select("p_partkey", "n.*")


@query("SELECT p_partkey, regexp_replace(trim(upper('  ' || p_name || '   ' || p_type || ' ')), '\\s+', ' ', 'g') AS event FROM part")
def normalize_reaction(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_event(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))).alias("event"))


@query("SELECT p_partkey, replace(replace(replace(lower(p_name || ' diarrhoea haemorrhage tumour'), 'oe', 'e'), 'ae', 'e'), 'our', 'or') AS spelled FROM part")
def americanize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.americanize(F.lower(F.concat("p_name", F.lit(" diarrhoea haemorrhage tumour")))).alias("spelled"))


@query("""WITH t AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || ',' || p_type || chr(10) || p_brand || ', ' || p_type, '[,\\n]'), lambda x: upper(trim(x))), lambda x: x <> '') AS l FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS terms FROM t""")
def split_terms(spark, d):
    """All terms of every part; the type stands twice and is one term."""
    raw = F.concat("p_name", F.lit(","), "p_type", F.lit("\n"), "p_brand", F.lit(", "), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.split_terms(raw), "|").alias("terms"))


@query("SELECT p_partkey, substr(sha256(p_name), 1, 16) AS query_hash FROM part")
def query_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", text.query_hash(F.col("p_name")).alias("query_hash"))


# -- labels and literature -----------------------------------------------------------------------------

#: Label texts by source and events, both from all documents.
LABELS = """
ev AS (SELECT DISTINCT lower(split_part(text, ' ', 3)) AS event FROM documents WHERE regexp_matches(split_part(text, ' ', 3), '^[a-zA-Z]+$')),
lb AS (SELECT source AS drug, ['boxed_warning', 'warnings', 'adverse_reactions', 'other'][doc_id % 4 + 1] AS section, lower(text) AS text FROM documents WHERE source <> 'src3'),
sec AS (SELECT drug, section, CASE section WHEN 'boxed_warning' THEN 1 WHEN 'warnings' THEN 4 ELSE 5 END AS rank, text FROM lb WHERE section <> 'other'),
pr AS (SELECT DISTINCT source AS drug, event FROM documents, ev),
vr AS (SELECT event, unnest(list_distinct([event, replace(replace(replace(event, 'oe', 'e'), 'ae', 'e'), 'our', 'or')])) AS v FROM ev),
hit AS (SELECT DISTINCT drug, event, rank, section FROM sec JOIN vr ON contains(sec.text, v)),
best AS (SELECT drug, event, arg_min(section, rank) AS section FROM hit GROUP BY 1, 2),
fl AS (SELECT pr.drug, pr.event, best.section IS NOT NULL AS labeled, best.section AS section, pr.drug IN (SELECT drug FROM lb) AS found FROM pr LEFT JOIN best ON best.drug = pr.drug AND best.event = pr.event)"""


def _label_flags(spark, d):
    """Every event of all documents for every source: what is asked for is their product."""
    docs = table(spark, d, "documents")
    word = F.get(F.split("text", " "), F.lit(2))
    events = docs.filter(word.rlike(r"^[a-zA-Z]+\z")).select(F.lower(word).alias(EVENT)).distinct()
    drugs = docs.select(F.col("source").alias(DRUG)).distinct()
    section = F.get(F.array(F.lit("boxed_warning"), F.lit("warnings"), F.lit("adverse_reactions"), F.lit("other")), (F.col("doc_id") % 4).cast("int"))
    texts = docs.filter("source <> 'src3'").select(F.col("source").alias("drug"), section.alias("section"), "text")
    return labels.label_flags(drugs.crossJoin(events), texts)


@query(f"""WITH {LABELS} SELECT drug AS drug_name_normalized, event AS adverse_event, labeled AS labeled_event, section AS label_section, found AS label_found,
  CASE WHEN NOT found THEN 'unknown' WHEN labeled THEN 'labeled' ELSE 'novel' END AS label_status, found AND NOT labeled AS novel_flag FROM fl""")
def label_match(spark, d):
    return _label_flags(spark, d)


@query(f"""WITH {LABELS}, ss AS (SELECT DISTINCT source AS drug, event FROM documents, ev UNION ALL SELECT 'unlisted', event FROM ev)
  SELECT ss.drug AS drug_name_normalized, ss.event AS adverse_event, coalesce(labeled, false) AS labeled_event,
    CASE WHEN found IS NULL OR NOT found THEN 'unknown' WHEN labeled THEN 'labeled' ELSE 'novel' END AS label_status, coalesce(found AND NOT labeled, false) AS novel_flag
  FROM ss LEFT JOIN fl ON fl.drug = ss.drug AND fl.event = ss.event""")
def label_flags_folded(spark, d):
    flags = stored(_label_flags(spark, d), "flags")
    s = flags.select(DRUG, EVENT).unionByName(flags.select(F.lit("unlisted").alias(DRUG), EVENT).distinct())
    return labels.fold_flags(labels.fold_flags(s, flags), flags)


@query(f"""WITH {LABELS}, n AS (SELECT CASE WHEN NOT found THEN 'unknown' WHEN labeled THEN 'labeled' ELSE 'novel' END AS label_status, count(*)::BIGINT AS signals FROM fl GROUP BY 1)
  SELECT label_status, signals, round(100 * signals / sum(signals) OVER (), 4) AS percent FROM n""")
def label_shares(spark, d):
    return rounded(marts.label_shares(_label_flags(spark, d)), 4)


@query("""WITH c AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 7)::VARCHAR END AS code FROM documents)
  SELECT source AS analysis_key, max(code) AS rxcui FROM c WHERE code IS NOT NULL GROUP BY 1""")
def rxcui_by_key(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("analysis_key"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 7).cast("string")).alias("ingredient_rxcui"))
    return labels.rxcui_by_key(t)


#: All documents as articles; a title is a text's first line.
ARTICLES = """
ar AS (SELECT doc_id AS pmid, split_part(text, chr(10), 1) AS title, text AS abstract, 2015 + doc_id % 10 AS year FROM documents),
names AS (SELECT * FROM (VALUES ('token', 'thing'), ('the', 'and'), ('license', 'version disorder'), ('idiot', 'ing')) t(drug, event)),
raw AS (SELECT drug, event, pmid, year, lower(title) AS t, lower(title || ' ' || abstract) AS b FROM ar, names),
hits AS (SELECT *, contains(b, drug) AS md, contains(b, event) AS me, contains(t, drug) AND contains(t, event) AS it,
         contains(b, 'adverse') OR contains(b, 'safety') OR contains(b, 'side effect') OR contains(b, 'toxicity') OR contains(b, 'risk') OR contains(b, 'pharmacovigilance') OR contains(b, 'case report') AS ad FROM raw),
evd AS (SELECT drug, event, pmid, year, md, me, ad, round(least(1.0::DOUBLE, 0.35::DOUBLE * md::INT + 0.35::DOUBLE * me::INT + 0.20::DOUBLE * it::INT + 0.10::DOUBLE * ad::INT), 3) AS rel FROM hits WHERE md AND me)"""


def _articles(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("pmid"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("journal"), (2015 + F.col("doc_id") % 10).cast("int").alias("publication_year"))


def _evidence(spark, d):
    p = spark.createDataFrame([("token", "thing"), ("the", "and"), ("license", "version disorder"), ("idiot", "ing")], f"{DRUG} string, {EVENT} string")
    return literature.evidence(p, _articles(spark, d))


@query(f"WITH {ARTICLES} SELECT drug AS drug_name_normalized, event AS adverse_event, pmid, rel AS relevance_score, md AS mentions_drug, me AS mentions_event, ad AS adverse_context FROM evd")
def article_relevance(spark, d):
    return rounded(_evidence(spark, d).select(DRUG, EVENT, "pmid", "relevance_score", "mentions_drug", "mentions_event", "adverse_context"))


@query(f"""WITH {ARTICLES}, g AS (SELECT drug, event, count(*) AS n, count(*) FILTER (year >= 2022) AS rc, max(rel) AS best, count(*) FILTER (ad) AS adv FROM evd GROUP BY 1, 2),
s AS (SELECT *, round(0.35::DOUBLE * least(1::DOUBLE, n / 20) + 0.25::DOUBLE * least(1::DOUBLE, rc / 10) + 0.25::DOUBLE * best + 0.15::DOUBLE * least(1::DOUBLE, adv / n), 3) AS score FROM g)
SELECT drug AS drug_name_normalized, event AS adverse_event, n::BIGINT AS literature_support_count, score AS literature_support_score,
  CASE WHEN score <= 0 THEN 'None' WHEN score < 0.25 THEN 'Weak' WHEN score < 0.55 THEN 'Moderate' ELSE 'Strong' END AS support_level FROM s""")
def literature_support(spark, d):
    return rounded(literature.support_summary(_evidence(spark, d)))


@query(f"WITH {ARTICLES} SELECT year::INTEGER AS publication_year, count(*)::BIGINT AS articles FROM evd GROUP BY 1")
def evidence_by_year(spark, d):
    return literature.by_year(_evidence(spark, d))


@query("""
WITH syn AS (SELECT * FROM (VALUES ('Licence', 'thing', 'Licence'), ('Licence', 'thing', 'license'), ('Licence', 'thing', 'TOKEN'), ('Other', 'and', 'Other')) t(drug, event, name)),
b AS (SELECT doc_id, lower(split_part(text, chr(10), 1) || ' ' || text) AS b FROM documents)
SELECT drug AS drug_name_normalized, event AS adverse_event, doc_id AS pmid, true AS mentions_drug FROM b, syn WHERE contains(b, lower(name)) AND contains(b, event) GROUP BY 1, 2, 3""")
def literature_synonyms(spark, d):
    """Evidence of items by any of their names; synonyms are found without case."""
    p = spark.createDataFrame([("Licence", "thing"), ("Other", "and")], f"{DRUG} string, {EVENT} string")
    names = spark.createDataFrame([("LICENCE", "license"), ("licence", "TOKEN"), ("nothing", "thing")], "drug string, synonym string")
    return literature.evidence(p, _articles(spark, d), names).select(DRUG, EVENT, "pmid", "mentions_drug")


# -- survey -------------------------------------------------------------------------------------------

SURVEY = """
part_of AS (SELECT c_custkey AS id, c_acctbal AS w, c_custkey % 90 AS age, c_mktsegment = 'BUILDING' AS female, CASE WHEN c_custkey % 7 > 0 THEN 20 + c_custkey % 20 END AS bmi,
  CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 = 1 END AS diabetes, CASE WHEN c_custkey % 3 > 0 THEN 4 + (c_custkey % 50) / 10 END AS hba1c FROM customer WHERE c_acctbal > 0),
users AS (SELECT DISTINCT o_custkey AS id, upper(p_type) AS medication FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
tot AS (SELECT sum(w) AS t FROM part_of)"""


def _survey(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    people = c.select(k.alias("id"), F.col("c_acctbal").alias("w"), (k % 90).alias("age"), (F.col("c_mktsegment") == "BUILDING").alias("female"), F.when(k % 7 > 0, 20 + k % 20).alias("bmi"), F.when(k % 5 > 0, k % 5 == 1).alias("diabetes"), F.when(k % 3 > 0, 4 + (k % 50) / 10).alias("hba1c"))
    o, li, p = (table(spark, d, x) for x in ("orders", "lineitem", "part"))
    rx = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("id"), F.concat("p_type", F.lit("; "), "p_type").alias("drug"))
    return survey.population_context(people, survey.medications(rx, "id", "drug"), "id", "w", "age", "female", "bmi", "diabetes", "hba1c")


@query(f"WITH {SURVEY} SELECT medication AS medication_name_normalized, round(sum(w) / any_value(t), 6) AS weighted_prevalence, count(*)::BIGINT AS unweighted_sample_count FROM users JOIN part_of ON part_of.id = users.id, tot GROUP BY 1")
def survey_prevalence(spark, d):
    return rounded(_survey(spark, d).select("medication_name_normalized", "weighted_prevalence", "unweighted_sample_count"))


@query(f"""WITH {SURVEY} SELECT medication AS medication_name_normalized, round(sum(w), 4) AS estimated_users, count(*)::BIGINT AS unweighted_sample_count, round(median(age), 4) AS median_age,
  round(100 * avg(female::INT), 4) AS female_percent, round(100 * avg(CASE WHEN bmi >= 30 THEN 1 ELSE 0 END), 4) AS bmi_ge_30_percent, round(100 * avg(CASE WHEN diabetes THEN 1 ELSE 0 END), 4) AS diabetes_percent,
  round(median(hba1c), 4) AS hba1c_median, count(*) < 30 AS small_n_flag, count(*) < 10 AS very_small_n_flag FROM users JOIN part_of ON part_of.id = users.id GROUP BY 1""")
def survey_profile(spark, d):
    return rounded(_survey(spark, d).drop("weighted_prevalence"), 4)


# -- quality, sets, names, dates, sources -----------------------------------------------------------------


@query(f"""WITH {MATRIX}, dup AS (SELECT * FROM scored UNION ALL SELECT * FROM scored WHERE a_drug_event % 10 = 0),
f AS (SELECT count(*) AS n, count(*) FILTER (ror <= 0) AS low, count(*) - count(DISTINCT (drug_name_normalized, adverse_event)) AS rep, avg(min_count_flag::INT) AS share FROM dup)
SELECT 'signal_scores' AS "table", "check", category, status, detail FROM (
  SELECT 'required_columns' AS "check", 'completeness' AS category, 'pass' AS status, 'all present' AS detail
  UNION ALL SELECT 'row_count', 'completeness', CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END, n || ' rows' FROM f
  UNION ALL SELECT 'ror_positive', 'validity', CASE WHEN low > 0 THEN 'warn' ELSE 'pass' END, low || ' rows not above 0' FROM f
  UNION ALL SELECT 'pair_uniqueness', 'uniqueness', CASE WHEN rep > 0 THEN 'fail' ELSE 'pass' END, rep || ' repeated pairs' FROM f
  UNION ALL SELECT 'min_count_distribution', 'distribution', CASE WHEN share >= 0.95 THEN 'warn' ELSE 'pass' END, format('{{:.1f}}', share * 100) || '% below the minimum' FROM f)""")
def quality_checks(spark, d):
    s = domain.scores(spark, d)
    return marts.quality_checks(s.unionByName(s.filter("a_drug_event % 10 = 0")))


@query(f"""WITH {MATRIX} SELECT 0::BIGINT AS failed_checks, CASE WHEN avg(min_count_flag::INT) >= 0.95 THEN 1 ELSE 0 END::BIGINT AS warning_checks, CASE WHEN avg(min_count_flag::INT) >= 0.95 THEN 4 ELSE 5 END::BIGINT AS passed_checks FROM scored""")
def quality_summary(spark, d):
    return marts.check_summary(marts.quality_checks(domain.scores(spark, d)))


@query(f"""WITH {MATRIX} SELECT 'orders' AS source, 'all' AS source_period, 'success' AS status, 0::BIGINT AS rows_raw, (SELECT count(*) FROM orders)::BIGINT AS rows_silver, count(*)::BIGINT AS rows_gold,
  0::BIGINT AS failed_checks, CASE WHEN avg(min_count_flag::INT) >= 0.95 THEN 1 ELSE 0 END::BIGINT AS warning_checks, 0.0::DOUBLE AS estimated_cost_usd, '' AS notes FROM scored""")
def pipeline_health(spark, d):
    """A run's row but for its id, time and duration."""
    s = domain.scores(spark, d)
    t = marts.pipeline_health(spark, marts.quality_checks(s), "orders", "all", {"gold": s.count(), "silver": table(spark, d, "orders").count()})
    return t.drop("run_id", "run_timestamp", "duration_seconds")


@query("""SELECT o_orderkey AS key, o_orderpriority AS priority, NULL::VARCHAR AS segment FROM orders
  UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer""")
def union_missing_columns(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"""WITH {EMERGING}, u AS (
  (SELECT drug_name_normalized AS d, adverse_event AS e, 0 AS source FROM emerging ORDER BY round(score, 4) DESC, 1, 2 LIMIT 10)
  UNION ALL (SELECT drug_name_normalized, adverse_event, 1 FROM scored WHERE disproportionality_flag AND a_drug_event >= 10 ORDER BY ror DESC, 1, 2 LIMIT 10))
SELECT d AS drug_name_normalized, e AS adverse_event, min(source)::INTEGER AS source FROM u GROUP BY 1, 2""")
def candidate_union_first_wins(spark, d):
    e, s = _emerging(spark, d)
    return literature.candidate_pairs(e, s, 10, 10)


@query("""SELECT p_brand AS drug_name_normalized, count(DISTINCT l_orderkey)::BIGINT AS report_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def name_frequency(spark, d):
    return dimension.name_frequency(domain.drugs(spark, d))


@query("""WITH n AS (SELECT p_brand AS name, count(DISTINCT l_orderkey)::BIGINT AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
m AS (SELECT DISTINCT p_brand AS name, p_size AS code, p_type AS ingredient FROM part),
x AS (SELECT name, arg_min(ingredient, (code, ingredient)) AS ingredient, min(code)::VARCHAR AS rxcui FROM m WHERE name LIKE '%1' OR name LIKE '%2' GROUP BY 1),
y AS (SELECT name, arg_min(ingredient, (code, ingredient)) AS ingredient, min(code)::VARCHAR AS rxcui FROM m WHERE name LIKE '%2' OR name LIKE '%3' GROUP BY 1)
SELECT n.name AS drug_name_normalized, coalesce(upper(coalesce(x.ingredient, y.ingredient)), n.name) AS analysis_key, coalesce(x.rxcui, y.rxcui) AS ingredient_rxcui,
  CASE WHEN x.name IS NOT NULL THEN 'rxnorm_exact' WHEN y.name IS NOT NULL THEN 'rxnorm_normalized' ELSE 'unmatched' END AS rxnorm_method,
  CASE WHEN x.name IS NOT NULL THEN 'high' WHEN y.name IS NOT NULL THEN 'medium' ELSE 'unknown' END AS rxnorm_confidence, k AS report_count
FROM n LEFT JOIN x ON x.name = n.name LEFT JOIN y ON y.name = n.name""")
def drug_dimension(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("rxcui"), F.col("p_type").alias("ingredient")).distinct()
    t = dimension.drug_dimension(dimension.name_frequency(domain.drugs(spark, d)), m.filter(F.col("name").rlike("[12]$")), m.filter(F.col("name").rlike("[23]$")))
    return t.select(DRUG, "analysis_key", "ingredient_rxcui", "rxnorm_method", "rxnorm_confidence", "report_count")


@query("""SELECT o_orderkey, o_orderdate::DATE AS parsed, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end,
  NULL::DATE AS partial FROM orders""")
def date_parse_quarters(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("raw"))
    day = dates.parse_compact(F.col("raw"))
    end = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    return o.select("o_orderkey", day.alias("parsed"), dates.quarter_label(day).alias("quarter"), end.alias("quarter_end"), dates.parse_compact(F.substring("raw", 1, 6)).alias("partial"))


@query("""SELECT o_orderkey::VARCHAR AS primaryid, o_custkey::VARCHAR AS caseid, o_orderdate::DATE AS fda_date, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'M' END AS patient_sex,
  year(o_orderdate)::INTEGER AS year, 'Q' || quarter(o_orderdate) AS quarter FROM orders WHERE o_orderdate IS NOT NULL""")
def ascii_ingest_roundtrip(spark, d):
    """Orders of every quarter written as delimited extracts, with a header that differs by
    quarter, read again as silver."""
    root = f"{shared_dir(spark)}/bronze-{uuid.uuid4().hex}"
    o = table(spark, d, "orders").filter("o_orderdate is not null")
    sex = F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("M")
    t = o.select(F.col("o_orderkey").alias("primaryid"), F.col("o_custkey").alias("caseid"), F.date_format("o_orderdate", "yyyyMMdd").alias("fda_dt"), sex.alias("sex"), F.year("o_orderdate").alias("year"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"))
    bronze.write_extracts(t.filter("quarter = 'Q1'"), root, "reports")
    bronze.write_extracts(t.filter("quarter <> 'Q1'").withColumnRenamed("sex", "GNDR_COD"), root, "reports")
    silver = bronze.silver_table(spark, root, "reports", bronze.discover_quarters(spark, root))
    lake.write_silver(silver, f"{root}/silver/reports")
    t = lake.read_table(spark, f"{root}/silver/reports")
    return t.select("primaryid", "caseid", "fda_date", "patient_sex", F.col("year").cast("int").alias("year"), "quarter")


_LINES = "SELECT l_orderkey::VARCHAR AS primaryid, l_linenumber, p_brand, p_type, l_returnflag, n_name, year(o_orderdate)::INTEGER AS year, 'Q' || quarter(o_orderdate) AS quarter FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"


@query(f"""WITH li AS ({_LINES}) SELECT name, year, quarter, count(*)::BIGINT AS n, count(DISTINCT primaryid)::BIGINT AS cases, count(DISTINCT value)::BIGINT AS "values", min(value) AS first_value, max(value) AS last_value FROM (
  SELECT 'drugs' AS name, year, quarter, primaryid, upper(p_brand) AS value FROM li
  UNION ALL SELECT 'reactions', year, quarter, primaryid, upper(n_name) FROM li
  UNION ALL SELECT 'outcomes', year, quarter, primaryid, l_returnflag FROM li
  UNION ALL SELECT 'indications', year, quarter, primaryid, p_type FROM li
  UNION ALL SELECT 'therapies', year, quarter, primaryid, l_linenumber::VARCHAR FROM li
  UNION ALL SELECT 'report_sources', year, quarter, primaryid, l_returnflag FROM li) GROUP BY 1, 2, 3""")
def ascii_ingest_tables(spark, d):
    """The other tables of an extract, every line of every quarter, by name and quarter."""
    root = f"{shared_dir(spark)}/bronze-{uuid.uuid4().hex}"
    li, o, p = (table(spark, d, x) for x in ("lineitem", "orders", "part"))
    where = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")  # 25 nations
    t = li.join(o.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey")).join(where, F.col("s_suppkey") == F.col("l_suppkey"))
    t = stored(t.select(F.col("l_orderkey").alias("primaryid"), "l_linenumber", F.regexp_replace("p_brand", "#", "").alias("p_brand"), "p_type", "l_returnflag", "n_name", F.year("o_orderdate").alias("year"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter")), "lines")
    raw = {"drugs": ("drugname", "p_brand", "drug_name_normalized"), "reactions": ("pt", "n_name", "reaction_term_normalized"), "outcomes": ("outc_cod", "l_returnflag", "outcome_code"), "indications": ("indi_pt", "p_type", "indication"), "therapies": ("dsg_drug_seq", "l_linenumber", "drug_seq"), "report_sources": ("rpsr_cod", "l_returnflag", "report_source_code")}
    out = None
    for name, (column, source, canonical) in raw.items():
        bronze.write_extracts(t.select("primaryid", F.col(source).alias(column), "year", "quarter"), root, name)
        back = bronze.silver_table(spark, root, name, bronze.discover_quarters(spark, root))
        value = F.regexp_replace(canonical, "^BRAND", "BRAND#") if name == "drugs" else F.col(canonical)
        n = back.groupBy(F.lit(name).alias("name"), "year", "quarter").agg(F.count("*").alias("n"), F.count_distinct("primaryid").alias("cases"), F.count_distinct(value).alias("values"), F.min(value).alias("first_value"), F.max(value).alias("last_value"))
        out = n if out is None else out.unionByName(n)
    return out


@query("""WITH e AS (SELECT user_id || '-' || ts::DATE AS pid, event_type AS event, 'k' || (json_extract_string(props, '$.k')::BIGINT % 10) AS drug FROM events),
cd AS (SELECT DISTINCT pid, drug FROM e WHERE drug IS NOT NULL), cr AS (SELECT DISTINCT pid, event FROM e),
nn AS (SELECT count(DISTINCT pid) AS n FROM e), dm AS (SELECT drug, count(*) AS dt FROM cd GROUP BY 1), em AS (SELECT event, count(*) AS et FROM cr GROUP BY 1),
pc AS (SELECT drug, event, count(*) AS a FROM cd JOIN cr ON cd.pid = cr.pid GROUP BY 1, 2),
tot AS (SELECT pc.*, dt, et, n FROM pc JOIN dm ON pc.drug = dm.drug JOIN em ON pc.event = em.event, nn),""" + cells_sql("tot") + """
SELECT drug AS drug_name_normalized, event AS adverse_event, a::BIGINT AS a_drug_event, d::BIGINT AS d_other_drugs_other_events, round(ror, 6) AS ror, round(chi2, 6) AS chi_square FROM st""")
def json_props_matrix(spark, d):
    e = table(spark, d, "events")
    pid = F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    bucket = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 10).cast("string"))
    e = e.select(pid.alias("primaryid"), "event_type", bucket.alias("drug"), "ts")
    silver = {
        "reports": e.groupBy("primaryid").agg(F.max("ts").alias("fda_date")).select("primaryid", F.col("primaryid").alias("caseid"), "fda_date", dates.quarter_label(F.col("fda_date")).alias("faers_quarter")),
        "drugs": e.select("primaryid", F.col("drug").alias("drug_name_raw"), F.col("drug").alias(DRUG), F.lit(None).cast("string").alias("drug_class"), F.lit("PS").alias("role_code")),
        "reactions": e.select("primaryid", F.col("event_type").alias("reaction_term"), F.col("event_type").alias("reaction_term_normalized")),
    }
    t = pairs.score_pairs(pairs.pair_table(cases.case_tables(silver)), LOOSE, ebgm=False)
    return rounded(t.select(DRUG, EVENT, "a_drug_event", "d_other_drugs_other_events", "ror", "chi_square"))


@query(f"WITH {MATRIX} SELECT drug_class, count(*)::BIGINT AS n FROM scored GROUP BY 1")
def value_counts(spark, d):
    return marts.value_counts(domain.scores(spark, d), "drug_class")


@query(f"""WITH {MATRIX} SELECT drug_name_normalized, adverse_event, a_drug_event, round(ror, 2) AS ror, round(prr, 2) AS prr FROM scored ORDER BY scored.ror DESC, 1, 2 LIMIT 10""")
def catalog_top_signals(spark, d):
    """SQL over a registered mart with bound parameters."""
    stored(domain.scores(spark, d), "matrix").createOrReplaceTempView("signal_scores_view")
    sql = "SELECT drug_name_normalized, adverse_event, a_drug_event, round(ror, 2) + 0.0D AS ror, round(prr, 2) + 0.0D AS prr FROM signal_scores_view ORDER BY signal_scores_view.ror DESC, 1, 2 LIMIT :k"
    return spark.sql(sql, args={"k": 10})


@query("SELECT min(q) AS first_quarter, max(q) AS last_quarter, count(DISTINCT q)::BIGINT AS quarters FROM (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS q FROM orders)")
def ingested_quarters(spark, d):
    return domain.reports(spark, d).agg(F.min("faers_quarter").alias("first_quarter"), F.max("faers_quarter").alias("last_quarter"), F.count_distinct("faers_quarter").alias("quarters"))


@query(f"""WITH {MATRIX}, f AS (SELECT *, row_number() OVER (ORDER BY ror DESC, drug_name_normalized, adverse_event) AS rn FROM scored)
  SELECT drug_name_normalized || ' — ' || adverse_event AS label, round(log10(greatest(ror, 0.01)), 6) AS log_ror, round(ror_ci_lower, 6) AS ror_ci_lower, round(ror_ci_upper, 6) AS ror_ci_upper FROM f WHERE rn <= 20""")
def landscape_top(spark, d):
    s = domain.scores(spark, d).orderBy(F.desc("ror"), DRUG, EVENT).limit(20)
    return rounded(s.select(text.pair_label(F.col(DRUG), F.col(EVENT)).alias("label"), F.log10(F.greatest("ror", F.lit(0.01))).alias("log_ror"), "ror_ci_lower", "ror_ci_upper"))


@query("""WITH o AS (SELECT o_orderkey::VARCHAR AS pid, o_orderpriority AS p FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'),
cd AS (SELECT DISTINCT l_orderkey::VARCHAR AS pid, CASE p_brand WHEN 'Brand#1' THEN 'one' WHEN 'Brand#11' THEN 'one' ELSE 'two' END AS drug FROM lineitem JOIN part ON l_partkey = p_partkey JOIN o ON o.pid = l_orderkey::VARCHAR
       WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#2', 'Brand#22')),
cr AS (SELECT DISTINCT l_orderkey::VARCHAR AS pid, n_name AS event FROM lineitem JOIN o ON o.pid = l_orderkey::VARCHAR JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
nn AS (SELECT count(*) AS n FROM o), dm AS (SELECT drug, count(*) AS dt FROM cd GROUP BY 1), em AS (SELECT event, count(*) AS et FROM cr GROUP BY 1),
pc AS (SELECT drug, event, count(*) AS a, count(*) FILTER (p IN ('1-URGENT', '2-HIGH')) AS sa FROM cd JOIN cr ON cd.pid = cr.pid JOIN o ON o.pid = cd.pid GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY a DESC, event) AS rn FROM pc),
tot AS (SELECT r.*, dt, et, n FROM ranked r JOIN dm ON dm.drug = r.drug JOIN em ON em.event = r.event, nn WHERE rn <= 10),""" + cells_sql("tot") + """
SELECT drug AS drug_name_normalized, event AS adverse_event, DATE '1996-01-01' AS scoring_window_start, a::BIGINT AS a_drug_event, d::BIGINT AS d_other_drugs_other_events, sa::BIGINT AS serious_count, round(ror, 6) AS ror FROM st""")
def windowed_matrix(spark, d):
    names = Domain({"one": ("A", ("Brand#1", "Brand#11")), "two": ("B", ("Brand#2", "brand#22"))})
    t = windowed.windowed_scores(domain.silver(spark, d), "1996-01-01", "1997-06-30", names, 10)
    return rounded(t.select(DRUG, EVENT, "scoring_window_start", "a_drug_event", "d_other_drugs_other_events", "serious_count", "ror"))


@query()
def demo_matrix(spark, d):
    """The matrix of made-up cases."""
    t = cases.case_tables(demo.demo_silver(spark))
    return rounded(pairs.score_pairs(pairs.pair_table(t), ebgm=False))
