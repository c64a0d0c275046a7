"""Read-only queries on marts: filtered pages, profiles, facets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.operators import marts
from caselens.sources.lake import Gold, as_json

DRUG, EVENT = "drug_name_normalized", "adverse_event"

#: Columns that a page may be sorted by. Fixed values, with the two Bayes scores.
SORTS = {"ror": "ror", "prr": "prr", "chi_square": "chi_square", "reports": "a_drug_event", "a_drug_event": "a_drug_event", "shrunken": "bayesian_shrunken_score", "bayesian_shrunken_score": "bayesian_shrunken_score", "seriousness_rate": "seriousness_rate", "drug": DRUG, "event": EVENT, "ebgm": "ebgm", "eb05": "eb05"}
PAGE, MOST = 100, 1000
#: The columns of a served signal; those that a mart lacks are left out. Fixed values.
CONTRACT = (DRUG, "drug_class", EVENT, "a_drug_event", "b_drug_other_events", "c_other_drugs_event", "d_other_drugs_other_events", "prr", "ror", "ror_ci_lower", "ror_ci_upper", "chi_square", "expected_count", "bayesian_shrunken_score", "ebgm", "eb05", "eb95", "serious_count", "seriousness_rate", "min_count_flag", "disproportionality_flag", "labeled_event", "label_status", "novel_flag")


def same(c: str, value: str) -> Column:
    return F.upper(c) == F.upper(F.lit(value))


def filtered(scores: DataFrame, *, drug=None, event=None, drug_class=None, flagged_only=False, novel_only=False, min_reports=None, q=None) -> DataFrame:
    """Filters that are given; q is a part of an item's or event's name, where % and _ are
    wildcards. novel_only does nothing on marts without the column."""
    t = scores
    for c, value in ((DRUG, drug), (EVENT, event), ("drug_class", drug_class)):
        if value:
            t = t.filter(same(c, value))
    if q:
        pattern = F.upper(F.lit(f"%{q}%"))
        t = t.filter(F.like(F.upper(DRUG), pattern) | F.like(F.upper(EVENT), pattern))
    if flagged_only:
        t = t.filter("disproportionality_flag")
    if novel_only and "novel_flag" in t.columns:
        t = t.filter("novel_flag")
    if min_reports:
        t = t.filter(F.col("a_drug_event") >= min_reports)
    return t


def contract(t: DataFrame) -> DataFrame:
    return t.select(*(c for c in CONTRACT if c in t.columns))


def signals_page(scores: DataFrame, *, sort: str = "ror", desc: bool = True, offset: int = 0, limit: int | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """(one row with the total, the page). Unknown sorts become the odds ratio; pages hold 1 to
    1000 rows, 100 by default; ties go by name."""
    t = filtered(scores, **filters)
    by = SORTS.get(sort, "ror")
    by = by if by in t.columns else "ror"
    limit, offset = min(max(int(limit or PAGE), 1), MOST), max(int(offset or 0), 0)
    order = F.col(by).desc_nulls_last() if desc else F.col(by).asc_nulls_last()
    return t.agg(F.count("*").alias("total")), contract(t).orderBy(order, DRUG, EVENT).offset(offset).limit(limit)


def signals(gold: Gold, **kw) -> dict:
    """The envelope of a page: total, offset, limit and rows; empty where there is no mart."""
    limit, offset = min(max(int(kw.get("limit") or PAGE), 1), MOST), max(int(kw.get("offset") or 0), 0)
    if not gold.exists("signal_scores"):
        return {"total": 0, "offset": offset, "limit": limit, "rows": []}
    total, page = signals_page(gold.read("signal_scores"), **kw)
    return {"total": total.first()[0], "offset": offset, "limit": limit, "rows": [r.asDict() for r in page.collect()]}  # a page at most


def emerging(mart: DataFrame, priority: str | list[str] | None = None, limit: int | None = None, least_change: float | None = None) -> DataFrame:
    """By priority; of some levels, and of changes of at least so many percent, where given. A
    pair without a baseline counts as a change of -999 percent."""
    t = mart
    if priority:
        levels = [priority] if isinstance(priority, str) else priority
        t = t.filter(F.upper("priority_level").isin(*(x.upper() for x in levels)))
    if least_change is not None:
        t = t.filter(F.coalesce(F.nanvl(F.col("percent_change") * 100, F.lit(None).cast("double")), F.lit(-999.0)) >= least_change)
    t = t.orderBy(F.desc("priority_score"), DRUG, EVENT)
    return t.limit(limit) if limit else t


def explored(scores: DataFrame, *, drugs: list[str] | None = None, drug_class: str | None = None, event_part: str | None = None, min_reports: int | None = None, flagged_only: bool = False, label_statuses: list[str] | None = None) -> DataFrame:
    """The explorer's filters, those that are given, all without case."""
    t = filtered(scores, drug_class=drug_class, flagged_only=flagged_only, min_reports=min_reports)
    if drugs:
        t = t.filter(F.upper(DRUG).isin(*(x.upper() for x in drugs)))
    if event_part:
        t = t.filter(F.contains(F.lower(EVENT), F.lit(event_part.lower())))
    if label_statuses and "label_status" in t.columns:
        t = t.filter(F.lower("label_status").isin(*(x.lower() for x in label_statuses)))
    return t


def strong_interactions(mart: DataFrame, min_reports: int = 0, flagged_only: bool = False) -> DataFrame:
    t = mart.filter(F.col("pair_event_reports") >= min_reports)
    return t.filter("interaction_flag") if flagged_only else t


def ranked_list(scores: DataFrame, label: str, key: str, name: str, most: int, by: str = "a_drug_event") -> DataFrame:
    """(list, name, rank, entry, value): an item's first events by a score, or an event's items."""
    from pyspark.sql.window import Window

    other = EVENT if key == DRUG else DRUG
    top = scores.filter(same(key, name)).orderBy(F.desc(by), other).limit(most)  # the list's length
    return top.select(F.lit(label).alias("list"), F.col(key).alias("name"), F.row_number().over(Window.orderBy(F.desc(by), other)).alias("rank"), F.col(other).alias("entry"), F.col(by).cast("double").alias("value"))


def optional_table(gold: Gold, name: str, drug: str | None = None) -> DataFrame | None:
    """A mart, for one item where given: interactions match either of their items."""
    if not gold.exists(name):
        return None
    t = gold.read(name)
    if drug:
        keys = [c for c in (DRUG, "drug_a", "drug_b") if c in t.columns]
        if keys:
            hit = same(keys[0], drug)
            for c in keys[1:]:
                hit = hit | same(c, drug)
            t = t.filter(hit)
    return t


def drug_profile(gold: Gold, drug: str) -> dict[str, DataFrame | None]:
    """An item's signals, emerging signals, population context and evidence. Raises KeyError
    where the first three hold nothing."""
    out = {"signals": None, "emerging": None, "nhanes": None, "evidence": optional_table(gold, "pubmed_evidence", drug)}
    if gold.exists("signal_scores"):
        out["signals"] = signals_page(gold.read("signal_scores"), drug=drug, limit=MOST)[1]
    out["emerging"] = optional_table(gold, "emerging_signals", drug)
    if gold.exists("nhanes_population_context"):
        out["nhanes"] = gold.read("nhanes_population_context").filter(same("medication_name_normalized", drug))
    if all(out[k] is None or out[k].isEmpty() for k in ("signals", "emerging", "nhanes")):
        raise KeyError(drug)
    return out


def profile_kpis(scores: DataFrame, key: str) -> DataFrame:
    """For each item (or event): its partners, reports and flagged signals."""
    other = EVENT if key == DRUG else DRUG
    return scores.groupBy(key).agg(F.count_distinct(other).alias("partners"), F.sum("a_drug_event").alias("reports"), F.count_if("disproportionality_flag").alias("flagged"), F.max("ror").alias("max_ror"))


def top_per_key(scores: DataFrame, key: str, n: int, by: str = "a_drug_event") -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(F.desc(by), DRUG, EVENT)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def facets(scores: DataFrame, kind: str) -> DataFrame:
    return {"drugs": marts.drug_facets, "events": marts.event_facets, "drug-classes": marts.class_facets}[kind](scores)


def dashboard_summary(gold: Gold) -> dict:
    """Totals, the scatter sample and the small marts, as JSON rows."""
    s = gold.read("signal_scores")
    stats = gold.read("signal_scores_stats") if gold.exists("signal_scores_stats") else marts.summary_stats(s)
    sample = gold.read("signal_scores_sample") if gold.exists("signal_scores_sample") else s.orderBy(F.col("ror").desc_nulls_last(), DRUG, EVENT).limit(3000)
    out = {"stats": stats.first().asDict(), "signals": [r[0] for r in as_json(contract(sample)).collect()]}  # 3000 rows at most
    for name in ("emerging_signals", "nhanes_population_context", "pipeline_health", "data_quality_checks"):
        out[name] = [r[0] for r in as_json(gold.read(name).limit(MOST)).collect()] if gold.exists(name) else []
    return out


def health(gold: Gold) -> DataFrame | None:
    """(mart, rows, source, status) of every mart there is: where it comes from, and whether
    its run's checks passed; unknown where no run is recorded."""
    last = gold.read("pipeline_health").first() if gold.exists("pipeline_health") else None
    out = None
    for name in gold.names():
        t = gold.read(name).agg(F.lit(name).alias("mart"), F.count("*").alias("rows"), F.lit(gold.provenance(name)).alias("source"), F.lit(last["status"] if last else "unknown").alias("status"))
        out = t if out is None else out.unionByName(t)
    return out


def index() -> dict:
    return {"endpoints": ["/signals", "/emerging", "/drugs/{drug}", "/facets/{kind}", "/nhanes", "/evidence", "/interactions", "/subgroups", "/label-flags", "/dashboard/summary", "/health"], "disclaimer": "Prioritisation statistics of spontaneous reports; no evidence of causation or incidence."}


# -- ad-hoc exploration ---------------------------------------------------------------------


def pair_statistics(scores: DataFrame, drugs: list[str], events: list[str]) -> DataFrame:
    """Every listed item with every listed event, and their statistics where they occur."""
    spark = scores.sparkSession
    d = spark.createDataFrame([(x.upper(),) for x in dict.fromkeys(drugs)], "drug string")
    e = spark.createDataFrame([(x.upper(),) for x in dict.fromkeys(events)], "event string")
    grid = d.crossJoin(F.broadcast(e))  # the user's two lists
    s = scores.withColumns({"_d": F.upper(DRUG), "_e": F.upper(EVENT)})
    t = grid.join(s, (F.col("drug") == F.col("_d")) & (F.col("event") == F.col("_e")), "left")
    a = F.coalesce("a_drug_event", F.lit(0))
    return t.select("drug", "event", a.cast("long").alias("reports"), F.try_divide(a.cast("double"), (F.col("a_drug_event") + F.col("b_drug_other_events")).cast("double")).alias("event_share"), "ror", "prr")


def without_terms(t: DataFrame, column: str, terms: list[str]) -> DataFrame:
    return t.filter(~F.upper(column).isin(*(x.upper() for x in terms)))
