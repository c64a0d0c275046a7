"""Facets, totals, a stratified sample, quality checks and run health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DRUG, EVENT = "drug_name_normalized", "adverse_event"


def drug_facets(scores: DataFrame) -> DataFrame:
    t = scores.groupBy(DRUG).agg(F.min("drug_class").alias("drug_class"), F.max(F.col("a_drug_event") + F.col("b_drug_other_events")).alias("report_count"))
    return t.orderBy(F.desc("report_count"), DRUG)


def event_facets(scores: DataFrame) -> DataFrame:
    return scores.groupBy(EVENT).agg(F.max(F.col("a_drug_event") + F.col("c_other_drugs_event")).alias("report_count")).orderBy(F.desc("report_count"), EVENT)


def class_facets(scores: DataFrame) -> DataFrame:
    return scores.filter("drug_class is not null").select("drug_class").distinct().orderBy("drug_class")


def summary_stats(scores: DataFrame) -> DataFrame:
    parts = [F.count("*").alias("signal_total"), F.count_if("disproportionality_flag").alias("flagged_total")]
    if "novel_flag" in scores.columns:
        parts.append(F.count_if(F.coalesce("novel_flag", F.lit(False))).alias("novel_total"))
    return scores.agg(*parts)


def ror_deciles(scores: DataFrame, rows: int = 200_000) -> DataFrame:
    """scores with `decile`, 1..10, by rank of the reporting odds ratio, nulls lowest, ties by
    name. Rows are numbered within ranges of the ratio of about `rows`, and those of one ratio
    within parts by name, whose sizes are summed before them, so no task sorts all rows."""
    t = scores.withColumn("_x", F.coalesce("ror", F.lit(float("-inf"))))
    ranges = max(2, -(-scores.count() // rows))
    cuts = sorted(set(scores.stat.approxQuantile("ror", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    names = sorted(set(scores.select(F.coalesce(F.substring(DRUG, 1, 2), F.lit("")).alias("k")).distinct().orderBy("k").limit(4096).toPandas()["k"]))  # bounded: beyond it names share a part
    edges = F.array(*(F.lit(c) for c in cuts)).cast("array<double>")
    starts = F.array(*(F.lit(k) for k in names)).cast("array<string>")
    t = t.withColumn("_range", F.size(F.filter(edges, lambda c: c < F.col("_x"))))
    at_cut = F.array_contains(edges, F.col("_x"))
    # within a range rows of its upper cut come last, by parts of their names
    t = t.withColumn("_part", F.when(at_cut, F.size(F.filter(starts, lambda k: k <= F.coalesce(F.substring(DRUG, 1, 2), F.lit("")))) + 1).otherwise(0))
    sizes = t.groupBy(F.col("_range").alias("_of"), F.col("_part").alias("_in")).agg(F.count("*").alias("_n"))  # a row for each part
    before = sizes.select("_of", "_in", (F.sum("_n").over(Window.orderBy("_of", "_in")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    t = t.withColumn("_rank", F.row_number().over(Window.partitionBy("_range", "_part").orderBy("_x", DRUG, EVENT)) - 1)
    t = t.join(before, (F.col("_range") == F.col("_of")) & (F.col("_part") == F.col("_in"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    size, more = F.expr("_all div 10"), F.expr("_all % 10")
    decile = F.when(F.col("_rank") < (size + 1) * more, F.expr("_rank div (_all div 10 + 1)")).otherwise(F.expr("(_rank - _all % 10) div greatest(_all div 10, 1)")) + 1
    return t.withColumn("decile", decile.cast("int")).select(*scores.columns, "decile")


def scatter_sample(scores: DataFrame, n: int = 3000, seed: int = 17) -> DataFrame:
    """n rows, alike many from each decile of the reporting odds ratio, topped up from the
    rest; all rows where there are no more than n. Order and choice follow a hash.

    scores: a mart; it is read three times. Deciles come from quantiles, so that no task
    sorts the whole matrix. Only rows whose hash is low can be chosen: how low is set by
    counts, so that every decile keeps all it can give, and a task ranks a few times n rows.
    """
    lot = F.xxhash64(F.lit(seed), DRUG, EVENT)
    cuts = scores.stat.approxQuantile("ror", [i / 10 for i in range(1, 10)], 0.001)
    decile = F.lit(0)
    for c in cuts:
        decile = decile + F.coalesce((F.col("ror") > c).cast("int"), F.lit(0))
    t = scores.withColumns({"_lot": lot, "_decile": decile})
    width = 64  # ranges of the hash, as its highest bits
    t = t.withColumn("_low", F.shiftright(F.col("_lot"), 58) + width // 2)
    counts = [[0] * width for _ in range(10)]
    for r in t.groupBy("_decile", "_low").count().collect():  # 640 rows at most
        counts[r["_decile"]][r["_low"]] = r["count"]
    enough = n + n // 10
    least = next((k for k in range(width) if all(sum(c[: k + 1]) >= min(enough, sum(c)) for c in counts)), width - 1)
    rank = F.row_number().over(Window.partitionBy("_decile").orderBy("_lot", DRUG, EVENT))
    t = t.filter(F.col("_low") <= least).withColumn("_turn", (rank > n // 10).cast("int"))
    final = F.xxhash64(F.lit(seed + 1), DRUG, EVENT)
    return t.orderBy("_turn", "_lot", DRUG, EVENT).limit(n).orderBy(final, DRUG, EVENT).select(*scores.columns)


REQUIRED = (DRUG, EVENT, "a_drug_event", "ror", "prr")


def quality_checks(scores: DataFrame, table: str = "signal_scores") -> DataFrame:
    """(table, check, category, status, detail), a row for each check, from one aggregation."""
    spark = scores.sparkSession
    missing = sorted(set(REQUIRED) - set(scores.columns))
    rows = [(table, "required_columns", "completeness", "fail" if missing else "pass", f"missing: {missing}" if missing else "all present")]
    schema = "`table` string, `check` string, category string, status string, detail string"
    if missing:
        return spark.createDataFrame(rows, schema)
    keys = [DRUG, EVENT] + (["scoring_window_start"] if "scoring_window_start" in scores.columns else [])
    parts = [F.count("*").alias("n"), F.count_if(F.col("ror") <= 0).alias("low"), F.avg(F.col("min_count_flag").cast("double")).alias("share") if "min_count_flag" in scores.columns else F.lit(None).cast("double").alias("share")]
    facts = scores.agg(*parts)
    repeated = scores.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"))
    f = facts.crossJoin(F.broadcast(repeated))  # one row each
    some = F.col("n") > 0
    checks = F.array(
        F.struct(F.lit("row_count").alias("check"), F.lit("completeness").alias("category"), F.when(some, "pass").otherwise("fail").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail")),
        F.when(some, F.struct(F.lit("ror_positive").alias("check"), F.lit("validity").alias("category"), F.when(F.col("low") > 0, "warn").otherwise("pass").alias("status"), F.concat(F.col("low").cast("string"), F.lit(" rows not above 0")).alias("detail"))),
        F.when(some, F.struct(F.lit("pair_uniqueness").alias("check"), F.lit("uniqueness").alias("category"), F.when(F.col("repeated") > 0, "fail").otherwise("pass").alias("status"), F.concat(F.col("repeated").cast("string"), F.lit(" repeated pairs")).alias("detail"))),
        F.when(some & F.col("share").isNotNull(), F.struct(F.lit("min_count_distribution").alias("check"), F.lit("distribution").alias("category"), F.when(F.col("share") >= 0.95, "warn").otherwise("pass").alias("status"), F.concat(F.format_number(F.col("share") * 100, 1), F.lit("% below the minimum")).alias("detail"))),
    )
    rest = f.select(F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("c")).select(F.lit(table).alias("table"), "c.*")
    return spark.createDataFrame(rows, schema).unionByName(rest)


def check_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if(F.col("status") == "fail").alias("failed_checks"), F.count_if(F.col("status") == "warn").alias("warning_checks"), F.count_if(F.col("status") == "pass").alias("passed_checks"))


def pipeline_health(spark: SparkSession, checks: DataFrame, source: str, period: str, rows: dict[str, int], seconds: float = 0.0, notes: str = "") -> DataFrame:
    """One row on a run: failed where any check fails."""
    t = check_summary(checks)
    return t.select(
        F.expr("uuid()").alias("run_id"),
        F.current_timestamp().alias("run_timestamp"),
        F.lit(source).alias("source"),
        F.lit(period).alias("source_period"),
        F.when(F.col("failed_checks") > 0, "failed").otherwise("success").alias("status"),
        *(F.lit(int(rows.get(k, 0))).cast("long").alias(f"rows_{k}") for k in ("raw", "silver", "gold")),
        "failed_checks",
        "warning_checks",
        F.lit(float(seconds)).alias("duration_seconds"),
        F.lit(0.0).alias("estimated_cost_usd"),
        F.lit(notes).alias("notes"),
    )


def value_counts(t: DataFrame, column: str) -> DataFrame:
    return t.groupBy(column).agg(F.count("*").alias("n"))


def label_shares(flags: DataFrame) -> DataFrame:
    """(label_status, signals, percent)."""
    n = flags.groupBy("label_status").agg(F.count("*").alias("signals"))
    total = n.agg(F.sum("signals").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select("label_status", "signals", (100 * F.col("signals") / F.col("total")).alias("percent"))


def emerging_headline(emerging: DataFrame) -> DataFrame:
    """(signals, high, top_mover, top_change): the pair whose count changed most."""
    pair = F.struct(F.coalesce("percent_change", F.lit(-1e9)), DRUG, EVENT)
    return emerging.agg(F.count("*").alias("signals"), F.count_if(F.col("priority_level") == "High").alias("high"), F.max_by(F.concat_ws(" — ", DRUG, EVENT), pair).alias("top_mover"), F.max("percent_change").alias("top_change"))


def mean_relevance(evidence: DataFrame) -> DataFrame:
    return evidence.agg(F.avg("relevance_score").alias("mean_relevance"))
