"""Quality rules with host verdicts, in DataFrame operations alone.

Each text's statistics come from array functions over its own row: no text is shuffled. Rule
failures are counted by host, the hosts' failure rates are shrunk towards an empirical beta
prior (moments over all hosts), and a host fails with all of its documents when its posterior
says for sure that its documents fail far more often than the corpus's. Verdicts go back to
documents by a join whose hot hosts are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import SPACE, ready, table_columns
from caselens.session import stored

#: Words of a window whose repetition counts.
WINDOW = 5
#: Fixed limits of the base rules.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: A host fails when the lower end of its posterior failure rate, so many standard deviations
#: below the mean, has more than so many times the odds of the prior's mean.
HOST_DEVIATIONS = 2.0
HOST_ODDS = 4.0
#: Parts that each host's documents are dealt into, for counting and for the join.
SALTS = 64


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def text_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words).

    A null text has no words, symbols or lines. Repeated rows and null keys each give a row.
    """
    ready(docs.sparkSession)
    t = table_columns(docs, {"key": F.col(key), "host": F.col(host), "text": F.coalesce(F.col(text), F.lit(""))})
    t = t.select("key", "host", "text", words(F.col("text")).alias("w"))
    t = t.select(
        "key",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = F.expr(f"transform(slice(h, 1, greatest(size(h) - {WINDOW - 1}, 0)), (x, i) -> xxhash64(x, {', '.join(f'get(h, i + {k})' for k in range(1, WINDOW))}))")
    t = t.select("key", "host", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("v"))
    t = t.withColumn("some", F.size(F.array_distinct("v")) < F.size("v"))
    # windows by hash and place: those next to an equal one occur twice or more
    t = t.withColumn("by_hash", F.expr("case when some then sort_array(transform(v, (x, i) -> struct(x as h, i as p))) end"))
    again = F.expr("sort_array(transform(filter(transform(by_hash, (x, i) -> case when x.h = get(by_hash, i - 1).h or x.h = get(by_hash, i + 1).h then x.p end), p -> p is not null), p -> p))")
    t = t.withColumn("again", again)
    # each window adds its words beyond the next window's start
    covered = F.expr(f"aggregate(transform(again, (p, i) -> least({WINDOW}, coalesce(get(again, i + 1), p + {WINDOW}) - p)), 0L, (a, x) -> a + x)")
    return t.select(F.col("key").alias(key), F.col("host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def host_verdicts(counts: DataFrame, host: str, odds: float = HOST_ODDS) -> DataFrame:
    """(host, n, failed, rate, host_failed) from (host, n, failed).

    The prior is a beta distribution with the mean of the hosts' failure rates and the
    variance that is left of theirs without what chance alone gives hosts of their sizes.
    The posterior's mean is rate = (failed + a) / (n + a + b). Where no variance is left (one
    host, or rates as much alike as chance makes them) the prior weighs as much as a host has
    documents on average. No failures at all: no host fails.
    """
    each = F.col("failed") / F.col("n")
    moments = counts.agg(F.avg(each).alias("m"), F.coalesce(F.var_samp(each), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("chance"), F.avg("n").alias("size"))
    moments = moments.withColumn("s", F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("chance"))
    weight = F.when((F.col("s") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("s")), F.try_divide(F.col("m") * (1 - F.col("m")), F.col("s")) - 1).otherwise(F.col("size"))
    prior = moments.select("m", weight.alias("weight"))
    t = counts.crossJoin(F.broadcast(prior)).withColumn("rate", (F.col("failed") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight")))  # the prior is one row
    low = F.greatest(F.lit(0.0), F.col("rate") - HOST_DEVIATIONS * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1)))
    return t.withColumn("low", low).select(host, "n", "failed", "rate", (F.col("low") * (1 - F.col("m")) > odds * F.col("m") * (1 - F.col("low"))).alias("host_failed"))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", odds: float = HOST_ODDS) -> DataFrame:
    """The rules' statistics with base_failed, the host's documents, shrunken rate and
    verdict (host_n, host_rate, host_failed), and kept.

    kept: neither the document's base rules nor its host fails. Documents with a null host
    count as one host of their own; repeated rows count each. An empty table gives no rows.
    """
    t = text_rules(docs, key, text, host).withColumn("base_failed", base_failed())
    t = stored(t.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "rules")
    parts = t.groupBy(F.col(host).alias("of"), "salt").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    counts = parts.groupBy("of").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))
    verdicts = host_verdicts(counts, "of", odds).select("of", F.col("n").alias("host_n"), F.col("rate").alias("host_rate"), "host_failed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salted"))
    joined = t.join(verdicts, t[host].eqNullSafe(verdicts["of"]) & (t["salt"] == verdicts["salted"]))
    return joined.select(key, host, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_n", "host_rate", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    t = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_n", F.round("host_rate", 6).alias("host_rate"), "host_failed", "kept")


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
base AS (
  SELECT doc_id, source, w, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM words),
windows AS (
  SELECT doc_id, source, unnest(range(1, greatest(len(w) - 3, 1))) AS p,
         unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM base),
again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n >= 2),
repeated AS (
  SELECT doc_id, count(DISTINCT q)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM again) GROUP BY doc_id),
rules AS (
  SELECT b.doc_id, source, n_words, word_chars, n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed
  FROM base b LEFT JOIN repeated r ON b.doc_id = r.doc_id),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM rules GROUP BY source),
moments AS (
  SELECT avg(failed / n) AS m, coalesce(var_samp(failed / n), 0) AS v, avg(1 / n) AS chance, avg(n) AS size FROM hosts),
prior AS (
  SELECT m, CASE WHEN v - m * (1 - m) * chance > 0 AND m * (1 - m) > v - m * (1 - m) * chance
                 THEN m * (1 - m) / (v - m * (1 - m) * chance) - 1 ELSE size END AS weight FROM moments),
rates AS (
  SELECT source, n, m, weight, (failed + m * weight) / (n + weight) AS rate FROM hosts, prior),
verdicts AS (
  SELECT source, n, rate, m, greatest(0.0::DOUBLE, rate - 2 * sqrt(rate * (1 - rate) / (n + weight + 1))) AS low FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n::BIGINT AS host_n, round(rate, 6) AS host_rate,
       low * (1 - m) > 4 * m * (1 - low) AS host_failed, NOT base_failed AND NOT (low * (1 - m) > 4 * m * (1 - low)) AS kept
FROM rules r JOIN verdicts v ON r.source IS NOT DISTINCT FROM v.source
"""
