"""Novelty of signals against label texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselens.config import LABEL_SECTIONS
from caselens.functions import text
from caselens.session import stored

DRUG, EVENT = "drug_name_normalized", "adverse_event"
FLAGS = ("labeled_event", "label_status", "novel_flag")
#: So many needles are broadcast at most, about 10 MB; more are joined by a shuffle. Fixed value.
FEW_NEEDLES = 200_000


def _rank() -> Column:
    """A section's place by severity, from 1."""
    return F.array_position(F.array(*(F.lit(s) for s in LABEL_SECTIONS)), F.col("section")).cast("int")


def merged_sections(labels: DataFrame) -> DataFrame:
    """(drug, section, rank, text): each section's lower-cased texts joined, by severity. All
    texts of a section become one string: for labels of a few texts each."""
    t = labels.filter(F.col("section").isin(*LABEL_SECTIONS) & F.col("text").isNotNull())
    parts = F.array_sort(F.collect_list(F.lower("text")))
    return t.groupBy("drug", "section").agg(F.array_join(parts, " ").alias("text")).withColumn("rank", _rank())


def _needles(events: DataFrame) -> DataFrame:
    """(event, variant, needle, needles, exact): what must stand inside the tokens of a text
    for a variant of the event to be named: all of its words over three letters; where it has
    none, its pieces between blanks, and, if these are several, the variant as it stands."""
    v = events.select(EVENT, F.explode(text.variants(F.col(EVENT))).alias("variant"))
    words = F.filter(F.regexp_extract_all("variant", F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 3)
    pieces = F.filter(F.split("variant", r"\s+"), lambda w: w != "")
    v = v.select(EVENT, "variant", F.array_distinct(words).alias("words"), pieces.alias("pieces"))
    all_of = F.when(F.size("words") > 0, F.col("words")).otherwise(F.array_distinct("pieces"))
    v = v.withColumns({"all_of": all_of, "exact": (F.size("words") == 0) & (F.size("pieces") > 1)})
    return v.select(EVENT, "variant", F.explode("all_of").alias("needle"), F.size("all_of").alias("needles"), "exact")


def _tokens(texts: DataFrame, separator: str, longest: int) -> DataFrame:
    """(d, section, token), distinct but for pieces: what stands between separators in the
    texts. Tokens far longer than the longest needle become pieces that overlap by its length
    less 1, so every part of that length is whole in one of them."""
    size = max(256, 2 * longest)
    # explode would have the array made twice, once for a filter on its size
    t = texts.select("d", "section", F.explode_outer(F.array_distinct(F.split("text", separator))).alias("token")).filter("token <> ''").distinct()
    starts = F.sequence(F.lit(1), F.length("token") - longest + 1, F.lit(size - longest + 1))
    pieces = F.transform(starts, lambda i: F.substring(F.col("token"), i, F.lit(size)))
    return t.select("d", "section", F.explode_outer(F.when(F.length("token") > size, pieces).otherwise(F.array("token"))).alias("token"))


def _holding(tokens: DataFrame, needles: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """(token, needle) where the needle is a part of the token: parts of the needles' lengths
    meet the needles by equality, so no token is tried against every needle."""
    t = tokens.select("token", F.explode(F.lit(lengths)).alias("n")).filter("n <= length(token)")
    t = t.select("token", "n", F.explode(F.expr("sequence(1, length(token) - n + 1)")).alias("i"))
    t = t.select("token", F.expr("substring(token, i, n)").alias("needle"))
    needles = needles.select("needle").distinct()
    return t.join(F.broadcast(needles) if small else needles, "needle").select("token", "needle")


def _as_it_stands(texts: DataFrame, maybe: DataFrame, reach: int, blanks: int) -> DataFrame:
    """(d, section, event) of those in maybe whose variant stands in its section's texts joined
    by blanks in their order. A variant of so many blanks stands in at most one text more than
    that, so each text is read after the ends of as many before it; texts are never joined whole."""
    of = texts.join(maybe.select("d", "section").distinct(), ["d", "section"], "left_semi")
    before = Window.partitionBy("d", "section").orderBy("text").rowsBetween(-blanks, -1)
    ends = F.collect_list(F.right("text", F.lit(reach))).over(before)
    read = of.select("d", "section", F.array_join(F.array_append(ends, F.col("text")), " ").alias("read"))
    return maybe.join(read, ["d", "section"]).filter(F.contains("read", F.col("variant"))).select("d", "section", EVENT)


def label_flags(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(drug, event, labeled_event, label_section, label_found, label_status, novel_flag).

    pairs: distinct (drug, event); labels: (drug, section, text). The most severe section
    that names the event counts. Names compare without case. An item without any label has
    an unknown status and is never novel.

    A section is all of a drug's texts under its name, which are never brought together: each
    becomes its distinct tokens (runs of letters, if no needle has anything else), and needles
    of the events are looked up in the distinct tokens of all texts once, so no text is read
    for each event. Only variants of several short pieces are looked for in the texts again.
    Needles and tokens are written once (`stored`).
    """
    texts = labels.filter(F.col("section").isin(*LABEL_SECTIONS) & F.col("text").isNotNull()).select(F.upper("drug").alias("d"), "section", F.lower("text").alias("text"))
    found = labels.select(F.upper("drug").alias("d")).distinct().withColumn("label_found", F.lit(True))
    p = pairs.select(DRUG, EVENT).distinct().withColumn("d", F.upper(DRUG))
    needles = stored(_needles(p.select(EVENT).distinct()), "needles")
    long, in_exact = F.length("needle"), lambda x: F.max(F.when(F.col("exact"), x))
    has = needles.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(long)).alias("lengths"),
        F.coalesce(F.bool_and(F.col("needle").rlike(r"^[a-z]+\z")), F.lit(True)).alias("letters"),
        in_exact(F.length("variant")).alias("reach"),
        in_exact(F.length("variant") - F.length(F.replace("variant", F.lit(" "), F.lit("")))).alias("blanks"),
    ).first()
    lengths = has["lengths"] or [1]
    tokens = stored(_tokens(texts, "[^a-z]+" if has["letters"] else r"\s+", lengths[-1]), "tokens")
    holding = _holding(tokens.select("token").distinct(), needles, lengths, has["n"] <= FEW_NEEDLES)
    held = tokens.join(holding, "token").select("d", "section", "needle").distinct()
    named = held.join(needles, "needle").groupBy("d", "section", EVENT, "variant", "needles", "exact").agg(F.count("*").alias("n")).filter("n = needles")
    hits = named.filter("not exact").select("d", "section", EVENT)
    if has["reach"]:
        maybe = named.filter("exact").select("d", "section", EVENT, "variant")
        hits = hits.unionByName(_as_it_stands(texts, maybe, has["reach"], max(1, has["blanks"])))
    best = hits.groupBy("d", EVENT).agg(F.min_by("section", _rank()).alias("label_section"))
    t = p.join(found, "d", "left").join(best, ["d", EVENT], "left")
    known, labeled = F.coalesce("label_found", F.lit(False)), F.col("label_section").isNotNull()
    status = F.when(~known, "unknown").when(labeled, "labeled").otherwise("novel")
    return t.select(DRUG, EVENT, labeled.alias("labeled_event"), "label_section", known.alias("label_found"), status.alias("label_status"), (known & ~labeled).alias("novel_flag"))


def fold_flags(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """scores with their label flags, unknown where there are none; folding again replaces."""
    t = scores.drop(*FLAGS).join(flags.select(DRUG, EVENT, *FLAGS), [DRUG, EVENT], "left")
    return t.fillna({"label_status": "unknown", "labeled_event": False, "novel_flag": False}, list(FLAGS))


def rxcui_by_key(dimension: DataFrame) -> DataFrame:
    """(analysis_key, rxcui): the largest code of a key, names without one left out."""
    return dimension.filter("ingredient_rxcui is not null").groupBy("analysis_key").agg(F.max("ingredient_rxcui").alias("rxcui"))
