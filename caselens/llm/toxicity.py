"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives; other texts are unlabelled, toxic ones among them.
With the class prior p, the risk of a linear classifier is

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]),

whose second term estimates the risk over clean texts and is kept from going below zero;
where it does, steps go against it instead. Unlabelled texts are documents without a label.
Classifiers are numpy logistic models over words and word beginnings, each by how far its
count lies over what clean text of the same length holds, which can only speak for toxicity:
weights stay at 0 or above. A few models, each on its own part of the unlabelled texts, are
averaged. A text counts as toxic from the margin at which the same risk, under the zero-one
loss, is least over the sample.

A text is scored from its distinct words: a word's features are found once for each task,
and words without a weight cost a look-up.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.llm.common import each_table, gathered, ready, table_columns
from caselens.llm.quality import is_held_out
from caselens.session import stored

#: Bounds of the sample that models are fitted on: toxic and unlabelled documents.
POSITIVES = 1_500
UNLABELLED = 4_500
#: The choice of features, from that sample alone; every text is scored by all that are chosen.
#: Features that are looked at, at most, and sampled documents that one must occur in.
FEATURES = 1_500
LEAST_DOCUMENTS = 4
#: A feature is looked at when positives hold it this many times as often as others.
LEAST_RATIO = 8.0
#: Features that positives hold less than this many times as often are not looked at at all.
MOST_COMMON = 1.5
#: Share of the positives that a feature must occur in, and newly cover; features for each.
LEAST_SHARE = 0.005
COVER = 6
#: Excess from which a document counts as holding a feature.
HIGH = 0.7
#: Excess may count from each of these on: words that clean texts hold by chance tell
#: something only where they are many.
LEVELS = (0.0, 0.9, 1.8)
BEGINNINGS = (4, 5, 6, 7, 8)
MODELS = 3
#: Distinct words that a worker remembers.
REMEMBERED = 200_000

_letters = re.compile(r"[^\W\d_]+").findall


def word_features(run: str) -> tuple[int, ...]:
    """Hashes of the words in a run without white space, and of their beginnings."""
    out = []
    for w in _letters(run.lower()):
        out.append(xxhash.xxh32_intdigest(w))
        out += [xxhash.xxh32_intdigest(f"^{w[:n]}") for n in BEGINNINGS if len(w) >= n]
    return tuple(out)


class Runs:
    """Features of runs without white space, remembered; with `wanted`, only those, by place."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted, self.known = wanted, {}

    def counts(self, text: str) -> tuple[int, dict[int, int]]:
        """Runs in the text, and how many of them hold each feature."""
        known, out, runs = self.known, {}, text.split()
        for run, n in Counter(runs).items():
            if (f := known.get(run)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                f = word_features(run)
                if self.wanted is not None:
                    f = tuple(self.wanted[x] for x in f if x in self.wanted)
                known[run] = f
            for x in f:
                out[x] = out.get(x, 0) + n
        return len(runs), out


def excess(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """How far a count lies over what clean text of that length would hold; 0 at least."""
    return np.maximum(np.log((count + 0.5) / (expected + 0.5)), 0)


@dataclass(frozen=True)
class Model:
    """features: a hash's place; rates: their share of a clean text's runs; weights: a row for
    each of LEVELS; a logistic score of how far the features' excess lies over each level."""

    features: dict[int, int]
    rates: np.ndarray
    weights: np.ndarray
    intercept: float

    def margin(self, text: str, runs: Runs) -> float:
        n, found = runs.counts(text)
        if not found:
            return self.intercept
        at = list(found)
        over = excess(np.array(list(found.values()), dtype=float), n * self.rates[at])
        return self.intercept + sum(float(w[at] @ np.maximum(over - level, 0)) for level, w in zip(LEVELS, self.weights))

    def scores(self, texts: list[str], runs: Runs) -> np.ndarray:
        z = np.array([self.margin(t, runs) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass(frozen=True)
class Sample:
    """Sampled documents: their runs, and (document, feature, count) of all their features."""

    runs: np.ndarray
    toxic: np.ndarray
    document: np.ndarray
    feature: np.ndarray
    count: np.ndarray


def chosen_features(s: Sample, prior: float, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, their rates in clean text, their levels, the documents' excess over them).

    What clean texts hold is estimated without clean labels: what unlabelled texts hold less
    the prior's share of what positives do. Of the features that are in excess far more
    often among positives, those are taken that cover the positives, COVER times each where
    possible: words that merely stand in copies of one toxic text cover nothing new.
    """
    positives, others = int(s.toxic.sum()), max(int((~s.toxic).sum()), 1)
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * positives)
    of_toxic = s.toxic[s.document]
    values, n_docs = np.unique(s.feature[of_toxic], return_counts=True)
    values = values[n_docs >= least]
    at = np.minimum(np.searchsorted(values, s.feature), max(len(values) - 1, 0)).astype(np.int32)
    keep = np.flatnonzero(values[at] == s.feature) if len(values) else np.zeros(0, int)
    at, doc, count, of_toxic = at[keep], s.document[keep], s.count[keep].astype(np.float32), of_toxic[keep]

    def share(which: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return np.bincount(at[which], count[which], minlength=len(values)) / max(float(s.runs[docs].sum()), 1.0)

    rates = np.maximum(share(~of_toxic, ~s.toxic) - prior * share(of_toxic, s.toxic), 0) / max(1 - prior, 1e-9)
    over = excess(count, (s.runs[doc] * rates[at]).astype(np.float32))
    more = over > 0  # the rest counts for nothing
    at, doc, of_toxic, over = at[more], doc[more], of_toxic[more], over[more]
    at = np.concatenate([at + np.int32(k * len(values)) for k in range(len(LEVELS))])  # a column for each feature and level
    over = np.concatenate([np.maximum(over - np.float32(level), 0) for level in LEVELS])
    doc, of_toxic, columns = np.tile(doc, len(LEVELS)), np.tile(of_toxic, len(LEVELS)), len(values) * len(LEVELS)
    high = over > HIGH
    n_pos = np.bincount(at[high & of_toxic], minlength=columns)
    n_unl = np.bincount(at[high & ~of_toxic], minlength=columns)
    rate = n_pos / max(positives, 1)
    clean = np.maximum(n_unl / others - prior * rate, 0) / max(1 - prior, 1e-9)
    good = np.flatnonzero((n_pos >= least) & (rate >= LEAST_RATIO * (clean + 0.5 / others)))
    good = good[np.argsort(-(rate - clean)[good], kind="stable")][:most]
    place = np.full(columns, -1)
    place[good] = np.arange(len(good))
    rows = high & of_toxic & (place[at] >= 0)
    number = np.cumsum(s.toxic) - 1
    holds = np.zeros((len(good), positives), dtype=bool)
    holds[place[at[rows]], number[doc[rows]]] = True
    alike = {holds[k].tobytes(): k for k in reversed(range(len(good)))}
    left, need, taken = set(alike.values()), np.full(positives, COVER), []
    while left:
        order = sorted(left)
        gain = (holds[order] & (need > 0)).sum(axis=1)
        worth = gain / positives - 3 * clean[good[order]]
        best = int(np.argmax(worth))
        if gain[best] < least or worth[best] <= 0:
            break
        taken.append(order[best])
        need = need - holds[order[best]]
        left.discard(order[best])
    taken = good[taken] if taken else np.zeros(0, int)
    place = np.full(columns, -1)
    place[taken] = np.arange(len(taken))
    rows = place[at] >= 0
    x = np.zeros((len(s.runs), len(taken)))
    x[doc[rows], place[at[rows]]] = over[rows]
    of, level = (taken % len(values), taken // len(values)) if len(values) else (taken, taken)
    return values[of], rates[of], level, x


def risk_parts(x: np.ndarray, toxic: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(p E_pos[l(g)], E_unl[l(-g)] - p E_pos[l(-g)], and their gradients in (w, b)) under the
    logistic loss; the risk is the first and the second where that is positive."""
    xp, xu = x[toxic], x[~toxic]
    zp, zu = xp @ w + b, xu @ w + b
    up, uu = 1 / (1 + np.exp(-np.clip(zp, -35, 35))), 1 / (1 + np.exp(-np.clip(zu, -35, 35)))
    found = prior * np.logaddexp(0, -zp).mean()
    clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    to_found = prior * np.append(xp.T @ (up - 1) / len(zp), (up - 1).mean())
    to_clean = np.append(xu.T @ uu / len(zu) - prior * xp.T @ up / len(zp), uu.mean() - prior * up.mean())
    return float(found), float(clean), to_found, to_clean


def nonnegative_pu(x: np.ndarray, toxic: np.ndarray, prior: float, rng: np.random.Generator, steps: int = 700, rate: float = 0.03, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights, none below 0, and intercept that minimise the non-negative risk, by adaptive
    gradient steps over batches that hold both kinds."""
    pos, unl = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    k = x.shape[1]
    t, first, second, step = np.append(np.zeros(k), -1.0), np.zeros(k + 1), np.zeros(k + 1), 0
    parts = max(1, min(len(pos), len(unl)) // 200)
    for _ in range(-(-steps // parts)):
        for p_rows, u_rows in zip(np.array_split(rng.permutation(pos), parts), np.array_split(rng.permutation(unl), parts)):
            if not len(p_rows) or not len(u_rows):
                continue
            rows = np.concatenate([p_rows, u_rows])
            _, clean, to_found, to_clean = risk_parts(x[rows], toxic[rows], prior, t[:k], t[k])
            slope = to_found + to_clean + decay * np.append(t[:k], 0) if clean >= 0 else -to_clean
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            t = t - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
            t[:k] = np.maximum(t[:k], 0)
    return t[:k], float(t[k])


def fitted(s: Sample, prior: float, seed: int = 11) -> Model:
    """No positives, no unlabelled texts, or nothing that tells them apart: a model that finds
    nothing."""
    features, rates, levels, x = chosen_features(s, prior)
    if not len(features):
        return Model({}, np.zeros(1), np.zeros((len(LEVELS), 1)), -4.0)
    rng, models = np.random.default_rng(seed), []
    for _ in range(MODELS):
        part = s.toxic | (rng.random(len(s.toxic)) < 0.7)
        models.append(nonnegative_pu(x[part], s.toxic[part], prior, rng))
    w, b = np.mean([m[0] for m in models], axis=0), float(np.mean([m[1] for m in models]))
    names, first, place = np.unique(features, return_index=True, return_inverse=True)
    weights = np.zeros((len(LEVELS), len(names)))
    weights[levels, place] = w
    return Model({int(f): i for i, f in enumerate(names)}, rates[first], weights, b - decided(x @ w + b, s.toxic, prior))


def decided(margins: np.ndarray, toxic: np.ndarray, prior: float) -> float:
    """The margin from which a text counts as toxic: where the non-negative risk under the
    zero-one loss, p P_pos[below] + max(0, P_unl[above] - p P_pos[above]), is least over the
    sample; the highest such margin, and the middle of the gap below it. The logistic loss
    orders texts well, but its zero also weighs by how much texts are off."""
    cuts = np.unique(margins)
    above = np.array([1 - np.searchsorted(np.sort(margins[kind]), cuts) / max(int(kind.sum()), 1) for kind in (toxic, ~toxic)])
    risk = prior * (1 - above[0]) + np.maximum(above[1] - prior * above[0], 0)
    best = int(np.flatnonzero(risk <= risk.min() + 1e-12)[-1])
    return float(cuts[best] + cuts[best - 1]) / 2 if best else float(cuts[0])


def sample_for_fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held_out, positives: int, unlabelled: int) -> tuple[Sample, float]:
    """The sampled documents' features, and the prior.

    At most `positives` keys with a toxic label and `unlabelled` keys of other documents, by
    the order of a hash; none of the held-out fold. Documents without a label come first
    among the unlabelled; where these are too few, labelled ones follow, whose labels are not
    looked at. A key is one row, of several texts the smallest. The prior is the share of
    toxic rows among all labelled ones outside the fold.
    """
    marks = labels.select(F.col(key).alias(key), F.col(label).cast("int").alias("y")).filter(F.col(key).isNotNull() & F.col("y").isNotNull()).groupBy(key).agg(F.max("y").alias("y"))
    prior = float(marks.filter(~held_out).agg(F.avg("y")).first()[0] or 0.0)
    toxic = marks.filter(~held_out & (F.col("y") == 1)).orderBy(F.xxhash64(F.col(key).cast("string"))).limit(positives)
    known = marks.select(F.col(key).alias("of"), F.lit(1).alias("known"))
    others = docs.select(F.col(key).alias(key)).filter(F.col(key).isNotNull()).distinct().join(known, F.col(key) == F.col("of"), "left").filter(F.col("known").isNull() | ~held_out)
    others = others.orderBy(F.col("known").asc_nulls_first(), F.xxhash64(F.concat_ws("-", F.lit("u"), F.col(key).cast("string")))).limit(unlabelled)
    ids = toxic.select(F.col(key).alias("of"), "y").unionByName(others.select(F.col(key).alias("of"), F.lit(0).alias("y")))
    rows = table_columns(docs, {"key": F.col(key), "text": F.coalesce(F.col(text), F.lit(""))}).join(F.broadcast(ids), F.col("key") == F.col("of"))  # bounded by the two parameters
    rows = stored(rows.groupBy("key", "y").agg(F.min("text").alias("text")), "sample")  # one row a key, however often it is repeated

    def held(batches):
        for t in gathered(batches):
            runs = Runs()
            found = [list(runs.counts(text)[1]) for text in t["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.int64()), pa.array(np.repeat(t["y"].to_numpy(), [len(f) for f in found]), pa.int32())], ["feature", "y"])

    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    least, n_pos, n_unl = max(LEAST_DOCUMENTS, LEAST_SHARE * size.get(1, 0)), max(size.get(1, 0), 1), max(size.get(0, 0), 1)
    common = rows.select("text", "y").mapInArrow(held, "feature long, y int").groupBy("feature").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("unl"))
    clean = (F.col("unl") / n_unl - prior * F.col("pos") / n_pos) / max(1 - prior, 1e-9)
    common = common.filter((F.col("pos") >= least) & (F.col("pos") / n_pos >= MOST_COMMON * clean))
    wanted = {r[0]: r[0] for r in common.select("feature").collect()}  # each in at least LEAST_SHARE of the positives, and rarer elsewhere

    def run(t: pa.Table) -> pa.Table:
        runs, out = Runs(wanted), ([], [], [])
        for n, found in map(runs.counts, t["text"].to_pylist()):
            for column, v in zip(out, (n, np.array(list(found), dtype="<u4").tobytes(), np.array(list(found.values()), dtype="<u4").tobytes())):
                column.append(v)
        return pa.table([t["key"], t["y"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["key", "y", "runs", "features", "counts"])

    found = rows.select("key", "y", "text").mapInArrow(each_table(run), f"key {rows.schema['key'].dataType.simpleString()}, y int, runs long, features binary, counts binary").toPandas().sort_values(["y", "key"], kind="stable")
    size = [len(f) // 4 for f in found["features"]]
    return Sample(found["runs"].to_numpy(), found["y"].to_numpy() == 1, np.repeat(np.arange(len(size), dtype=np.int32), size), np.frombuffer(b"".join(found["features"]), "<u4"), np.frombuffer(b"".join(found["counts"]), "<u4")), prior


def with_score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", parts: int = 5, part: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """(row, score): each row of docs whole, as a struct, and its text's score.

    Null and empty texts hold no features and get the intercept's score. A null key is in no
    held-out fold and never labelled. Repeated rows are scored each; an empty table gives no
    rows. Labels, languages, sources and keys are no inputs of the score.
    """
    spark = ready(docs.sparkSession)
    model = spark.sparkContext.broadcast(fitted(*sample_for_fit(docs, labels, key, text, label, is_held_out(key, parts, part), positives, unlabelled)))  # at most FEATURES weights

    def run(batches):
        runs = Runs(model.value.features)
        for t in gathered(batches):
            scores = model.value.scores([x or "" for x in pc.struct_field(t["row"], text).to_pylist()], runs)
            yield from pa.table([t["row"], pa.array(scores, pa.float64())], ["row", "score"]).to_batches()

    t = docs.select(F.struct("*").alias("row"))
    return t.mapInArrow(run, T.StructType([t.schema["row"], T.StructField("score", T.DoubleType())]))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that do not count as toxic, as they are. Null and empty texts stay;
    repeated rows and rows with a null key are judged each by its own text; where no label
    says toxic all stay; an empty table stays empty; other columns come through."""
    return with_score(docs, labels).filter(F.col("score") < 0.5).select("row.*")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = with_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("row.doc_id", "score")
    return t.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
