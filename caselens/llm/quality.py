"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are column expressions over each whole text. Shallow trees are grown by gradient
boosting on a bounded sample of labelled rows; every path from a root to a node of a tree is
a conjunctive rule. Lasso logistic regression picks few rules and their weights, and the
rules are compiled into one Spark column expression that scores every document.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import ready, table_columns
from caselens.llm.rules import words

#: Labelled rows that the trees and weights are fitted on, at most.
SAMPLE = 10_000
TREES = 40
DEPTH = 3
LASSO = 0.001
#: Below this score a document is rejected.
THRESHOLD = 0.5


# -- statistics -------------------------------------------------------------------------------


def statistics(text: str) -> dict[str, Column]:
    """Statistics of a text column by name; a null text counts as empty."""
    t, w = F.coalesce(F.col(text), F.lit("")), F.col("_w")
    n_chars, n_words = F.length(t), F.size(w)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def chars(kept: str) -> Column:
        return F.length(F.regexp_replace(t, f"[^{kept}]++", ""))

    lines = F.size(F.split(t, "\n"))
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "mean_word": share(F.length(F.array_join(w, "")), n_words),
        "distinct_words": share(F.size(F.array_distinct(w)), n_words),
        "upper": share(chars(r"\p{Lu}"), n_chars),
        "shouts": share(chars("!?"), n_words),
        "pipes": share(chars("|"), n_words),
        "symbols": share(chars(r"#*$%&<>{}~^\\[\\]@"), n_words),
        "stops": share(chars(".,;:"), n_words),
        "digits": share(chars("0-9"), n_chars),
        "lines": share(lines, n_words),
    }


STATISTICS = ("log_words", "mean_word", "distinct_words", "upper", "shouts", "pipes", "symbols", "stops", "digits", "lines")


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """(row, statistics): each input row whole, as a struct, with its text's statistics."""
    t = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.select("row", "text", words(F.col("text")).alias("_w"))
    stats = statistics("text")
    return t.select("row", *(stats[s].alias(s) for s in STATISTICS))


# -- trees, rules and weights, on the driver from the bounded sample ----------------------------


@dataclass(frozen=True)
class Rule:
    """All of (statistic, whether over, limit)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for j, over, limit in self.terms:
            out &= (x[:, j] > limit) if over else (x[:, j] <= limit)
        return out

    def column(self, names: tuple[str, ...]) -> Column:
        return functools.reduce(operator.and_, [(F.col(names[j]) > limit) if over else (F.col(names[j]) <= limit) for j, over, limit in self.terms])


def grown_paths(x: np.ndarray, residual: np.ndarray, limits: list[np.ndarray], depth: int, path: tuple = ()) -> list[tuple[tuple, float]]:
    """(terms, mean residual) of each node below the root of a least-squares tree."""
    if depth == 0 or len(x) < 20:
        return []
    best, choice, total, n = 1e-9, None, residual.sum(), len(x)
    for j, cuts in enumerate(limits):
        bins = np.searchsorted(cuts, x[:, j], side="left")  # x <= cuts[k] for bins <= k
        count = np.cumsum(np.bincount(bins, minlength=len(cuts) + 1))[:-1]
        low = np.cumsum(np.bincount(bins, residual, minlength=len(cuts) + 1))[:-1]
        fit = (count >= 10) & (n - count >= 10)
        gain = np.where(fit, low**2 / np.maximum(count, 1) + (total - low) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
        if len(gain) and gain.max() > best:
            best, choice = float(gain.max()), (j, float(cuts[int(gain.argmax())]))
    if choice is None:
        return []
    j, limit = choice
    out = []
    for over in (False, True):
        rows = (x[:, j] > limit) == over
        terms = (*path, (j, over, limit))
        out.append((terms, float(residual[rows].mean())))
        out += grown_paths(x[rows], residual[rows], limits, depth - 1, terms)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 1500) -> tuple[float, np.ndarray]:
    """Intercept and weights of L1-penalised logistic regression, by accelerated proximal
    gradient steps."""
    n, k = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    rate = 4.0 / max(float(np.linalg.eigvalsh(a.T @ a)[-1]) / n, 1e-9)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -35, 35)))
        step = v - rate * (a.T @ (p - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if ((new - w) @ (v - new)) > 0:  # restart where momentum points uphill
            v, t2 = new, 1.0
        else:
            v = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-6:
            w = new
            break
        w, t = new, t2
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def column(self, names: tuple[str, ...] = STATISTICS) -> Column:
        """The score as a column expression over columns of the statistics."""
        total = functools.reduce(operator.add, [F.when(r.column(names), float(w)).otherwise(0.0) for r, w in self.weighted], F.lit(float(self.intercept)))
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * r.holds(x) for r, w in self.weighted), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def fitted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO, seed: int = 7) -> RuleEnsemble:
    """One class alone, or no rows: a constant score of that class, or of 1."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(4.0 if not len(y) or y.max() == 1 else -4.0, ())
    rng = np.random.default_rng(seed)
    limits = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 48), method="lower")) for c in x.T]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    margin, paths = np.zeros(len(y)), {}
    for _ in range(trees):
        rows = rng.random(len(y)) < 0.5
        cols = rng.random(x.shape[1]) < 0.7
        residual = weight * (y - 1 / (1 + np.exp(-margin)))
        if rows.sum() < 40 or not cols.any():
            continue
        found = grown_paths(x[rows], residual[rows], [c if on else c[:0] for c, on in zip(limits, cols)], depth)
        inner = {t[:-1] for t, _ in found}
        for terms, value in found:
            paths.setdefault(frozenset(terms), terms)
            if terms not in inner:
                margin = margin + 0.5 * value * Rule(terms).holds(x)
    rules = [Rule(t) for t in paths.values()]
    held: dict[bytes, tuple[Rule, np.ndarray]] = {}  # one rule of those that hold for the same rows
    for rule in map(Rule, paths.values()):
        if 0 < (h := rule.holds(x)).sum() < len(y):
            held.setdefault(np.packbits(h).tobytes(), (rule, h))
    if not held:
        return RuleEnsemble(0.0, ())
    intercept, w = lasso(np.column_stack([h for _, h in held.values()]).astype(float), y.astype(float), penalty)
    return RuleEnsemble(intercept, tuple((rule, float(v)) for (rule, _), v in zip(held.values(), w) if abs(v) > 1e-4))


# -- the operator ------------------------------------------------------------------------------


def is_held_out(key: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def ensemble_from(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held_out: Column, sample: int = SAMPLE) -> RuleEnsemble:
    """The ensemble for labelled rows outside the held-out fold; at most `sample` keys by the
    order of a hash, each one row, of several texts the smallest. Null labels and keys are
    left out."""
    marks = labels.select(F.col(key).alias(key), F.col(label).cast("int").alias("y")).filter(F.col(key).isNotNull() & F.col("y").isNotNull()).groupBy(key).agg(F.max("y").alias("y")).filter(~held_out)
    marks = marks.orderBy(F.xxhash64(F.col(key).cast("string"))).limit(sample).select(F.col(key).alias("of"), "y")
    rows = table_columns(docs, {"key": F.col(key), "text": F.col(text)}).join(F.broadcast(marks), F.col("key") == F.col("of"))  # bounded by the parameter
    rows = rows.groupBy("key", "y").agg(F.min("text").alias("text"))  # one row a key, however often it is repeated
    rows = with_statistics(rows.select("y", "text"), "text").select("row.y", *STATISTICS).toPandas()
    return fitted(rows[list(STATISTICS)].to_numpy(dtype=float), rows["y"].to_numpy())


def with_score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", parts: int = 3, part: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(row, score): each row of docs whole, as a struct, and its text's score.

    Null and empty texts have statistics of 0 and a score like any other. A null key is in
    no held-out fold and never labelled. Repeated rows are scored each; an empty table gives
    no rows. Labels, languages, sources and keys are no inputs of the score.
    """
    ready(docs.sparkSession)
    score = ensemble_from(docs, labels, key, text, label, is_held_out(key, parts, part), sample).column()
    once = F.when(F.monotonically_increasing_id() >= 0, score)  # not deterministic: a filter on it is not rewritten over the statistics, once for each use
    return with_statistics(docs, text).select("row", once.alias("score"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, as they are. Null and empty texts
    are judged by statistics of 0; repeated rows and rows with a null key each by its own
    text; without labels all stay; an empty table stays empty; other columns come through."""
    return with_score(docs, labels).filter(F.col("score") >= THRESHOLD).select("row.*")


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = with_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("row.doc_id", "score")
    return t.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
