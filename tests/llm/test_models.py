import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import quality, toxicity


def held_out(i, parts, part):
    return zlib.crc32(str(i).encode()) % parts == part


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows, marks = [], []
    for i in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 120))).capitalize() + "."
        bad, toxic = rng.random() < 0.2, rng.random() < 0.15
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w + "$$$" for w in text.split()), " ".join([text.split()[0]] * 60)])
        if toxic:
            parts = text.split(" ")
            for _ in range(rng.randint(1, 4)):
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(["Zoxxon", "krulpid,", "vlimmeron", "vlimmerat"]))
            text = " ".join(parts)
        rows.append((i, text))
        marks.append((i, int(not bad), int(toxic)))
    return rows, marks


def tables(spark, corpus):
    rows, marks = corpus
    extra = [(5000, None), (5001, ""), (5002, "x" * 100_000), (None, "no key"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumns({"score": F.lit("s"), "upper": F.lit(1), "key": F.lit(2), "y": F.lit(0), "row": F.lit("r")})
    labels = spark.createDataFrame(marks + [(7, None, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, len(rows) + len(extra)


def test_quality(spark, corpus):
    docs, labels, n = tables(spark, corpus)
    got = quality.with_score(docs, labels).select("row.doc_id", "score").toPandas()
    assert len(got) == n and got.score.between(0, 1).all()
    truth = {i: q for i, q, _ in corpus[1]}
    held = got[[i == i and int(i) in truth and held_out(int(i), 3, 1) for i in got.doc_id]]
    assert np.mean([(s >= 0.5) == truth[int(i)] for i, s in zip(held.doc_id, held.score)]) > 0.95
    assert quality.kept(docs, labels).columns == docs.columns
    assert quality.with_score(docs.limit(0), labels).count() == 0
    assert (quality.with_score(docs.limit(5), labels.limit(0)).toPandas().score > 0.5).all()  # nothing learned: all stay


def test_held_out_labels_are_never_learned(spark, corpus):
    docs, labels, _ = tables(spark, corpus)
    fold = F.crc32(F.col("doc_id").cast("string"))
    wrong = labels.withColumn("quality", F.when(fold % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(fold % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    some = docs.filter("doc_id < 60")
    for module in (quality, toxicity):
        a, b = (module.with_score(docs, m).filter("row.doc_id < 60").select("row.doc_id", "score").distinct().toPandas().sort_values("doc_id").score.to_numpy() for m in (labels, wrong))
        assert a == pytest.approx(b, abs=1e-9)
    assert some.count()


def test_rules_in_columns_score_as_on_the_driver(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 10))
    y = (x[:, 0] > 0.5) & (x[:, 3] <= 0.7)
    model = quality.fitted(x, y.astype(int))
    assert model.weighted and ((model.score(x) >= 0.5) == y).mean() > 0.95
    t = spark.createDataFrame(x.tolist(), ", ".join(f"{s} double" for s in quality.STATISTICS))
    assert [r[0] for r in t.select(model.column()).collect()] == pytest.approx(model.score(x).tolist())
    assert quality.fitted(x, np.ones(400, int)).score(x).min() > 0.5 and quality.fitted(x, np.zeros(400, int)).score(x).max() < 0.5


def test_lasso_leaves_rules_out():
    rng = np.random.default_rng(2)
    r = (rng.random((500, 30)) < 0.5).astype(float)
    _, w = quality.lasso(r, (r[:, 4] > 0).astype(float), 0.02)
    assert abs(w[4]) > 1 and (np.abs(np.delete(w, 4)) < 0.05).all()


def test_toxicity(spark, corpus):
    docs, labels, n = tables(spark, corpus)
    got = toxicity.with_score(docs, labels).select("row.doc_id", "score").toPandas()
    assert len(got) == n and got.score.between(0, 1).all()
    truth = {i: t for i, _, t in corpus[1]}
    held = [(int(i), s) for i, s in zip(got.doc_id, got.score) if i == i and int(i) in truth and held_out(int(i), 5, 0)]
    assert np.mean([(s >= 0.5) == truth[i] for i, s in held]) > 0.93
    empties = got[[i in (5000, 5001) for i in got.doc_id]]
    assert (empties.score < 0.5).all()
    assert toxicity.kept(docs, labels).columns == docs.columns
    assert toxicity.with_score(docs.limit(0), labels).count() == 0
    assert (toxicity.with_score(docs.limit(5), labels.limit(0)).toPandas().score < 0.5).all()


def test_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(3)
    n = 600
    toxic = np.arange(n) < 200
    hidden = toxic | (rng.random(n) < 0.2)  # toxic ones among the unlabelled
    x = np.column_stack([hidden * (rng.random(n) < 0.9), rng.random(n) < 0.5]).astype(float)
    w, b = toxicity.nonnegative_pu(x, toxic, 0.2, rng)
    assert w[0] > 1 and abs(w[1]) < w[0] / 2
    assert np.isfinite(b)


def brute_risk(x, toxic, prior, w, b):
    """p E_pos[l(g)] and E_unl[l(-g)] - p E_pos[l(-g)], a document at a time."""
    loss = lambda z: math.log1p(math.exp(-z)) if z > -30 else -z
    z = [sum(a * c for a, c in zip(row, w)) + b for row in x]
    pos, unl = [v for v, t in zip(z, toxic) if t], [v for v, t in zip(z, toxic) if not t]
    mean = lambda v: sum(v) / len(v)
    return prior * mean([loss(v) for v in pos]), mean([loss(-v) for v in unl]) - prior * mean([loss(-v) for v in pos])


def test_risk_and_gradients_by_brute_force():
    rng = np.random.default_rng(5)
    x, toxic = rng.random((60, 3)), rng.random(60) < 0.4
    for _ in range(5):
        t = rng.normal(size=4) * 3
        found, clean, to_found, to_clean = toxicity.risk_parts(x, toxic, 0.3, t[:3], t[3])
        assert (found, clean) == pytest.approx(brute_risk(x, toxic, 0.3, t[:3], t[3]))
        for k in range(4):
            d = np.eye(4)[k] * 1e-6
            up, down = (brute_risk(x, toxic, 0.3, *((t + s * d)[:3], (t + s * d)[3])) for s in (1, -1))
            assert [to_found[k], to_clean[k]] == pytest.approx([(u - v) / 2e-6 for u, v in zip(up, down)], abs=1e-6)


def test_fit_comes_near_the_least_risk():
    """One feature: against all weights and intercepts of a grid."""
    rng = np.random.default_rng(6)
    toxic = np.arange(900) < 300
    hidden = toxic | (rng.random(900) < 0.25)
    x = np.where(hidden, rng.normal(1.5, 0.5, 900), rng.normal(0.3, 0.5, 900)).clip(0)[:, None]
    whole = lambda w, b: (lambda r: r[0] + max(0.0, r[1]))(toxicity.risk_parts(x, toxic, 0.25, np.array([w]), b)[:2])
    best = min(whole(w, b) for w in np.linspace(0, 12, 49) for b in np.linspace(-14, 2, 65))
    w, b = toxicity.nonnegative_pu(x, toxic, 0.25, rng)
    assert whole(w[0], b) <= best + 0.02 and w[0] > 1
    assert whole(w[0], b) < 0.5 * whole(0.0, -1.0)


def test_decision_by_brute_force():
    rng = np.random.default_rng(7)
    toxic = np.arange(300) < 100
    z = np.where(toxic | (rng.random(300) < 0.2), rng.normal(2, 1, 300), rng.normal(-1, 1, 300)).round(1)
    risk = lambda t: 0.2 * (z[toxic] < t).mean() + max(0.0, (z[~toxic] >= t).mean() - 0.2 * (z[toxic] >= t).mean())
    least = min(map(risk, z))
    t = toxicity.decided(z, toxic, 0.2)
    assert risk(t) == pytest.approx(least) and all(risk(v) > least + 1e-12 for v in z if v > t + 0.2 and risk(v) != risk(t))
    assert toxicity.decided(np.array([-2.0, -1.0, 3.0, 3.5]), np.array([False, False, True, True]), 0.3) == 1.0


@pytest.fixture(scope="module")
def test_table(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def of_held_out(df, labels, label, parts, part):
    got = df.toPandas().merge(labels.toPandas(), on="doc_id")
    got = got[[held_out(i, parts, part) for i in got.doc_id]]
    return got.score >= 0.5, got[label] == 1


def test_toxicity_of_held_out_labels(spark, test_table):
    docs, labels = test_table
    found, toxic = of_held_out(toxicity.with_score(docs, labels).select("row.doc_id", "score"), labels, "toxic", 5, 0)
    assert (found & toxic).sum() / toxic.sum() >= 0.9 and (found & toxic).sum() / found.sum() >= 0.9


def test_quality_of_held_out_labels(spark, test_table):
    docs, labels = test_table
    found, good = of_held_out(quality.with_score(docs, labels).select("row.doc_id", "score"), labels, "quality", 3, 1)
    assert (found == good).mean() >= 0.99


def test_a_key_of_many_rows_is_one_row_of_the_sample(spark, corpus):
    rows, marks = corpus
    often = next(i for i, _, t in marks if t and not held_out(i, 5, 0) and not held_out(i, 3, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.unionByName(spark.range(20_000).select(F.lit(often).cast("long").alias("doc_id"), F.concat(F.lit("zz "), F.col("id").cast("string")).alias("text")))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    sample, prior = toxicity.sample_for_fit(docs, labels, "doc_id", "text", "toxic", quality.is_held_out("doc_id", 5, 0), 1500, 4500)
    learned = [t for i, _, t in marks if not held_out(i, 5, 0)]
    assert prior == pytest.approx(sum(learned) / len(learned)) and sample.toxic.sum() == sum(learned)
    assert len(sample.runs) == sum(learned) + len(learned)  # no document lacks a label here


def test_documents_without_a_label_come_first_among_the_unlabelled(spark):
    docs = spark.createDataFrame([(i, f"text{i} a") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    sample, _ = toxicity.sample_for_fit(docs, labels, "doc_id", "text", "toxic", quality.is_held_out("doc_id", 5, 0), 1500, 150)
    assert (~sample.toxic).sum() == 150 and sample.toxic.sum() == sum(i % 4 == 0 and not held_out(i, 5, 0) for i in range(200))
    for share in (0, 1):  # none toxic, and all of them
        same = labels.withColumn("toxic", F.lit(share))
        assert toxicity.with_score(docs, same).filter("score between 0 and 1").count() == 400
