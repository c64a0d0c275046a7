import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.llm import embed_dedup, ngram_join
from caselens.llm.common import components, order_for, roots, through


def reached(n, links):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng, n = random.Random(3), 300
    links = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(200)], "chain": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "none": []}[kind]
    rng.shuffle(links)
    t = spark.createDataFrame(links + [(5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(t, "a", "b").collect()}
    want = reached(n, links)
    assert got == {i: want[i] for i in {x for ab in links for x in ab if ab[0] != ab[1]}}
    assert roots(n, np.array(links, dtype=int).reshape(-1, 2)).tolist() == want


def linked_by_hand(rows):
    """(key, n_links, component) of every row, by all pairs."""
    def good(k, v):
        return k is not None and v and None not in v and np.isfinite(v).all() and any(v)

    whole = [(i, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, (k, v) in enumerate(rows) if good(k, v)]
    links = [(a, b) for x, (a, u) in enumerate(whole) for b, v in whole[x + 1 :] if len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.95]
    n, comp = Counter(i for ab in links for i in ab), reached(len(rows), links)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        smallest[comp[i]] = min([x for x in (smallest.get(comp[i]), k) if x is not None], default=None)
    return Counter((k, n[i], smallest[comp[i]]) for i, (k, _) in enumerate(rows))


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [b + rng.normal(size=16) * s for b in base for s in (0, 0.02, 0.3, 0)]
    rows = [r.astype("f4").tolist() for r in rows] + [[0.0] * 16, None, [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], (10 * np.array(rows[0])).tolist()]
    rows = list(enumerate(rows)) + [(2, rows[2]), (None, rows[0]), (3, rows[9])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"class": F.lit(1), "node": F.lit("x"), "v": F.lit(0)})
    want = linked_by_hand([(k, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for k, v in rows])
    for tile, most in ((4096, 1 << 20), (16, 1 << 20), (16, 2048)):
        got = embed_dedup.near_duplicates(t, tile=tile, task_bytes=most)
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == want
    assert embed_dedup.near_duplicates(t.limit(0)).count() == 0
    assert embed_dedup.near_duplicates(t.filter("vec_id = 160")).first()["n_links"] == 0


def test_lengths_and_sizes_of_any_kind(spark):
    """Vectors of several lengths, of 1e200 and 1e-200, and of one component."""
    rng = np.random.default_rng(7)
    rows = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, 0.0], [1.0, 0.0], [1e200, 1e200], [1e-200, 1.01e-200], [1e300, -1e300], [2.0], [5e-324], [-3.0], [-0.0, 1.0], [0.0, 1.0]]
    rows += [(10.0 ** rng.integers(-250, 250) * (b + 0.05 * rng.normal(size=d))).tolist() for d in (2, 3, 7, 40) for b in rng.normal(size=(6, d)) for _ in range(5)]
    rows = list(enumerate(rows))
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for tile in (4096, 10):
        got = embed_dedup.near_duplicates(t, tile=tile, task_bytes=400)
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == linked_by_hand(rows)


def test_equal_coordinates_are_dealt_on(spark):
    """All vectors share their first coordinates; tiles stay alike in size, links whole."""
    rng = np.random.default_rng(8)
    rows = [(i, [0.0] * k + [1.0] + [0.0] * (30 - k)) for i, k in enumerate(rng.integers(0, 31, 900).tolist())]
    rows = [(i, [x + (1e-4 * i if x else 0) for x in v]) for i, v in rows]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=100)
    place = {i: v.index(max(v)) for i, v in rows}
    first, n = {}, Counter(place.values())
    for i, k in place.items():
        first.setdefault(k, i)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()} == {(i, n[k] - 1, first[k]) for i, k in place.items()}


@pytest.mark.parametrize("q", [2, 3, 5, 7])
def test_any_two_tiles_meet_in_one_task(q):
    n = q * q + q + 1
    lines = [set(through(k, q)) for k in range(n)]
    assert all(len(x) == q + 1 and max(x) < n for x in lines)
    assert all(len(lines[a] & lines[b]) == 1 for a in range(n) for b in range(a))
    assert all((p in lines[k]) == (k in lines[p]) for p in range(n) for k in range(n))


def test_copies_of_a_million_vectors():
    """Of 64 floats: three copies, tasks within their bytes; and bounded however many."""
    assert order_for(1_000_000 * 256, embed_dedup.TASK_BYTES) == 2
    for n in (10**7, 10**8):
        q = order_for(n * 256, embed_dedup.TASK_BYTES)
        assert n * 256 * (q + 1) / (q * q + q + 1) <= embed_dedup.TASK_BYTES and q <= 1.25 * n * 256 / embed_dedup.TASK_BYTES + 2


def test_far_tiles_are_not_compared(spark):
    """Vectors along an arc: tiles that lie apart share no task but by chance of the plane."""
    angle = np.linspace(0, math.pi, 3000)
    rows = [(i, [math.cos(a), math.sin(a), 0.0]) for i, a in enumerate(angle.tolist())]
    t = embed_dedup.signed(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", "<f8").select(F.col("key").alias("node"), F.lit(1).cast("long").alias("members"), "dims", "x")
    of = embed_dedup.tiling_of(t, 3, "<f8", 3000, 6000)
    there = [k for k in range(len(of.low)) if np.isfinite(of.low[k]).all()]
    near = sum(of.near(a, np.array([b]), 0.95)[0] for a in there for b in there)
    assert len(there) > 20 and near < 0.5 * len(there) ** 2
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=100, task_bytes=6000)
    wide = sum(1 for a in angle[1:] if math.cos(a) >= 0.95)
    assert got.filter("vec_id = 1500").first()["n_links"] == 2 * wide and got.filter("component_id <> 0").isEmpty()


def test_residual_bound_loses_nothing():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(300, 32)) * np.linspace(2, 0.1, 32)
    a[150:] = a[:150] + rng.normal(size=(150, 32)) * 0.15
    u = embed_dedup.unit(a)
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    side = embed_dedup.Tile(a, axes)
    got = embed_dedup.linked(side, side, 0.95, block=64)
    want = [(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.95]
    assert sorted(tuple(sorted(p)) for p in got.tolist()) == want and want
    one, two = embed_dedup.Tile(a[:150], axes), embed_dedup.Tile(a[150:], axes)
    assert sorted((i, j + 150) for i, j in embed_dedup.linked(one, two, 0.95, block=64).tolist()) == [(i, j) for i, j in want if i < 150 <= j]


def near_texts(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    shared = [word() for _ in range(12)]
    out = []
    for g in range(25):
        core = [word() for _ in range(rng.randint(30, 120))]
        for k in range(rng.choice([1, 2, 3, 8])):
            t = list(core)
            for _ in range(k % 4):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    out += [" ".join(shared + [word() for _ in range(20)]) for _ in range(20)]
    core = [word() for _ in range(150)]
    for _ in range(120):  # more than a tile, with small ones
        t = list(core)
        t[rng.randrange(150)] = word()
        out.append(" ".join(t))
    return out


def test_join_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 40)
    monkeypatch.setattr(ngram_join, "SIGNATURES", 50)
    monkeypatch.setattr(ngram_join, "BOX", 30)
    texts = near_texts()
    rows = list(enumerate(texts)) + [(1000, texts[0]), (1001, texts[0] + " \n"), (1002, None), (1003, ""), (1004, " \t"), (1005, "two words"), (1006, "two words"), (1007, "two  words x"), (5, texts[5]), (1008, "w " * 30000)]
    docs = spark.createDataFrame(rows + [(None, texts[0])], "doc_id long, text string").withColumns({"class": F.lit(1), "id": F.lit("x"), "group": F.lit(0), "n": F.lit(0), "key": F.lit("k")})
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    n, comp = Counter(i for ab in links for i in ab), reached(len(rows), links)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        smallest[comp[i]] = min(smallest.get(comp[i], k), k)
    want = Counter((k, smallest[comp[i]], n[i]) for i, (k, _) in enumerate(rows)) + Counter([(None, None, 0)])
    assert Counter(map(tuple, ngram_join.joined(docs).collect())) == want
    assert ngram_join.joined(docs.limit(0)).count() == 0
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({*smallest.values(), None})


def test_large_groups_of_like_signatures_are_found(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 20)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    cores = [" ".join(word() for _ in range(400)) for _ in range(8)]
    docs = spark.createDataFrame([(100 * g + k, f"{core} {k}") for g, core in enumerate(cores) for k in range(30)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.joined(docs).collect())
    assert got == Counter((100 * g + k, 100 * g, 29) for g in range(8) for k in range(30))


def test_boxes_of_long_texts_are_bounded(spark, monkeypatch):
    """Near-copies of a million words: a box holds few of them, and all links are found."""
    words = [f"w{i}" for i in range(1_000_000)]
    texts = [(k, " ".join(words[:500_000] + [f"x{k}"] + words[500_000:])) for k in range(9)]
    monkeypatch.setattr(ngram_join, "BOX_BYTES", 30 << 20)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.joined(docs).collect())
    assert got == Counter((k, 0, 8) for k in range(9))
    q = ngram_join.box_order(9, 9 * 8_000_000)
    held = Counter(box for k in range(9) for box, _, _ in ngram_join.places(k, q))
    assert q and max(held.values()) < 9


@pytest.mark.parametrize("q", [0, 2, 5])
def test_any_two_members_meet_once(q):
    at = {i: ngram_join.places(i, q) for i in range(120)}
    for a in at:
        for b in range(a):
            meet = [1 for box, tile, own in at[a] for other, there, _ in at[b] if box == other and (tile != there or own)]
            assert len(meet) == 1


def test_a_row_repeated_often_is_compared_once(spark):
    rng = random.Random(13)
    text = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(60))
    rows = [(1, text)] * 3000 + [(2, text + " end"), (3, text)]
    got = Counter(map(tuple, ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == Counter({(1, 1, 3001): 3000, (2, 1, 3001): 1, (3, 1, 3001): 1})


def test_links_of_the_test_documents(spark):
    """Every link at 0.8 among the documents of the test table, by brute force over shared
    shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for i, t in docs.collect():
        w = [x for x in (t or "").translate(ngram_join.Shingler.table).split(" ") if x]
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for h in holders.values() if len(h) > 1 for k, b in enumerate(h) for a in h[:k])
    links = [p for p, n in shared.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    n = Counter(i for p in links for i in p)
    assert len(links) > 50
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.joined(docs).collect()} == {r["doc_id"]: n[r["doc_id"]] for r in docs.collect()}


def test_other_texts_of_a_repeated_key_stay(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, d), (3, d), (4, a), (None, a), (None, a), (5, None), (5, "")]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(1, a), (2, b), (3, c), (3, d), (None, a), (None, a), (5, None), (5, "")])


def test_intersections():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    left, right = np.arange(0, 20), np.arange(10, 30)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert ngram_join.intersections(sets, left, right, columns=7).tolist() == want
    assert ngram_join.intersections(sets[:2], np.array([0]), np.array([1])).tolist() == [[len(np.intersect1d(sets[0], sets[1]))]]


def test_runs_reach_the_recall():
    assert ngram_join.runs_needed(0.8, 1, 0.9) == 3
    q = 1 - np.exp(-(1 - np.exp(-(1 - np.exp(-1)))))
    assert 1 - (1 - q) ** ngram_join.runs_needed(0.8) >= ngram_join.RECALL
