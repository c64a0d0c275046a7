import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from caselens.llm import bpe, packing, unigram

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
HARD = ["", " ", "a", "   x", "\n \n a", "a\n  b \n", "aaaaaaaaaaaa", "ab" * 400, "日本語 テキスト", "don't  STOP", "é́ é", "x" * 3000 + " y", "\x1c\x85 z", "İ ΑΣ ß", "<|endoftext|> a<|startoftext|>b", "▁▁ ▁a  b", "😀😀 ᚠ"]


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def le(ids):
    return np.array(ids, dtype="<u4").tobytes()


def texts(n, seed=0, alphabet="abcdeiou  \n\t'sстраéß日本0123 the.,!"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "other", 1) for i, t in rows], "doc_id long, text string, key string, ids int")


def test_merge_replay_matches_the_library(encoding):
    many = texts(3000) + HARD
    assert bpe.replay(RANKS).encode(many, P.PATTERN) == [le(encoding.encode_ordinary(t)) for t in many]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_replay_of_any_text(t):
    r = bpe.replay(RANKS)
    [ids] = r.encode([t], P.PATTERN)
    assert r.decode(ids) == t.encode("utf-8", "surrogatepass")
    assert [r.one(w.encode("utf-8", "surrogatepass")) for w in t.split()] == r.words([w.encode("utf-8", "surrogatepass") for w in t.split()])


def test_merges_that_open_lower_ranks_go_alone():
    """A vocabulary in which a merge makes a pair of lower rank: still the leftmost lowest."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 301, b"abc": 300, b"cb": 302}
    r = bpe.MergeReplay(ranks)
    for word in (b"abcabc", b"bcbcbc", b"ababcbcb", b"aaa"):
        assert r.words([word]) == [r.one(word)]


def test_op1_on_a_fixture(spark, encoding, tmp_path):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(90, None), (91, "same"), (91, "same")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = bpe.op1_byte_bpe(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    empty = bpe.decode(bpe.encode(documents(spark, [])))
    assert empty.count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first()["decoded"] == b""


def test_word_tokens_match_the_library():
    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.word_tokens(P.path("word_bpe_49k.json"))
    for t in texts(2000, 2, "abcDEÉßµÿ 'st0123.,!?|日本́\n\t<>İΣ ") + HARD:
        assert own.ids(t) == le(lib.encode(t, add_special_tokens=False).ids), t


def test_counts_match_a_unigram_model():
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    lib = Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], 0, byte_fallback=True))
    many = texts(2000, 3) + texts(1000, 4, "a the  er in") + HARD
    want = [len(lib.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0 for t in many]
    assert unigram.counter(P.path("piece_bpe_32k.model")).counts(many) == want


def test_ties_go_to_the_earlier_start():
    c = unigram.Counter([("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0)])
    assert c.piece_count("abc") == 1 and c.piece_count("ab") == 1 and c.piece_count("é") == 2


def test_op7_on_a_fixture(spark):
    rows = [(1, "the same"), (1, "the same"), (2, None), (3, ""), (None, "x")]
    got = Counter(tuple(r) for r in unigram.token_counts(documents(spark, rows)).collect())
    n = unigram.counter(P.path("piece_bpe_32k.model")).counts(["the same", "x"])
    assert got == Counter({(1, n[0]): 2, (2, 0): 1, (3, 0): 1, (None, n[1]): 1})
    assert unigram.token_counts(documents(spark, [])).count() == 0


def bins_of(plan):
    return sum(n for n, _ in plan)


@pytest.mark.parametrize("capacity,lengths", [(10, [6, 4, 5, 5, 7, 3, 10, 1, 1, 8, 2]), (100, None), (2048, None), (7, []), (5, [5] * 9), (9, [1] * 100)])
def test_plans_hold_exactly_the_histogram(capacity, lengths):
    rng = random.Random(capacity)
    lengths = [rng.randint(1, capacity) for _ in range(3000)] if lengths is None else lengths
    plan = packing.plan(Counter(lengths), capacity)
    held = Counter()
    for times, parts in plan:
        assert sum(parts) <= capacity
        for p in parts:
            held[p] += times
    assert held == Counter(lengths)
    alone = packing.Slack(capacity)
    for length, n in sorted(Counter(lengths).items(), reverse=True):
        alone.best_fit(length, n)
    assert -(-sum(lengths) // capacity) <= bins_of(plan) <= 1.02 * bins_of(alone.all()) + 2  # lengths all alike often are the hard case of rounding up
    with pytest.raises(ValueError):
        packing.plan({capacity + 1: 1}, capacity)


def best_fit_alone(histogram, capacity):
    alone = packing.Slack(capacity)
    for length, n in sorted(histogram.items(), reverse=True):
        alone.best_fit(length, n)
    return bins_of(alone.all())


def test_configurations_beat_one_size_alone():
    sizes, demand = np.array([3, 5, 7]), np.array([30.0, 30.0, 30.0])
    made = packing.configurations(sizes, demand, 10)
    assert all(sum(s * n for s, n in zip(sizes, c)) <= 10 for _, c, _ in made)
    assert sum(t for t, _, _ in made) <= 45


def test_best_configuration_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes, values = np.unique(rng.integers(2, 12, 4)), rng.random(4)
        values, room = values[: len(sizes)], rng.random(21)
        worth, counts, left = packing.best_configuration(sizes, values, 20, room)
        every = [c for c in np.ndindex(*(20 // s + 1 for s in sizes)) if np.dot(c, sizes) <= 20]
        assert worth == pytest.approx(max(np.dot(c, values) + room[20 - np.dot(c, sizes)] for c in every))
        assert left == 20 - np.dot(counts, sizes) and worth == pytest.approx(np.dot(counts, values) + room[left])


def test_configurations_decide_the_plan():
    """Lengths on which best-fit alone takes more sequences than the program."""
    histogram = {51: 60, 27: 60, 26: 60, 23: 120}
    plan = packing.plan(histogram, 100)
    assert bins_of(plan) == 90 < best_fit_alone(histogram, 100)
    rng = random.Random(3)
    histogram = Counter(rng.randint(400, 1000) for _ in range(20_000))
    assert bins_of(packing.plan(histogram)) < 0.95 * best_fit_alone(histogram, 2048)


def test_configurations_place_the_large_pieces():
    rng = random.Random(4)
    histogram = Counter(rng.choice([2048, rng.randint(1, 800), rng.randint(100, 2047)]) for _ in range(11_000))
    for large, groups in packing.SCHEMES:
        made, left = packing.grouping(histogram, 2048, groups, large)
        held = Counter()
        for times, lengths in made:
            assert sum(lengths) <= 2048 and min(lengths) > large * 2048
            held.update({length: times * n for length, n in Counter(lengths).items()})
        assert held + left == Counter({k: n for k, n in histogram.items() if large * 2048 < k < 2048})
        assert left.total() <= 3 * groups
        returned = Counter({tuple(sorted(x for x in lengths if x > large * 2048)): 0 for _, lengths in packing.plan(histogram, 2048, ((large, groups),))})
        for times, lengths in packing.plan(histogram, 2048, ((large, groups),)):
            returned[tuple(sorted(x for x in lengths if x > large * 2048))] += times
        for lengths, times in Counter({tuple(sorted(x)): 0 for _, x in made}).items():
            times = sum(n for n, x in made if tuple(sorted(x)) == lengths)
            assert returned[lengths] >= times - 3 * groups


def test_given_tables_need_no_more_than_the_bound():
    """Pieces of documents of the test tables, by their tokens: the bound is the whole volume."""
    of = packing.word_tokens(P.path("word_bpe_49k.json"))
    import pandas as pd

    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text
    size = [len(of.ids(t or "")) // 4 + 1 for t in texts]
    histogram = Counter(min(n - at, 2048) for n in size for at in range(0, n, 2048))
    assert bins_of(packing.plan(histogram)) == -(-sum(size) // 2048)


def test_equal_rows_are_ranked_in_many_buckets(spark):
    t = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit(7).cast("long").alias("length"), F.col("id").alias("lot"))
    got = packing.ranked(t, "length", "lot", 5000)
    assert sorted(r["rank"] for r in got.collect()) == list(range(5000))
    assert packing.pack(t.drop("lot")).groupBy("sequence_id", "offset").count().filter("count > 1").isEmpty()


def test_op6_on_a_fixture(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join("word" if rng.random() < 0.5 else "Émile!" for _ in range(rng.choice([0, 3, 50, 400, 1500])))) for i in range(60)]
    rows += [(100, None), (101, "long " * 5000), (7, rows[7][1])]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op6_best_fit_packing(spark, str(tmp_path)).collect()
    lib, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k, at, len(part), zlib.crc32(le(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048
    assert len(places) <= 1.05 * -(-sum(r["length"] for r in got) // 2048) + 1
    documents(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert packing.op6_best_fit_packing(spark, str(tmp_path / "none")).count() == 0
