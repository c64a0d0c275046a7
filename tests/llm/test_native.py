import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselens.llm import chat, queries, rules, secret_scan
from tests.oracle import agree

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert agree(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL) > 0


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan), plan


def documents(spark, rows):
    """Extra columns clash with names that the operators use themselves."""
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return t.withColumns({"key": F.lit("x"), "host": F.lit(1), "w": F.lit(2.0), "n_words": F.lit("n"), "spans": F.lit(0), "value": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_by_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t\x0b ", "one", "a b c d e a b c d e", "x x x x x x x x", "é ü # * | <>&%$", "l\nl\n \n \nl\n", "a b c d e f g h i j k " * 3000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + "\n" * rng.randint(0, 3) for _ in range(150)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)] + [(1, "", "en", None), (None, "a b", None, None)]
    t = rules.judged(documents(spark, rows))
    no_python(t)
    got = t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == Counter((i, *rule_counts(x)) for i, x, _, _ in rows)
    assert t.filter("base_failed and kept").isEmpty()
    assert rules.judged(documents(spark, [])).count() == 0


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(i, "few words" if i % 10 else good, "en", "bad") for i in range(100)] + [(1000 + i, good if i % 10 else "few", "en", f"h{i % 20}") for i in range(2000)]
    rows += [(9000, "few", "en", "tiny"), (9001, good, "en", "tiny")]  # half of two: shrunk to the others' rate
    t = rules.judged(documents(spark, rows))
    assert t.filter("source = 'bad' and kept").isEmpty() and t.filter("source = 'bad' and host_failed and host_n = 100").count() == 100
    assert t.filter("source like 'h%' and kept").count() == 1800
    assert t.filter("doc_id = 9001").first()["kept"]


def test_host_verdicts_by_hand(spark):
    """The verdict is relative to the corpus: a rate that fails a host among clean ones passes
    where all fail often, and hosts alike as by chance are all shrunk to one rate."""
    def verdicts(hosts):
        t = rules.host_verdicts(spark.createDataFrame(hosts, "host string, n long, failed long"), "host")
        return {r["host"]: (r["rate"], r["host_failed"]) for r in t.collect()}

    clean = [(f"h{i}", 1000, 20 + i % 3) for i in range(30)]
    got = verdicts([*clean, ("x", 1000, 250), ("y", 4, 1)])
    m = (sum(f / n for _, n, f in clean) + 0.25 + 0.25) / 32
    rates = [f / n for _, n, f in clean] + [0.25, 0.25]
    s = sum((r - m) ** 2 for r in rates) / 31 - m * (1 - m) * (31 / 1000 + 1 / 4) / 32
    weight = m * (1 - m) / s - 1
    assert got["x"] == (pytest.approx((250 + m * weight) / (1000 + weight)), True)
    assert got["y"][0] < 0.25 and not got["y"][1] and not any(got[h][1] for h, _, _ in clean)
    assert not any(f for _, f in verdicts([(f"h{i}", 1000, 200 + 10 * (i % 7)) for i in range(30)]).values())
    assert {f for _, f in verdicts([("a", 10, 0), ("b", 20, 0)]).values()} == {False}
    assert verdicts([("a", 10, 10)])["a"] == (1.0, False)


def test_sql_agrees_where_a_host_fails(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(i, "few words" if i % 3 else good, "en", "bad") for i in range(200)] + [(1000 + i, good if i % 15 else "few", "en", f"h{i % 9}") for i in range(1800)] + [(5000, good, "en", None)]
    documents(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert agree(spark, rules.op2_quality_rules, rules.OP2_SQL, str(tmp_path)) == len(rows)
    t = rules.op2_quality_rules(spark, str(tmp_path))
    assert t.filter("not base_failed and not kept").count() == 67


KINDS = (
    ("assign", re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def base_spans(text):
    out = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    return sorted(out)


SECRETS = ["token=password=abcdefghijkl", "token=password:abcdefghijklmnop", 'API_KEY : "abc.DEF-123/=456"', "passwd='short'", "AKIA" + "B7" * 7, "AKIAAKIA" + "X" * 13, "0123456789abcdef", "x" * 5 + "deadbeef" * 4 + "g", "ſecret=abcdefghijklmnop", "Secret:abcdefghijkl", "é token=abcdefghijklmnop ü AKIA" + "A" * 30]


def test_secrets_by_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", *SECRETS] + [" ".join(rng.choice(SECRETS + ["word", "é"]) for _ in range(rng.randint(1, 8))) for _ in range(80)] + ["pad " * 20000 + SECRETS[4]]
    rows = [(i, t, "en", f"s{i % 7}") for i, t in enumerate(texts)] + [(3, texts[3], None, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    t = secret_scan.op9_secret_scan(spark, str(tmp_path))
    no_python(t)
    want = Counter()
    for i, x, _, _ in rows:
        s = base_spans(x)
        named = ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in s)
        want[(i, *(sum(k == n for _, k, _ in s) for n in range(3)), hashlib.sha256(named.encode()).hexdigest())] += 1
    got = t.collect()
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    assert secret_scan.scanned(documents(spark, [])).count() == 0


def test_only_values_of_few_owners_are_added(spark):
    mine, copied = "Zx9Qw8Er7Ty6Ui5Op4As", "Mn1Bv2Cx3Zl4Kj5Hg6Fd"
    rows = [(1, f"see {mine} here", "en", "one"), (2, f"again {mine}", "en", "one")] + [(10 + i, f"example {copied}", "en", f"o{i}") for i in range(8)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scanned(documents(spark, rows)).collect()}
    assert [(s["start"], s["end"], s["kind"]) for s in got[1]] == [(4, 24, 3)] and got[10] == []
    out = {r["doc_id"]: r for r in secret_scan.redacted(documents(spark, rows)).collect()}
    assert out[1]["text"] == "see [secret] here" and out[1]["n_chars"] == 17 and out[10]["text"] == f"example {copied}"


def test_ownership_separates_examples_of_base_kinds(spark, tmp_path):
    """An example key that many owners copy, one owner's own key, and one that a single owner
    repeats in many documents and one language; SQL agrees."""
    own, example, often = "AKIA" + "Q7" * 8, "AKIA" + "EXAMPLE0" * 2, "0123456789abcdef0123"
    rows = [(1, f"use {own} now", "en", "one"), (None, f"{example}", None, None)]
    rows += [(10 + i, f"docs say {example} and {own if i == 0 else ''}", "en", f"o{i % 5}") for i in range(20)]
    rows += [(100 + i, f"id {often}", "en", "two") for i in range(300)] + [(500, None, "en", "x"), (501, "", "en", "x"), (1, "use nothing", "en", "one")]
    documents(spark, rows).dropDuplicates(["doc_id"]).filter("doc_id is not null").unionByName(documents(spark, [(600, example, None, None)])).coalesce(1).write.parquet(str(tmp_path / "a/documents.parquet"))
    assert agree(spark, secret_scan.op9_secret_scan, secret_scan.OP9_SQL, str(tmp_path / "a")) == len(rows) - 1
    documents(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = secret_scan.op9_secret_scan(spark, str(tmp_path))
    assert got.count() == len(rows)
    told = {r["doc_id"]: (r["n_live"], r["n_copied"], r["owners"]) for r in got.filter("spans <> ''").collect()}
    assert told[1] == (1, 0, "2") and told[11] == (0, 1, "6") and told[10] == (1, 1, "6,2") and told[100] == (1, 0, "1") and told[None] == (0, 1, "6")
    out = {r["doc_id"]: r["text"] for r in secret_scan.redacted(documents(spark, rows)).filter("doc_id > 1").collect()}
    assert out[11] == "docs say [example] and " and out[10] == "docs say [example] and [secret]" and out[100] == "id [secret]" and out[500] is None


def test_redaction(spark):
    rows = [(1, "token=abcdefghijklmnop", "en", "a"), (2, "é 0123456789abcdef0 token: 0123456789abcdef end", "en", "a"), (3, None, "en", "a"), (4, "clean", None, None)]
    t = documents(spark, rows)
    out = secret_scan.redacted(t)
    assert out.columns == t.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "[secret]", 2: "é [secret] [secret] end", 3: None, 4: "clean"}


def turns_of(rows):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()


def test_chat_round_trip(spark, tmp_path):
    rng = random.Random(6)
    bits = ["\\", "###", "</turn>", "\n</turn>\n", "### assistant: ", "a", "é", " ", "\n", ":", "$1", "\\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys:tem", "a\n</turn>\n### b: ", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(100, 5, "user", "gap"), (100, None, "assistant", None), (101, 0, None, "x"), (101, 0, "assistant", "tie"), (101, 0, "assistant", "tie"), (102, 0, "assistant", "long " * 20000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "t": F.lit("x"), "parent": F.lit(0)}).write.parquet(str(tmp_path / "conversations.parquet"))
    t = chat.op10_chat_formatting(spark, str(tmp_path))
    no_python(t)
    convs = {}
    for c, k, r, x in [*rows, (-7, 0, "user", chat.HARD_TEXT), (-7, 1, "assistant", chat.HARD_TEXT)]:
        convs.setdefault(c, []).append((k if k is not None else -1, r is not None, r or "", x is not None, x or ""))
    got = {r["conv_id"]: r for r in t.collect()}
    assert set(got) == set(convs)
    for c, ts in convs.items():
        ts = [(r, x) for _, _, r, _, x in sorted(ts)]
        loss = "".join(x for r, x in ts if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(ts), turns_of(ts), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
        assert r["formatted_chars"] >= sum(len(a) + len(b) for a, b in ts)


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "weak", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 6.0), (2, 1, 9, "user", "orphan root", 1.0), (3, 1, 2, "user", "ring", 1.0), (3, 2, 1, "user", "ring", 1.0), (3, 3, 1, "user", "on a ring", 1.0), (4, 1, None, "user", "a", 1.0), (4, 2, 1, "user", "tie", 1.0), (4, 3, 1, "user", "tie", 1.0)]
    t = spark.createDataFrame(rows, "tree long, id long, up long, role string, text string, score double")
    got = {r["tree"]: r for r in chat.conversations(t, "tree", "id", "up", "role", "text", "score").collect()}
    assert set(got) == {1, 2, 4} and got[1]["leaf"] == 5 and got[4]["leaf"] == 2
    assert got[1]["formatted"] == "### user: q\n</turn>\n### assistant: good\n</turn>\n### user: more\n</turn>\n### assistant: end\n</turn>\n"
    s = got[1]["loss_spans"]
    assert [got[1]["formatted"][x["start"] : x["end"]] for x in s] == ["good", "end"]
    every = chat.conversations(t, "tree", "id", "up", "role", "text", "score", top=None).collect()
    assert sorted((r["tree"], r["leaf"], r["branch_rank"]) for r in every) == [(1, 2, 2), (1, 5, 1), (2, 1, 1), (4, 2, 1), (4, 3, 2)]
    assert chat.conversations(t.limit(0), "tree", "id", "up", "role", "text", "score").count() == 0


def test_a_long_chain_needs_few_joins(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)]
    t = spark.createDataFrame(rows, "tree long, id long, up long, role string, text string, score double")
    r = chat.conversations(t, "tree", "id", "up", "role", "text", "score").select(chat.read_back(F.col("formatted")).alias("t")).first()
    assert [x["text"] for x in r["t"]] == [str(i) for i in range(300)]
