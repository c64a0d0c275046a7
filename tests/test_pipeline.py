import random

import pytest
from pyspark.sql import functions as F

from caselens.operators import labels, marts, subgroups
from caselens.plans import build, serving
from caselens.sources import bronze, lake
from caselens.sources.lake import Gold


def silver(spark, rows, deleted=()):
    """rows: (primaryid, caseid, version, date, quarter, drug, event)"""
    t = spark.createDataFrame(rows, "primaryid string, caseid string, case_version int, fda_date string, faers_quarter string, drug string, event string")
    return {
        "reports": t.select("primaryid", "caseid", "case_version", F.to_date("fda_date").alias("fda_date"), "faers_quarter"),
        "drugs": t.select("primaryid", F.col("drug").alias("drug_name_normalized"), F.col("drug").alias("drug_name_raw"), F.lit(None).cast("string").alias("drug_class"), F.lit("PS").alias("role_code")),
        "reactions": t.select("primaryid", F.col("event").alias("reaction_term_normalized"), F.col("event").alias("reaction_term")),
        "outcomes": t.select("primaryid", F.lit("HO").alias("outcome_code")),
        "deleted_cases": spark.createDataFrame([(c,) for c in deleted] + [(None,)], "caseid string"),
    }


def fixture():
    rng, rows = random.Random(3), []
    for i in range(120):
        rows.append((str(i), f"c{i}", 1, "2023-02-01", "2023Q1", f"D{rng.randrange(4)}", f"E{rng.randrange(4)}"))
    rows += [(str(200 + i), f"s{i}", 1, "2023-02-01", "2023Q1", "DRUGX", "EVENTA") for i in range(30)]
    rows += [("300", "9001", 1, "2023-02-01", "2023Q1", "DRUGX", "EVENTA"), ("301", "9001", 2, "2023-05-01", "2023Q2", "DRUGX", "EVENTB"), ("302", "9002", 1, "2023-05-01", "2023Q2", "DRUGX", "EVENTA")]
    return rows


def test_silver_to_gold(spark, tmp_path):
    gold = Gold(spark, str(tmp_path))
    scores = build.build_gold(spark, silver(spark, fixture(), ["9002"]), gold)
    got = {(r["drug_name_normalized"], r["adverse_event"]): r for r in scores.collect()}
    x = got["DRUGX", "EVENTA"]
    assert sum(x[c] for c in ("a_drug_event", "b_drug_other_events", "c_other_drugs_event", "d_other_drugs_other_events")) == 151
    assert x["a_drug_event"] == 30 and ("DRUGX", "EVENTB") in got and x["seriousness_rate"] == 1.0 and x["ebgm"] > 1
    assert x["disproportionality_flag"] and x["ror_ci_lower"] < x["ror"] < x["ror_ci_upper"]
    assert set(gold.names()) >= {"signal_scores", "signal_scores_sample", "signal_scores_stats", "signal_drugs", "signal_events", "emerging_signals", "pipeline_health", "data_quality_checks"}
    assert gold.read("pipeline_health").first()["status"] == "success"
    assert gold.read("emerging_signals").filter("current_quarter <> '2023Q2'").isEmpty()
    assert gold.query("SELECT count(*) AS n FROM signal_scores WHERE a_drug_event >= ?", [30]).first()["n"] == 1
    assert {r["mart"] for r in serving.health(gold).collect()} == set(gold.names())


def test_serving(spark, tmp_path):
    gold = Gold(spark, str(tmp_path / "gold"))
    assert serving.signals(gold) == {"total": 0, "offset": 0, "limit": 100, "rows": []}
    assert serving.optional_table(gold, "interaction_signals") is None
    with pytest.raises(FileNotFoundError):
        gold.read("signal_scores")
    build.build_gold(spark, silver(spark, fixture()), gold)
    one, two = serving.signals(gold, limit=5), serving.signals(gold, limit=5, offset=5)
    assert set(one) == {"total", "offset", "limit", "rows"} and one["total"] > 10
    rors = [r["ror"] for r in one["rows"]]
    assert rors == sorted(rors, reverse=True)
    key = lambda r: (r["drug_name_normalized"], r["adverse_event"])
    assert not {key(r) for r in one["rows"]} & {key(r) for r in two["rows"]}
    assert {r["drug_name_normalized"] for r in serving.signals(gold, drug="drugx")["rows"]} == {"DRUGX"}
    assert serving.signals(gold, limit=9999)["limit"] == 1000 and serving.signals(gold, sort="drop table")["total"] == one["total"]
    assert serving.signals(gold, q="rugx")["total"] == serving.signals(gold, drug="DRUGX")["total"]
    with pytest.raises(KeyError):
        serving.drug_profile(gold, "nothing")
    assert not serving.drug_profile(gold, "DrugX")["signals"].isEmpty()
    assert serving.dashboard_summary(gold)["stats"]["signal_total"] == one["total"]
    levels = [r["priority_level"] for r in serving.emerging(gold.read("emerging_signals"), "low", 3).collect()]
    assert set(levels) <= {"Low"}


def test_missing_silver(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        build.read_silver(spark, str(tmp_path))


def ascii_quarter(root, q, demo, drug, reac, deleted=()):
    p = root / "year=2023" / f"quarter=Q{q}" / "ascii"
    p.mkdir(parents=True)
    sex = "sex" if q == 1 else "gndr_cod"
    (p / "DEMO.txt").write_bytes(("\n".join([f"primaryid$caseid$caseversion$fda_dt$event_dt${sex}", *demo]) + "\n").encode("latin-1"))
    (p / "DRUG.txt").write_bytes(("\n".join(["primaryid$caseid$drug_seq$role_cod$drugname", *drug]) + "\n").encode("latin-1"))
    (p / "REAC.txt").write_bytes(("\n".join(["primaryid$caseid$pt", *reac]) + "\n").encode("latin-1"))
    if deleted:
        (p / "DELETED.txt").write_text("caseid\n" + "\n".join(deleted) + "\n\n")


def test_extracts_to_gold(spark, tmp_path):
    rng, one, two = random.Random(1), ([], [], []), ([], [], [])

    def add(out, pid, case, version, day, drug, event):
        out[0].append(f"{pid}${case}${version}${day}$2023$F")
        out[1].append(f"{pid}${case}$1$ps${drug}")
        out[2].append(f"{pid}${case}${event}")

    for i in range(60):
        add(one, i, f"c{i}", 1, "20230201", f"drug {rng.choice('abc')}", f"event  {rng.choice('abc')}")
    for i in range(25):
        add(one, 100 + i, f"s{i}", 1, "20230201", "Ozempic 0.5 mg pen", "Nausea")
    add(one, 200, "9001", 1, "20230201", "Ozempic", "Nausea")
    add(two, 201, "9001", 2, "20230501", "Ozempic", "Vomiting")
    add(two, 202, "9002", 1, "2023", 'Oz"empic', "Nausea")
    ascii_quarter(tmp_path / "bronze", 1, *one)
    ascii_quarter(tmp_path / "bronze", 2, *two, deleted=["9002$x", " 9002 "])
    root, out = str(tmp_path / "bronze"), str(tmp_path / "silver")
    assert bronze.discover_quarters(spark, root) == [(2023, 1), (2023, 2)]
    assert set(build.ingest(spark, root, out)) == {"reports", "drugs", "reactions"}
    assert build.ingest(spark, root, out) == []
    t = build.read_silver(spark, out)
    assert t["reports"].filter("patient_sex = 'F'").count() == 88  # both names of the column
    assert t["reports"].filter("primaryid = '202' and fda_date is null").count() == 1
    assert t["deleted_cases"].select("caseid").distinct().collect()[0][0] == "9002"
    assert t["reactions"].filter("reaction_term_normalized = 'EVENT A'").count() > 0
    scores = build.build_gold(spark, t, Gold(spark, str(tmp_path / "gold")))
    x = scores.filter("drug_name_normalized = 'semaglutide' and adverse_event = 'NAUSEA'").first()
    assert x["a_drug_event"] == 25 and x["ebgm"] > 1 and x["serious_count"] == 0
    assert sum(x[c] for c in ("a_drug_event", "b_drug_other_events", "c_other_drugs_event", "d_other_drugs_other_events")) == 86


def test_incremental_quarter_keeps_the_others(spark, tmp_path):
    a = spark.createDataFrame([("1", 2023, "Q1"), ("2", 2023, "Q2")], "id string, year int, quarter string")
    lake.write_silver(a, str(tmp_path / "t"))
    lake.write_silver(spark.createDataFrame([("3", 2023, "Q2")], "id string, year int, quarter string"), str(tmp_path / "t"))
    assert sorted(r["id"] for r in lake.read_table(spark, str(tmp_path / "t")).collect()) == ["1", "3"]


def test_rekeyed_by_ingredient(spark):
    rows = [(str(i), f"c{i}", 1, "2023-01-01", "2023Q1", "OTHERDRUG", "EB") for i in range(80)]
    rows += [(str(100 + i), f"o{i}", 1, "2023-01-01", "2023Q1", "OZEMPIC", "EVENTA") for i in range(15)]
    rows += [(str(200 + i), f"w{i}", 1, "2023-01-01", "2023Q1", "WEGOVY", "EVENTA") for i in range(12)]
    from caselens.operators import cases, dimension, pairs

    s = silver(spark, rows)
    exact = spark.createDataFrame([("Ozempic", "1991302", "semaglutide"), ("WEGOVY", "1991302", "semaglutide"), ("WEGOVY", "9999999", "zzz")], "name string, rxcui string, ingredient string")
    atc = spark.createDataFrame([("1991302", "A10B"), ("1991302", "A10BJ06")], "rxcui string, class_id string")
    dim = dimension.drug_dimension(dimension.name_frequency(s["drugs"]), exact, atc=atc)
    got = {r["drug_name_normalized"]: r for r in dim.collect()}
    assert got["OZEMPIC"]["rxnorm_confidence"] == "high" and got["OTHERDRUG"]["rxnorm_method"] == "unmatched" and got["WEGOVY"]["drug_class_atc"] == "Alimentary tract and metabolism"
    out = pairs.score_pairs(pairs.pair_table(cases.case_tables(s, dimension=dim)), ebgm=False).collect()
    a = {(r["drug_name_normalized"], r["adverse_event"]): r["a_drug_event"] for r in out}
    assert a == {("SEMAGLUTIDE", "EVENTA"): 27, ("OTHERDRUG", "EB"): 80}
    with pytest.raises(ValueError):
        pairs.score_pairs(spark.range(1))


def test_labels(spark):
    sections = spark.createDataFrame([("semaglutide", "adverse_reactions", "Nausea, diarrhea"), ("SEMAGLUTIDE", "boxed_warning", "risk of nausea"), ("semaglutide", "other", "cardiospasm"), ("metformin", "warnings", "acute  inflammation called pancreatitis")], "drug string, section string, text string")
    p = spark.createDataFrame([("Semaglutide", "NAUSEA"), ("semaglutide", "DIARRHOEA"), ("semaglutide", "CARDIOSPASM"), ("metformin", "PANCREATITIS ACUTE"), ("unlisted", "NAUSEA")], "drug_name_normalized string, adverse_event string")
    flags = labels.label_flags(p, sections)
    got = {(r["drug_name_normalized"], r["adverse_event"]): (r["label_status"], r["label_section"]) for r in flags.collect()}
    assert got == {("Semaglutide", "NAUSEA"): ("labeled", "boxed_warning"), ("semaglutide", "DIARRHOEA"): ("labeled", "adverse_reactions"), ("semaglutide", "CARDIOSPASM"): ("novel", None), ("metformin", "PANCREATITIS ACUTE"): ("labeled", "warnings"), ("unlisted", "NAUSEA"): ("unknown", None)}
    s = p.withColumn("disproportionality_flag", F.lit(True))
    folded = labels.fold_flags(labels.fold_flags(s, flags), flags)
    assert marts.summary_stats(folded).first()["novel_total"] == 1 and folded.count() == 5


def test_quality_checks(spark):
    schema = "drug_name_normalized string, adverse_event string, a_drug_event long, ror double, prr double, min_count_flag boolean"
    t = spark.createDataFrame([("A", "X", 5, 2.0, 1.0, False), ("A", "Y", 1, 1.0, 1.0, True)], schema)
    status = lambda df: {r["check"]: r["status"] for r in marts.quality_checks(df).collect()}
    assert set(status(t).values()) == {"pass"}
    assert status(t.unionByName(t))["pair_uniqueness"] == "fail"
    assert status(t.limit(0)) == {"required_columns": "pass", "row_count": "fail"}
    assert status(t.drop("prr")) == {"required_columns": "fail"}
    assert status(t.filter("min_count_flag"))["min_count_distribution"] == "warn"


def test_sample_has_all_deciles(spark):
    t = spark.range(1000).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("drug_name_normalized"), F.lit("E").alias("adverse_event"), F.col("id").cast("double").alias("ror"))
    got = [r["ror"] for r in marts.scatter_sample(t, 100).collect()]
    assert len(got) == len(set(got)) == 100
    assert all(sum(100 * k <= x < 100 * (k + 1) for x in got) >= 8 for k in range(10))
    assert got == [r["ror"] for r in marts.scatter_sample(t, 100).collect()] and marts.scatter_sample(t, 5000).count() == 1000
    assert {r["count"] for r in marts.ror_deciles(t).groupBy("decile").count().collect()} == {100}


def test_strata(spark):
    t = spark.createDataFrame([("F", 17.5), ("M", 70.0), (None, None)], "sex string, age double")
    got = [[(x["subgroup_type"], x["subgroup"]) for x in r[0]] for r in t.select(subgroups.strata_of(F.col("sex"), F.col("age"))).collect()]
    assert got == [[("sex", "female")], [("sex", "male"), ("age", "65+")], []]


def test_demo_cases_through_the_whole_pipeline(spark, tmp_path):
    from caselens.sources.demo import demo_silver

    s, gold = demo_silver(spark), Gold(spark, str(tmp_path))
    build.build_gold(spark, s, gold)
    texts = spark.createDataFrame([("metformin", "warnings", "Nausea and lactic acidosis")], "drug string, section string, text string")
    articles = spark.createDataFrame([(str(i), "Metformin", "nausea: a case report", "J", 2023, None) for i in range(3)], "pmid string, title string, abstract string, journal string, publication_year int, mesh_terms array<string>")
    people = spark.createDataFrame([("Metformin", "Biguanides", 960)], "medication_name_normalized string, drug_class string, unweighted_sample_count long")
    before = gold.read("emerging_signals").count()
    for _ in range(2):  # again changes nothing
        written = build.enrich_gold(spark, s, gold, texts, articles, population=people, base_least=30)
        got = gold.read("emerging_signals").orderBy("drug_name_normalized", "adverse_event").collect()
        assert len(got) == before and {r["population_component"] for r in got if r["drug_name_normalized"] == "metformin"} == {1.0}
        assert gold.read("signal_scores").filter("label_status = 'labeled'").count() == 2
    assert {"drug_label_flags", "subgroup_signals", "interaction_signals", "pubmed_evidence", "pubmed_support_summary"} <= set(written)
    assert gold.read("subgroup_signals").count() > 0 and gold.read("signal_scores_stats").first()["novel_total"] > 0


def test_marts_expire_and_are_published(spark, tmp_path):
    now = [0.0]
    gold = Gold(spark, str(tmp_path / "a"), str(tmp_path / "samples"), seconds=300, clock=lambda: now[0])
    with pytest.raises(FileNotFoundError):
        gold.read("m")
    spark.range(2).write.parquet(str(tmp_path / "samples/m.parquet"))
    assert gold.provenance("m") == "demo" and gold.provenance("x") == "none"
    with pytest.raises(FileNotFoundError):
        gold.read("m")  # its absence is remembered
    now[0] = 301
    assert gold.read("m").count() == 2
    gold.write(spark.range(3), "m")
    assert gold.provenance("m") == "pipeline" and gold.read("m").count() == 3
    assert [(r["mart"], r["rows"], r["source"], r["status"]) for r in serving.health(gold).collect()] == [("m", 3, "pipeline", "unknown")]
    to = str(tmp_path / "public")
    spark.range(9).write.parquet(f"{to}/old.parquet")
    assert gold.publish(to, "2024-01-01") == ["m"]
    gold.write(spark.range(4), "m")
    gold.publish(to, "2024-01-02", retired=("old",))
    assert spark.read.parquet(f"{to}/m.parquet").count() == 4 and spark.read.parquet(f"{to}/backup/2024-01-02/m.parquet").count() == 3
    assert lake.read_table(spark, f"{to}/old.parquet") is None and spark.read.parquet(f"{to}/backup/2024-01-02/old.parquet").count() == 9
    lake.write_envelope(spark, str(tmp_path / "e.json"), "http://x", "payload")
    assert spark.read.json(str(tmp_path / "e.json")).first()["data"] == "payload"


def test_labels_by_brute_force(spark):
    """Variants of one and several words, short ones, and parts of words."""
    rng = random.Random(5)
    words = ["oedema", "edema", "flu", "a", "pain", "painful", "acute", "leg", "gut ill", "hiv 1", "tumour", "of"]
    texts = [("d%d" % (i % 3), rng.choice(["warnings", "boxed_warning", "adverse_reactions"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))).upper()) for i in range(30)]
    events = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["  ", "Ill", "hiv  1", "1"]
    p = spark.createDataFrame([("D%d" % i, e) for i in range(4) for e in dict.fromkeys(events)], "drug_name_normalized string, adverse_event string")
    t = spark.createDataFrame(texts, "drug string, section string, text string")
    from caselens.functions import text as f

    merged = labels.merged_sections(t).select(F.upper("drug").alias("d"), "section", "rank", "text")
    want = p.join(merged, F.upper("drug_name_normalized") == F.col("d")).filter(f.event_in_section(F.col("text"), F.col("adverse_event"))).groupBy("drug_name_normalized", "adverse_event").agg(F.min_by("section", "rank").alias("s"))
    want = {tuple(r)[:2]: r["s"] for r in want.collect()}
    got = {(r["drug_name_normalized"], r["adverse_event"]): r["label_section"] for r in labels.label_flags(p, t).collect()}
    assert len(got) == p.count() and {k: v for k, v in got.items() if v} == want and len(want) > 50


def test_labels_whose_texts_fill_no_row(spark):
    """A section's texts together are 2.2 GB, more than a row holds, though each is short of words."""
    t = spark.range(0, 220, 1, 44).select(F.lit("d").alias("drug"), F.lit("warnings").alias("section"), F.rpad(F.concat(F.lit("nausea w"), "id"), 10_000_000, " ").alias("text"))
    p = spark.createDataFrame([("D", e) for e in ("NAUSEA", "rash")], "drug_name_normalized string, adverse_event string")
    got = {r["adverse_event"]: (r["label_section"], r["label_status"]) for r in labels.label_flags(p, t).collect()}
    assert got == {"NAUSEA": ("warnings", "labeled"), "rash": (None, "novel")}


def test_labels_of_long_tokens_and_across_texts(spark):
    """Needles at every place of tokens that are looked up in pieces, and short pieces that
    stand at the end of one text and at the start of the next, with empty texts between."""
    rng = random.Random(7)
    long = ["".join(rng.choice("abc") for _ in range(n)) for n in (255, 256, 257, 300, 511, 513, 900)]
    rows = [(f"l{i}", "warnings", x) for i, x in enumerate(long)]
    rows += [(f"s{i % 4}", rng.choice(["warnings", "boxed_warning"]), rng.choice(["", "a", "b 1", "1", "a b", " a"])) for i in range(24)] + [("none", "warnings", None)]
    events = sorted({x[i : i + n] for x in long for n in (4, 9) for i in range(0, len(x), 3)}) + [long[3][-5:], "a b", "b 1 1", "1  a", "a  a a", "b a", "a 1 b", "1 1 1 1"]
    t = spark.createDataFrame(rows, "drug string, section string, text string")
    p = spark.createDataFrame([(d, e) for d in sorted({r[0] for r in rows}) for e in dict.fromkeys(events)], "drug_name_normalized string, adverse_event string")
    from caselens.functions import text as f

    merged = labels.merged_sections(t).select(F.col("drug").alias("drug_name_normalized"), "section", "rank", "text")
    want = p.join(merged, "drug_name_normalized").filter(f.event_in_section(F.col("text"), F.col("adverse_event"))).groupBy("drug_name_normalized", "adverse_event").agg(F.min_by("section", "rank").alias("s"))
    want = {tuple(r)[:2]: r["s"] for r in want.collect()}
    for these in (p, p.filter(~F.col("adverse_event").contains(" "))):  # with and without needles that are no letters
        asked = {tuple(r) for r in these.collect()}
        got = {(r["drug_name_normalized"], r["adverse_event"]): r["label_section"] for r in labels.label_flags(these, t).collect()}
        assert set(got) == asked and {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if k in asked}
    assert sum(k[0][0] == "s" for k in want) > 8


@pytest.mark.parametrize("name", ["label_flags_folded", "label_shares"])
def test_label_queries_whose_texts_fill_no_row(spark, tmp_path, name):
    """As above, through a query's whole way."""
    from caselens import registry

    text = F.rpad(F.concat(F.lit("of the "), F.when(F.col("id") == 0, "nausea").otherwise("rash"), F.lit(" w"), "id"), 10_000_000, ".")
    t = spark.range(0, 220, 1, 44).select((F.col("id") * 4).alias("doc_id"), text.alias("text"), F.when(F.col("id") == 1, "src3").otherwise("d").alias("source"))
    t.write.option("compression", "zstd").parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    both = ("nausea", "rash")
    want = {
        "label_flags_folded": {("d", e, True, "labeled", False) for e in both} | {(d, e, False, "unknown", False) for d in ("src3", "unlisted") for e in both},
        "label_shares": {("labeled", 2, 50.0), ("unknown", 2, 50.0)},
    }
    assert got == want[name]
