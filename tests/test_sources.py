import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from caselens import config, session
from caselens.functions import clauses, dates, text
from caselens.sources import bronze, lake
from caselens.streaming import quarters


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    n = lambda s: one(spark, text.normalize_name(F.lit(s)))
    assert one(spark, text.clean_name(F.lit("Ozempic 0.5 mg subcutaneous pen"))) == "OZEMPIC"
    assert n("Wegovy 2.4 mg injection")["canonical"] == "semaglutide" and n("MOUNJARO")["drug_class"] == "Dual GIP/GLP-1 receptor agonists"
    assert (n("Some Weird Brand 10 MG")["normalized"], n("Some Weird Brand 10 MG")["confidence"]) == ("SOME WEIRD BRAND", "low")
    assert n("")["normalized"] == n(None)["normalized"] == "UNKNOWN"
    assert one(spark, text.normalize_event(F.lit("  Pancreatitis  acute "))) == "PANCREATITIS ACUTE"
    assert one(spark, text.americanize(F.lit("oesophageal haemorrhage tumour"))) == "esophageal hemorrhage tumor"
    assert one(spark, text.split_terms(F.lit("a, b\nA,,c"))) == ["A", "B", "C"]
    assert clauses.literal('a"b\\c') == '"a\\"b\\\\c"'


def test_relevance(spark):
    r = one(spark, text.relevance(F.lit("Metformin and lactic acidosis"), F.lit("A case report."), F.lit("metformin"), F.lit("Lactic acidosis")))
    assert r["relevance_score"] == 1.0 and r["adverse_context"]
    r = one(spark, text.relevance(F.lit("Acidosis, lactic"), F.lit(None), F.lit("metformin"), F.lit("lactic acidosis")))
    assert r["relevance_score"] == 0.35 and r["mentions_event"] and not r["mentions_drug"] and r["evidence_snippet"] == "Acidosis, lactic"


def test_dates(spark):
    t = spark.createDataFrame([("20230215",), ("2023",), ("20231345",), (None,)], "x string")
    assert [str(r[0]) for r in t.select(dates.quarter_label(dates.parse_compact(F.col("x")))).collect()] == ["2023Q1", "None", "None", "None"]
    got = [(r[0], str(r[2])) for r in dates.quarters_between(spark, "2022-11-15", "2023-04-01").collect()]
    assert got == [("2022Q4", "2022-12-31"), ("2023Q1", "2023-03-31"), ("2023Q2", "2023-06-30")]
    assert dates.expand_quarters(["2012q4..2013q2", "2013q1", "2020Q3"]) == [(2012, 4), (2013, 1), (2013, 2), (2020, 3)]
    with pytest.raises(ValueError):
        dates.expand_quarters(["2012q5"])


def test_ragged_rows_and_header(spark, tmp_path):
    (tmp_path / "DEMO.txt").write_bytes("﻿PRIMARYID$CASEID$sex$gndr_cod\n1$a$M\n2$b$F$X$y\n3$\"c$M$\n".encode("utf-8"))
    t = bronze.canonical(bronze.read_delimited(spark, str(tmp_path / "DEMO.txt")), "reports")
    assert t.columns == ["primaryid", "caseid", "patient_sex"]
    assert [tuple(r) for r in t.orderBy("primaryid").collect()] == [("1", "a", "M"), ("2", "b", "F"), ("3", '"c', "M")]
    assert bronze.read_delimited(spark, str(tmp_path / "none.txt")) is None


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("ascii/DEMO23Q1.txt", "primaryid\n1\n")
        z.writestr("ascii/x_DRUG_y.txt", "primaryid\n1\n")
        z.writestr("deleted/DELETE23Q1.txt", "9")
        z.writestr("deleted/DELETE2.txt", "10")
    sums = bronze.stage_archive(str(tmp_path / "q.zip"), str(tmp_path / "b"), 2023, 1)
    staged = tmp_path / "b/year=2023/quarter=Q1/ascii"
    assert list(sums) == ["reports", "drugs", "deleted_cases"] and sums["reports"] == hashlib.sha256((staged / "DEMO.txt").read_bytes()).hexdigest()
    assert json.loads((staged / "_staged.json").read_text())["sha256"] == sums
    assert bronze.stage_archive(str(tmp_path / "q.zip"), str(tmp_path / "c"), 2023, 1, spark) == sums
    assert (tmp_path / "c/year=2023/quarter=Q1/ascii/DELETED.txt").read_bytes() == (staged / "DELETED.txt").read_bytes()
    with pytest.raises(OSError):
        bronze.stage_archive(str(tmp_path / "q.zip"), str(tmp_path / "d"), 2023, 1, spare=1 << 60)
    for q in ("a22q1.zip", "b22q2.zip"):
        (tmp_path / q).write_bytes(b"")
    assert bronze.prune(str(tmp_path), 1) == ["a22q1.zip", "b22q2.zip"]
    assert (tmp_path / "b/year=2023/quarter=Q1/ascii/DELETED.txt").read_text() == "9\n10"
    assert bronze.quarters_in([f"x/year=2023/quarter=Q{q}/y" for q in (2, 1, 2)]) == [(2023, 1), (2023, 2)]


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract><Journal><Title>J</Title><JournalIssue><PubDate><Year>20x1</Year></PubDate></JournalIssue></Journal></Article><MeshHeadingList><MeshHeading><DescriptorName>M</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></S>")
    r = lake.read_articles(spark, str(tmp_path / "a.xml")).first()
    assert (r["pmid"], r["title"], r["abstract"], r["publication_year"], r["mesh_terms"]) == ("7", "T", "a b", None, ["M"])


def test_json_has_no_nan(spark, tmp_path):
    t = spark.createDataFrame([(1, float("nan"), None), (2, float("inf"), "x")], "a int, b double, c string")
    assert [json.loads(r[0]) for r in lake.as_json(t).orderBy("json").collect()] == [{"a": 1, "b": None, "c": None}, {"a": 2, "b": None, "c": "x"}]
    lake.write_csv(spark.createDataFrame([('q"x,y',)], "s string"), str(tmp_path / "csv"))
    assert '"q""x,y"' in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))


def test_stream_of_drops(spark, tmp_path):
    schema = "primaryid string, fda_date timestamp, term string"
    for i, day in enumerate(("2023-01-05", "2023-04-05", "2023-04-06")):
        spark.createDataFrame([(str(i), day, "X")], "primaryid string, d string, term string").select("primaryid", F.to_timestamp("d").alias("fda_date"), "term").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        quarters.into_silver(quarters.report_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    t = lake.read_table(spark, str(tmp_path / "out"))
    assert t.count() == 3 and {(r["year"], r["quarter"]) for r in t.collect()} == {(2023, "Q1"), (2023, "Q2")}
    q = quarters.quarterly_counts(quarters.report_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["quarter"]: r["n"] for r in spark.table("counts").groupBy("quarter").agg(F.sum("reports").alias("n")).collect()}
    assert got == {"2023Q1": 1, "2023Q2": 2}


def test_clauses(spark):
    day, sex = clauses.Field("receivedate"), clauses.Field("sex")
    assert day.span("2021-01-01", "20251231") == "receivedate:[20210101 TO 20251231]" and sex.code(clauses.SEXES["female"]) == "sex:2"
    assert clauses.all_of(clauses.any_of(clauses.Field("d").term('a"b'), clauses.Field("d").term("c")), "x:1") == '(d:"A\\"B" OR d:"C") AND (x:1)'
    m = clauses.mention(["metformin", "Glucophage"], ["OEDEMA OF LEG VEINS", "edema of leg veins"])
    q = m.text("Title/Abstract")
    assert q.startswith('(("metformin"[Title/Abstract] OR "Glucophage"[Title/Abstract]) AND ("OEDEMA OF LEG VEINS"[Title/Abstract] OR (OEDEMA[Title/Abstract] AND VEINS[Title/Abstract])')
    assert "of[" not in q and "leg[" not in q and q.count('"edema of leg veins"') == 1
    x = spark.createDataFrame([("glucophage and edema of both veins",), ("metformin: oedema of leg veins",), ("metformin and veins",), ("oedema of leg veins",)], "b string")
    assert [r[0] for r in x.select(m.column(F.col("b"))).collect()] == [True, True, False, False]
    t = spark.createDataFrame([("Ozempic", "2021-01-01", 17.0, "YR"), ("x", "2021-02-01", 17.0, "MON")], "n string, d string, a double, u string")
    got = t.select(clauses.is_one_of(F.col("n"), ["OZEMPIC"]), clauses.within(F.to_date("d"), "2021-01-01", "2021-01-31"), clauses.aged(F.col("a"), F.col("u"), 0, 17)).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False)]


def test_late_reports_are_left_out(spark, tmp_path):
    """Drops one after another in append mode: a day is told once the watermark has passed it,
    and a report that comes later counts nowhere."""
    schema, put = "primaryid string, fda_date timestamp, term string", tmp_path / "in"
    put.mkdir()
    q = quarters.quarterly_counts(quarters.report_stream(spark, str(put), schema), late="10 days")
    for i, day in enumerate(("2023-01-05", "2023-06-01", "2023-01-05", "2024-01-01", "2024-06-01")):
        spark.createDataFrame([(str(i), day, "X")], "primaryid string, d string, term string").select("primaryid", F.to_timestamp("d").alias("fda_date"), "term").write.mode("append").parquet(str(put))
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(str(r["day"])[:10], r["reports"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("2023-01-05", 1) in got and ("2023-06-01", 1) in got and ("2023-01-05", 2) not in got


def test_settings_from_files(spark, tmp_path):
    (tmp_path / "s.yml").write_text("drugs:\n  Aspirin: {class: Salicylates, aliases: [Bayer, cardio]}\nthresholds: {minimum_reports: 5}\nweights: {disproportionality: 0.4, trend_anomaly: 0.15}\nquarters: ['2012q4..2013q2', 2020Q3]\nsurvey: {age: RIDAGEYR}\n")
    for s in (config.read_yaml(str(tmp_path / "s.yml")), config.read_yaml(str(tmp_path / "s.yml"), spark)):
        d = config.domain_from(s)
        assert d.aliases() == {"ASPIRIN": "aspirin", "BAYER": "aspirin", "CARDIO": "aspirin"} and d.classes() == {"aspirin": "Salicylates"}
        assert config.thresholds_from(s).minimum_reports == 5 and config.weights_from(s).disproportionality == 0.4
        assert config.quarters_from(s) == [(2012, 4), (2013, 1), (2013, 2), (2020, 3)] and config.survey_columns_from(s) == {"age": "RIDAGEYR"}
        assert config.literature_terms_from(s) == config.ADVERSE_TERMS
    with pytest.raises(ValueError):
        config.thresholds_from({"thresholds": {"minimum_report": 1}})
    with pytest.raises(ValueError):
        config.weights_from({"weights": {"seriousness": 0.9}})


def test_formats(spark):
    t = spark.createDataFrame([(1.5,), (-0.25,), (None,)], "x double")
    got = [tuple(r) for r in t.select(text.ratio(F.col("x")), text.signed_percent(F.col("x"))).collect()]
    assert got == [("1.50×", "+150%"), ("-0.25×", "-25%"), ("—", "—")]
    now = F.to_timestamp(F.lit("2024-01-10 12:00:00"))
    ago = [one(spark, text.relative_time(F.to_timestamp(F.lit(x)), now)) for x in ("2024-01-10 11:59:30", "2024-01-10 11:30:00", "2024-01-10 02:00:00", "2024-01-01 12:00:00")]
    assert ago == ["just now", "30m ago", "10h ago", "9d ago"] and one(spark, text.title_case(F.lit("ACUTE pain"))) == "Acute Pain"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getConf": staticmethod(lambda: type("D", (), {"get": staticmethod(lambda *a: None)})), "applicationId": "a", "master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_dir(Session)
    for master, ok in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("yarn", False)):
        Session.sparkContext.master = master
        if ok:
            assert session.shared_dir(Session).startswith("file://")
        else:
            with pytest.raises(ValueError):
                session.shared_dir(Session)


def test_temporary_tables_go(spark):
    kept = session.stored(spark.range(3), "kept")
    with session.temporary(spark):
        gone = session.stored(spark.range(5), "gone")
        assert gone.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()
