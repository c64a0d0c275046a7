"""Delimited report extracts: reading, canonical columns, quarters, and silver tables."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import shutil
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions import dates, text

#: Raw to canonical column names of each table, lower case; of several raw names for one
#: canonical name the first present counts. Fixed values.
COLUMNS: dict[str, dict[str, str]] = {
    "reports": {"primaryid": "primaryid", "caseid": "caseid", "caseversion": "case_version", "fda_dt": "fda_date", "event_dt": "event_date", "rept_dt": "receive_date", "sex": "patient_sex", "gndr_cod": "patient_sex", "age": "patient_age", "age_cod": "patient_age_unit", "reporter_country": "reporter_country", "occr_country": "reporter_country"},
    "drugs": {"primaryid": "primaryid", "caseid": "caseid", "drug_seq": "drug_seq", "role_cod": "role_code", "drugname": "drug_name_raw"},
    "reactions": {"primaryid": "primaryid", "caseid": "caseid", "pt": "reaction_term", "outc_cod": "reaction_outcome"},
    "outcomes": {"primaryid": "primaryid", "caseid": "caseid", "outc_cod": "outcome_code"},
    "indications": {"primaryid": "primaryid", "caseid": "caseid", "indi_drug_seq": "drug_seq", "indi_pt": "indication"},
    "therapies": {"primaryid": "primaryid", "caseid": "caseid", "dsg_drug_seq": "drug_seq", "start_dt": "therapy_start_date", "end_dt": "therapy_end_date", "dur": "therapy_duration", "dur_cod": "therapy_duration_unit"},
    "report_sources": {"primaryid": "primaryid", "caseid": "caseid", "rpsr_cod": "report_source_code"},
}
#: File names of the tables. Fixed values.
FILES = {"reports": "DEMO", "drugs": "DRUG", "reactions": "REAC", "outcomes": "OUTC", "indications": "INDI", "therapies": "THER", "report_sources": "RPSR"}
DATES = ("fda_date", "event_date", "receive_date")


def read_delimited(spark: SparkSession, path: str) -> DataFrame | None:
    """A $-delimited file with a header, all strings; None where there is none. Quotes mean
    nothing; rows too long are cut and rows too short filled with nulls."""
    try:
        return spark.read.option("sep", "$").option("header", True).option("encoding", "ISO-8859-1").option("quote", "").option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def canonical(raw: DataFrame, table: str) -> DataFrame:
    """The table's columns under their canonical names, in the map's order."""
    present = {c.replace("ï»¿", "").replace("﻿", "").strip().lower(): c for c in raw.columns}
    chosen: dict[str, str] = {}
    for source, name in COLUMNS[table].items():
        if source in present:
            chosen.setdefault(name, present[source])
    return raw.select(*(F.col(f"`{source}`").alias(name) for name, source in chosen.items()))


def read_quarter(spark: SparkSession, root: str, table: str, year: int, quarter: int) -> DataFrame | None:
    raw = read_delimited(spark, f"{root}/year={year}/quarter=Q{quarter}/ascii/{FILES[table]}.txt")
    if raw is None:
        return None
    return canonical(raw, table).withColumns({"year": F.lit(year), "quarter": F.lit(f"Q{quarter}"), "faers_quarter": F.lit(f"{year}Q{quarter}")})


def deleted_cases(spark: SparkSession, path: str) -> DataFrame:
    """Distinct case ids of deletion lists: the first field of each line; no blanks or header."""
    try:
        lines = spark.read.option("encoding", "ISO-8859-1").text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "caseid string")
    t = lines.select(F.trim(F.get(F.split("value", r"\$"), F.lit(0))).alias("caseid"))
    return t.filter((F.col("caseid") != "") & ~F.lower("caseid").isin("caseid", "case_id", "primaryid")).distinct()


def quarters_in(paths: list[str]) -> list[tuple[int, int]]:
    """Quarters named by paths like .../year=2023/quarter=Q1/..., sorted, each once."""
    found = {(int(m[1]), int(m[2])) for p in paths if (m := re.search(r"year=(\d{4})/quarter=Q([1-4])", p))}
    return sorted(found)


def discover_quarters(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """Quarters below the folder, listed by Spark's file system, wherever it is."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/year=*/quarter=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return quarters_in([f.getPath().toString() + "/" for f in (found or [])])


def silver_table(spark: SparkSession, root: str, table: str, quarters: list[tuple[int, int]]) -> DataFrame | None:
    """A table's quarters by name, columns that a quarter lacks as nulls."""
    out = None
    for year, quarter in quarters:
        t = read_quarter(spark, root, table, year, quarter)
        if t is not None:
            out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        return None
    if table == "reports":
        out = out.withColumns({c: dates.parse_compact(F.col(c)) for c in DATES if c in out.columns})
    elif table == "drugs":
        n = text.normalize_name(F.col("drug_name_raw"))
        out = out.withColumn("_n", n).withColumns({"drug_name_normalized": F.col("_n.normalized"), "drug_class": F.col("_n.drug_class"), "normalization_method": F.col("_n.method"), "normalization_confidence": F.col("_n.confidence")}).drop("_n")
    elif table == "reactions":
        out = out.withColumn("reaction_term_normalized", text.normalize_event(F.col("reaction_term")))
    return out


def silver_deleted(spark: SparkSession, root: str, quarters: list[tuple[int, int]]) -> DataFrame:
    out = spark.createDataFrame([], "caseid string, year int, quarter string, faers_quarter string")
    for year, quarter in quarters:
        t = deleted_cases(spark, f"{root}/year={year}/quarter=Q{quarter}/ascii/DELETED*.txt")
        out = out.unionByName(t.withColumns({"year": F.lit(year), "quarter": F.lit(f"Q{quarter}"), "faers_quarter": F.lit(f"{year}Q{quarter}")}))
    return out


def member_for(names: list[str], table: str, year: int, quarter: int) -> str | None:
    """The member of an archive that holds a table: by its usual names, else by substring."""
    stem = f"{FILES[table]}{year % 100:02d}Q{quarter}".upper()
    for n in names:
        if Path(n).name.upper() == f"{stem}.TXT":
            return n
    return next((n for n in names if FILES[table] in Path(n).name.upper() and n.upper().endswith(".TXT")), None)


def write_extracts(t: DataFrame, root: str, table: str) -> None:
    """Writes rows as delimited extracts into the bronze layout, by their columns year and
    quarter: one pass over the rows, then each quarter's folder gets its file name."""
    spark, there = t.sparkSession, f"{root.rstrip('/')}/writing-{uuid.uuid4().hex}"
    t.write.partitionBy("year", "quarter").option("sep", "$").option("header", True).csv(there)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(there).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(path(f"{there}/year=*/quarter=*")) or []:
        quarter = found.getPath()
        to = path(f"{root}/{quarter.getParent().getName()}/{quarter.getName()}/ascii")
        fs.mkdirs(to)
        fs.rename(quarter, path(to, f"{FILES[table]}.txt"))
    fs.delete(path(there), True)


def stage_archive(archive: str, root: str, year: int, quarter: int, spark: SparkSession | None = None, spare: int = 0) -> dict[str, str]:
    """Unpacks an archive's tables, and its deletion lists as one, into the bronze layout;
    returns {table: sha256 of its file} and leaves the same as JSON beside them.

    Members are copied in parts, so none has to fit in memory; the archive is where the
    driver is. With spark, root may be any path of Hadoop's file systems. OSError where a
    local disk would be left with less than `spare` bytes.
    """
    base = f"{root}/year={year}/quarter=Q{quarter}/ascii"
    with zipfile.ZipFile(archive) as z:
        if spark is None:
            Path(base).mkdir(parents=True, exist_ok=True)
            needed = sum(i.file_size for i in z.infolist()) + spare
            if (free := shutil.disk_usage(base).free) < needed:
                raise OSError(f"{needed} bytes are needed below {base}, {free} are free")
        names, sums = z.namelist(), {}
        found = {table: [m] for table in FILES if (m := member_for(names, table, year, quarter))}
        if gone := [n for n in names if "DELETE" in n.upper() and n.upper().endswith(".TXT")]:
            found["deleted_cases"] = gone
        for table, members in found.items():
            sums[table] = _copied(z, members, f"{base}/{FILES.get(table, 'DELETED')}.txt", spark)
        note = json.dumps({"archive": Path(archive).name, "year": year, "quarter": quarter, "sha256": sums}, sort_keys=True)
        with _writer(f"{base}/_staged.json", spark) as out:
            out(note.encode())
    return sums


def _copied(z: zipfile.ZipFile, members: list[str], path: str, spark: SparkSession | None) -> str:
    """The members one after another, a line end between them, as one file; its sha256."""
    total = hashlib.sha256()
    with _writer(path, spark) as out:
        for k, member in enumerate(members):
            if k:
                out(b"\n")
                total.update(b"\n")
            with z.open(member) as src:
                while part := src.read(1 << 20):
                    out(part)
                    total.update(part)
    return total.hexdigest()


@contextlib.contextmanager
def _writer(path: str, spark: SparkSession | None):
    if spark is None:
        with open(path, "wb") as f:
            yield f.write
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        yield lambda b: out.write(bytearray(b))
    finally:
        out.close()


def prune(root: str, keep: int) -> list[str]:
    """Deletes archives (*.zip) below a local folder but the `keep` latest by name."""
    old = sorted(Path(root).glob("**/*.zip"), key=lambda p: p.name)[: -keep or None]
    for p in old:
        p.unlink()
    return [p.name for p in old]
