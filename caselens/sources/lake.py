"""Tables and marts of a lake: reading, writing, optional tables, views, JSON and CSV."""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table with its partitions; None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def has_table(spark: SparkSession, path: str) -> bool:
    return read_table(spark, path) is not None


def write_silver(t: DataFrame, path: str) -> None:
    """By year and quarter; only the partitions written are replaced."""
    t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter").parquet(path)


def is_ingested(spark: SparkSession, path: str, year: int, quarter: int) -> bool:
    return has_table(spark, f"{path}/year={year}/quarter=Q{quarter}")


def read_xpt(spark: SparkSession, path: str) -> DataFrame:
    """A SAS transport file, parsed on the driver: surveys' files are of a few MB."""
    import pandas as pd

    return spark.createDataFrame(pd.read_sas(path, format="xport", encoding="latin-1"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract, journal, publication_year, mesh_terms) from article XML."""
    schema = """MedlineCitation struct<PMID:string, Article:struct<ArticleTitle:string,
      Abstract:struct<AbstractText:array<string>>, Journal:struct<Title:string, JournalIssue:struct<PubDate:struct<Year:string>>>>,
      MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>>"""
    t = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    a = "MedlineCitation.Article"
    return t.select(
        F.col("MedlineCitation.PMID").alias("pmid"),
        F.col(f"{a}.ArticleTitle").alias("title"),
        F.array_join(f"{a}.Abstract.AbstractText", " ").alias("abstract"),
        F.col(f"{a}.Journal.Title").alias("journal"),
        F.expr(f"try_cast({a}.Journal.JournalIssue.PubDate.Year as int)").alias("publication_year"),
        F.col("MedlineCitation.MeshHeadingList.MeshHeading.DescriptorName").alias("mesh_terms"),
    )


class Gold:
    """Marts below a folder, with a second folder of samples to fall back on. What is read is
    remembered, absence too, for so many seconds."""

    def __init__(self, spark: SparkSession, root: str, sample_root: str | None = None, seconds: float = 300.0, clock=time.monotonic):
        self.spark, self.root, self.sample_root = spark, root.rstrip("/"), sample_root
        self.seconds, self.clock = seconds, clock
        self._loaded: dict[str, tuple[float, DataFrame | None]] = {}

    def write(self, t: DataFrame, name: str, files: int | None = None) -> None:
        """Overwrites a mart; files: how many, for marts that are small."""
        (t.coalesce(files) if files else t).write.mode("overwrite").parquet(f"{self.root}/{name}.parquet")
        self._loaded.pop(name, None)

    def source(self, name: str) -> str | None:
        """Where a mart would be read from."""
        for root in (self.root, self.sample_root):
            if root and has_table(self.spark, f"{root}/{name}.parquet"):
                return f"{root}/{name}.parquet"
        return None

    def exists(self, name: str) -> bool:
        return self.source(name) is not None

    def provenance(self, name: str) -> str:
        """`pipeline` for a mart of the folder, `demo` for one of the samples, else `none`."""
        path = self.source(name)
        return "none" if path is None else "pipeline" if path.startswith(f"{self.root}/") else "demo"

    def read(self, name: str) -> DataFrame:
        """A mart, remembered with its absence until it is written, forgotten or too old."""
        if name not in self._loaded or self.clock() - self._loaded[name][0] > self.seconds:
            path = self.source(name)
            self._loaded[name] = (self.clock(), self.spark.read.parquet(path) if path else None)
        if (t := self._loaded[name][1]) is None:
            raise FileNotFoundError(name)
        return t

    def publish(self, to: str, stamp: str, retired: tuple[str, ...] = ()) -> list[str]:
        """Copies the marts to another folder: what stands there under a mart's name moves to
        backup/<stamp> first, retired marts too, which are not replaced. Returns the marts."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(to).getFileSystem(conf)
        for name in (*self.names(), *retired):
            old = path(f"{to}/{name}.parquet")
            if fs.exists(old):
                fs.mkdirs(path(f"{to}/backup/{stamp}"))
                fs.rename(old, path(f"{to}/backup/{stamp}/{name}.parquet"))
        for name in self.names():
            self.read(name).write.parquet(f"{to}/{name}.parquet")
        return self.names()

    def forget(self) -> None:
        self._loaded.clear()

    def names(self) -> list[str]:
        jvm = self.spark._jvm
        out: dict[str, None] = {}
        for root in (self.root, self.sample_root):
            if root:
                path = jvm.org.apache.hadoop.fs.Path(f"{root}/*.parquet")
                for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []:
                    out.setdefault(f.getPath().getName().removesuffix(".parquet"))
        return sorted(out)

    def register(self, database: str | None = None) -> list[str]:
        """A view for each mart, or an external table in the database."""
        for name in self.names():
            if database:
                self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
                self.spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
                self.spark.catalog.createTable(f"{database}.{name}", path=self.source(name), source="parquet")
            else:
                self.read(name).createOrReplaceTempView(name)
        return self.names()

    def query(self, sql: str, args: list | dict | None = None) -> DataFrame:
        """SQL over the marts as views, with bound parameters."""
        self.register()
        return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)


def as_json(t: DataFrame) -> DataFrame:
    """(json): a JSON object for each row, NaN and infinities as null, nulls kept."""
    infinite = (float("inf"), float("-inf"))
    clean = [F.when(F.isnan(c) | F.col(c).isin(*infinite), None).otherwise(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in t.dtypes]
    return t.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(t: DataFrame, path: str) -> None:
    t.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def cache_envelope(source_url: str, payload: str) -> dict:
    """What a cached response is stored as."""
    return {"_source_url": source_url, "_ingest_timestamp": datetime.now(timezone.utc).isoformat(), "data": payload}


def write_envelope(spark: SparkSession, path: str, source_url: str, payload: str) -> None:
    """Stores a response in its envelope as one JSON file, on any of Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(cache_envelope(source_url, payload)).encode()))
    finally:
        out.close()
