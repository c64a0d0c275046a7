"""A corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import ngram_join, packing, quality, secret_scan, toxicity
from caselens.session import shared_dir, temporary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are judged by statistics
    of 0; repeated rows and rows with a null doc_id each by their own text; an empty table
    stays empty; other columns come through."""
    return quality.kept(docs, _labels(spark, sf_dir))


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that count as toxic go. Null and empty texts stay; repeated rows and rows
    with a null doc_id are judged each by their own text; an empty table stays empty."""
    return toxicity.kept(docs, _labels(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest doc_id stays, of repeated
    rows one. Null and empty texts are no copies of each other, and rows with a null doc_id
    stay; texts of one doc_id that differ are documents of their own."""
    return ngram_join.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become marks, of live ones or of copied examples. Null and empty texts
    and repeated rows stay as they are; an empty table stays empty."""
    return secret_scan.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences and places. A null or empty text is one
    piece of the end id alone; repeated rows are packed each; no rows give none."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxic_texts),
    ("ngram_jaccard_join", near_copies),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted classifiers and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is a written table, read by the next. A
    stage's intermediate tables go when it ends, and its result when the next one stands; the
    last result is the caller's, until caselens.session.release()."""
    with contextlib.ExitStack() as last:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for k, (name, stage) in enumerate(STAGES):
            with temporary(spark):
                out = stage(spark, docs, sf_dir)
                docs = _written(out, name)
            if k + 1 < len(STAGES):
                last.callback(_dropped, spark, docs)
    return docs


def _written(out: DataFrame, name: str) -> DataFrame:
    """A table outside of what a stage's end deletes."""
    spark = out.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _dropped(spark: SparkSession, docs: DataFrame) -> None:
    for path in {f.rsplit("/", 1)[0] for f in docs.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
