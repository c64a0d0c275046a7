"""Session settings, and where intermediate tables go."""

from __future__ import annotations

import atexit
import contextlib
import functools
import importlib.util
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(cores: str = "*", shuffle_partitions: int = 8, app: str = "caselens", **more: str) -> SparkSession:
    """A local session for tests and benches; on a cluster spark-submit makes the session."""
    conf = SETTINGS | {"spark.master": f"local[{cores}]", "spark.app.name": app, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g"}
    return SparkSession.builder.config(map=conf | more).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where a local
    session names none, as in tests, a folder below the machine's temporary one, which goes
    when the process ends; on a cluster no such folder is shared, and a missing setting is an
    error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the machines of this cluster share")
        there = f"file://{_own_dir()}"
    return f"{there.rstrip('/')}/caselens-{spark.sparkContext.applicationId}"


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="caselens-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


#: Tables written inside blocks of temporary(), the innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, so
    that a lost executor costs no more than the tasks that read the table. Tables stay until
    release(), or until a block of temporary() ends; the caller decides."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _open:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Deletes what stored() writes inside the block when it ends; what is read of it must be
    written elsewhere, or stored outside the block, before."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open[:] = [x for x in _open if x is not made]
        for path in made:
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes what stored() has written in this application; results not yet read are lost."""
    _delete(spark, shared_dir(spark))
    _kept.clear()


_kept: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, name: str, inputs: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written once for an application and its inputs as they stand, and read
    from then on: inputs count as changed with their time or size."""
    key = (name, spark.sparkContext.applicationId, *(_standing(spark, p) for p in inputs))
    if key not in _kept:
        _kept[key] = stored(make(), name)
    return _kept[key]


def _standing(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return path, fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if not getattr(sc, "_caselens_shipped", False):
        root = Path(importlib.util.find_spec("caselens").origin).parent
        out = os.path.join(tempfile.mkdtemp(), "caselens-src.zip")  # the driver's own; Spark sends it on
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(out)
        sc._caselens_shipped = True
    return spark
