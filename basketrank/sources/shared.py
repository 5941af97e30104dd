"""Tables in the folder that all executors see, to cut lineage between iterations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where it is not shipped with the job (--py-files)."""
    here = str(Path(__file__).resolve().parent.parent.parent)
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, here]))


def place(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where none is set: a folder of this machine, if all tasks run on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif re.match(r"local($|\[)", spark.sparkContext.master):
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a new shared path and read again."""
    spark = df.sparkSession
    importable(spark)
    path, before = place(spark, name), spark.conf.get(_CLEANUP, None)
    # what is written needs its shuffle files no more
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 8):
    """Arrow batches of few rows while rows that are packed blocks are mapped."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clear(spark: SparkSession) -> int:
    """Deletes what place has named so far in this process, once results that read it are written; how many paths."""
    n = len(_made)
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
