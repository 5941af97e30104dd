"""What the operators share: tables, the folder that all executors see, helpers for Arrow batches."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_made: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word of every contract: no space and none of the bytes 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where it is not shipped with the job (--py-files)."""
    here = str(Path(__file__).resolve().parent.parent)
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, here]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder of the session. Where none is set: a folder of this machine, if all tasks run on it."""
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


#: Names that Hadoop's connectors have for stores of Arrow's file systems.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI of Hadoop's, and the path in it; for files that are no tables."""
    scheme, colon, rest = uri.partition(":")
    try:
        return pafs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + colon + rest)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"files can't be written to {uri}: name a folder of another store as spark.checkpoint.dir ({e})") from e


def file_folder(spark: SparkSession, name: str) -> str:
    """shared_folder for files that tasks write themselves; a store that they can't open is refused here, before any job."""
    path = shared_folder(spark, name)
    store(path)
    return path


def quoted(column: str) -> str:
    """A column's name as an expression, whatever it has in it."""
    return "`" + column.replace("`", "``") + "`"


def clear(spark: SparkSession) -> int:
    """Deletes what shared_folder has named so far in this process, once results that read it are written; how many paths."""
    n = len(_made)
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: short lineage, and nothing is lost with an executor."""
    spark = df.sparkSession
    importable(spark)
    path, before = shared_folder(spark, name), spark.conf.get(_CLEANUP, None)
    # what is written needs its shuffle files no more
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text="text"):
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary for each length, cut from the consecutive bytes of values."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def release() -> None:
    """Gives memory that a worker has freed back to the machine; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def releasing(f: Callable) -> Callable:
    """A mapInArrow function that leaves no freed memory behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def map_slices(df: DataFrame, f: Callable, schema: str | StructType, *columns: str, limit: int | None = None, last: Callable = release) -> DataFrame:
    """mapInArrow in which f(batch) sees at most a few MB of the text column at a time; last() ends each task."""
    from .textarrays import SLICE_BYTES, plain, slices

    importable(df.sparkSession)
    size = limit or SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column("text"))
            for lo, hi in slices(texts, size):
                out = f(batch.slice(lo, hi - lo))
                yield from out if isinstance(out, Iterator) else [out]
            del batch, texts
            release()
        last()

    return df.select(*columns).mapInArrow(run, schema)
