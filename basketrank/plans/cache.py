"""Features kept as Parquet by what they were made from.

An entry's name comes from the rows of both frames, not from where or when they were read. An entry counts once its manifest is
there, which is written after all files; what differs from its manifest (files, lengths, rows) is removed and made
again. Writers at the same time make files of their own; the manifest of the last one counts, and is as good.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Folder
from .registry import REGISTRY

#: Bits of a hash that go into one sum: with so few, a long holds the sum of 2^43 rows.
_PART = 20


def fingerprint(df: DataFrame) -> str:
    """Equal for equal rows in any order and partitioning, repeats counted: sums of two hashes of each row, from one scan.

    Which columns are null is hashed too (xxhash64 passes over nulls). Two tables that differ agree with odds of about 2^-120.
    """
    columns = sorted(df.columns)
    values: list[Column] = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values]) if values else F.lit("")
    sums = []
    for seed in (0x5EED, 0xF00D):
        h = F.xxhash64(F.lit(seed), *values, nulls)
        # a second pass mixes rows that differ in one column
        h = F.xxhash64(h, F.lit(seed))
        sums += [F.sum(F.shiftrightunsigned(h, _PART * k).bitwiseAND((1 << _PART) - 1)) for k in range(-(-64 // _PART))]
    found = df.agg(F.count("*"), *sums).first()
    return "-".join(str(x or 0) for x in found)


def _described(value) -> object:
    """A value of a configuration as JSON can hold it; a table by its schema and rows."""
    if isinstance(value, DataFrame):
        return [value.schema.json(), fingerprint(value)]
    if isinstance(value, dict):
        return {str(k): _described(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_described(v) for v in (sorted(value, key=str) if isinstance(value, set) else value)]
    return value


def key(name: str, history: DataFrame, target: DataFrame, config: dict) -> str:
    """The features that are made for a name, schemas and rows of both frames, and the configuration."""
    text = json.dumps([REGISTRY.order([name]), *[[df.schema.json(), fingerprint(df)] for df in (history, target)], _described(config)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def _found(spark: SparkSession, entry: Folder) -> DataFrame | None:
    """The rows of an entry that is as its manifest says; None where there is none. One that is not goes."""
    text = entry.read("manifest")
    if text is None:
        return None
    try:
        made = json.loads(text)
        if entry.lengths(made["data"]) != made["files"]:
            raise ValueError("files are missing or cut")
        rows = spark.read.parquet(f"{entry.path}/{made['data']}")
        if rows.schema.json() != made["schema"] or fingerprint(rows) != made["rows"]:
            raise ValueError("rows differ")
        return rows
    except Exception:  # whatever a damaged file makes the readers raise
        entry.remove()
        return None


def _made(spark: SparkSession, entry: Folder, df: DataFrame) -> DataFrame:
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{entry.path}/{name}")
    rows = spark.read.parquet(f"{entry.path}/{name}")
    entry.put("manifest", json.dumps({"data": name, "files": entry.lengths(name), "schema": rows.schema.json(), "rows": fingerprint(rows)}))
    return rows


def cached(folder: str, name: str, history: DataFrame, target: DataFrame, config: dict | None = None) -> DataFrame:
    """target with the columns of a feature, from the folder if they are there; target needs a unique idx."""
    spark, f = target.sparkSession, REGISTRY.features[name]
    entry = Folder(spark, f"{folder}/{key(name, history, target, config or {})}")
    columns = [c for c in f.numeric + f.categorical if c not in target.columns]
    rows = _found(spark, entry)
    if rows is None:
        rows = _made(spark, entry, REGISTRY.features_of(history, target, [name], config).select("idx", *columns))
    return target.join(rows, "idx", "left")
