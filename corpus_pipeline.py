"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents, and leave out any others. Null and empty texts are rejected by the quality rules; the
later stages take them as the operators do. Repeated rows are kept or go together in the quality rules and line dedup;
near dedup leaves one of them. An empty table passes through all stages. A very long text is held whole by one task.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import line_dedup, mixing, near_dedup as near, packing, quality
from llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judged(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur, exactly or nearly, in an earlier place; those that lose every line go."""
    out = line_dedup.deduplicated(docs.select(COLUMNS), shingle=line_dedup.FINE)
    changed = F.col("n_removed") > 0
    return out.filter(~changed | (F.col("n_removed") < F.col("n_lines"))).withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets 0.8 alike, found by SimHash and by MinHash bands and compared exactly: the one with the smallest id (of equal ids the smallest text hash); of equal rows one."""
    found = written(near.near_duplicates(docs.select(COLUMNS)), "near")
    one = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("keep")).select(F.col("keep.doc_id").alias("d"), F.col("keep.text_hash").alias("h"))
    kept = docs.select(*COLUMNS, F.xxhash64("text").alias("h0")).join(one, (F.col("h0") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    return kept.groupBy("doc_id", "h0").agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("row")).select("doc_id", "row.*").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    taken = rows.join(mixing.mix(rows, row=True).filter("copies > 0").select("row", "copies"), "row")
    return taken.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 ids."""
    return packing.pack(docs.select(COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: SimHash, MinHash, balanced sampling and packing have no SQL form; tests hold each stage against its operator or brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
