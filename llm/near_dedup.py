"""Near copies among whole documents: exact Jaccard similarity of their sets of five-word shingles.

Words are taken without regard to ASCII case; a text of fewer words is one shingle. Candidates come from two
searches. The first is op4's SimHash, with fingerprints of five-word shingles: texts of one fingerprint meet the one of
the smallest hash among them, and these meet along the links between fingerprints within RADIUS bits, which are
all found. Two texts at 0.8 differ by some 10 of 64 bits, so that search alone would miss most of them; the second
takes the texts that share a band of MinHash signatures, as in line dedup with documents in place of lines: a pair
at 0.8 is found with a chance of 0.995, at 0.85 of 0.9997. Candidates of both are compared exactly, as fingerprints
weigh shingles by their repeats and the similarity does not, and are joined by components.

Null texts and texts without words are copies of each other. Rows of equal text are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import written
from .line_dedup import linked, meetings, paired
from .textarrays import Texts, combine, plain, ragged

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of two fingerprints that may differ.
RADIUS = 3
WORDLESS = r"^[\x20\x09-\x0D]*$"


def word_shingles(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit names of the word shingles of byte ranges (each with a word), where each range's begin, and how many it has."""
    size = end - first
    raw = data[np.repeat(first, size) + ragged(size)] if len(size) else data[:0].copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    x = Texts.__new__(Texts)
    x.data, x.starts, x.rows = raw, np.r_[0, np.cumsum(size)], len(size)
    lo, hi = x.words()
    words, count = x.names(lo, hi), x.per_row(lo)
    n = np.where(count, np.maximum(count - SHINGLE + 1, 1), 0)
    at = np.repeat(np.cumsum(count) - count, n) + ragged(n)
    stop = np.repeat(np.cumsum(count), n)
    names = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < stop
        names[inside] = combine(names[inside], words[at[inside] + k])
    return names, np.cumsum(n) - n, n


def _units(batch: pa.RecordBatch) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts: first byte, end, name."""
    x = Texts(plain(batch.column("text")))
    return x, x.starts[:-1], x.starts[1:], batch.column("name").to_numpy().view(np.uint64)


def fingerprint_pairs(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a < b of text hashes of docs (doc_id, text) to compare, by fingerprints within radius bits."""
    marks = written(simhash.fingerprints(docs, SHINGLE).select("text_hash", "fp").distinct(), "fingerprints")
    least = written(marks.groupBy("fp").agg(F.min("text_hash").alias("least")), "distinct")
    equal = marks.join(least, "fp").filter("text_hash <> least").select(F.col("least").alias("a"), F.col("text_hash").alias("b"))
    to_a, to_b = least.toDF("a", "x"), least.toDF("b", "y")
    near = written(simhash.links(least.select("fp"), radius), "near_fingerprints").join(to_a, "a").join(to_b, "b")
    return equal.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, component_id (smallest doc_id that links reach) for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    bare = F.coalesce(F.col("text").rlike(WORDLESS), F.lit(True))
    worded = docs.filter(~bare).select(F.col("text_hash").alias("name"), "text")
    met = written(meetings(worded, docs.count(), word_shingles, _units, "name"), "meetings")
    pairs, wanted = paired(met, fingerprint_pairs(docs.filter(~bare).select("doc_id", "text")))
    texts = worded.join(wanted, "name").dropDuplicates(["name"]).select("name", F.char_length("text").alias("chars"), "text")
    roots = linked(met, pairs, written(texts, "texts"), similarity, word_shingles)
    marks = docs.select("doc_id", "text_hash", bare.alias("bare")).join(roots, F.col("text_hash") == F.col("node"), "left")
    marks = written(marks.select("doc_id", "text_hash", F.when(F.col("bare"), F.lit(0)).otherwise(F.coalesce("root", "text_hash")).alias("root")), "marks")
    # written, so that the join sees its size and adaptive execution can split a large component
    least = written(marks.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return marks.join(least, "root").select("doc_id", "text_hash", F.col("root").alias("component"), "component_id")
