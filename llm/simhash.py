"""SimHash fingerprints and the components of fingerprints within a small Hamming radius.

Comparison is exact. Fingerprints meet in tiles: two that differ in at most r bits agree on at least
one of r + 1 blocks of bits, so a tile holds those with one block in common. A tile with more than
TILE distinct fingerprints is cut by population count, and only parts whose counts differ by at most
r meet; parts that are still too large are cut again by a hash. Inside a task, tiles are compared by
exclusive-or and bit counts in numpy, and tile pairs out of population-count range are skipped.

A null text is one without words (fingerprint zero); nulls in doc_id are carried and never the
smallest id of a component unless there is no other. Exact copies meet as one fingerprint. Repeated
rows give repeated rows, an empty table gives an empty result, other columns of docs are left out. A very long text is
held whole by one task, with some 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, map_slices, written
from .components import components, local_components
from .textarrays import Texts, plain

#: Distinct fingerprints that one tile holds.
TILE = 512


def fingerprint_words(x: Texts, shingle: int, seed: int) -> np.ndarray:
    """Fingerprint of each row: a bit is set if it is in over half the XXH64 values of its shingles."""
    lower = x.data.copy()
    lower[(lower >= 65) & (lower <= 90)] += 32
    first, end = x.words()
    counts = x.per_row(first)
    # the words of all rows, each followed by one space
    size = end - first + 1
    at = np.zeros(len(first) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    place = np.arange(at[-1]) - np.repeat(at[:-1] - first, size)
    joined = np.append(lower, np.uint8(32))[np.minimum(place, len(lower))]
    joined[at[1:] - 1] = 32
    raw = joined.tobytes()
    row_first = np.cumsum(counts) - counts
    n = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    row = np.repeat(np.arange(len(counts)), n)
    start = row_first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    stop = np.minimum(start + shingle, row_first[row] + counts[row])
    digest = xxhash.xxh64_intdigest
    first, last = at[start], at[stop] - 1
    h = np.fromiter((digest(raw[a:b], seed) for k in range(0, len(first), 1 << 16) for a, b in zip(first[k : k + (1 << 16)].tolist(), last[k : k + (1 << 16)].tolist(), strict=True)), np.uint64, len(first))
    out = np.zeros(len(counts), np.uint64)
    if not len(h):
        return out
    # eight byte-wide counters in a 64-bit word, 255 values at most before they are widened
    local = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    heads = np.flatnonzero(local % 255 == 0)
    ends, sums = np.r_[heads[1:], len(h)], np.empty((len(heads), 64), np.int64)
    for k in range(0, len(heads), 1024):
        some, base = heads[k : k + 1024], heads[k]
        bits = np.unpackbits(h[base : ends[k : k + 1024][-1]].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        sums[k : k + 1024] = np.add.reduceat(bits, some - base, axis=0).view(np.uint8).reshape(len(some), 64)
    owner = row[heads]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    total = np.add.reduceat(sums, edge, axis=0)
    rows = owner[edge]
    out[rows] = np.packbits(2 * total > n[rows][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text), fp (the fingerprint's bits as a long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprint_words(Texts(plain(batch.column("text"))), shingle, seed).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    named = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.xxhash64("text"))
    return map_slices(named, run, "doc_id long, text_hash long, fp long", "doc_id", "text_hash", "text")


def close_pairs(fp: np.ndarray, tile: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions in the same tile that differ by at most radius bits. Both arrays are in tile order."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edge = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else np.zeros(0, np.int64)
    size = np.diff(np.r_[edge, len(tile)])
    small = size <= 32
    of = np.repeat(size, size)
    member = np.flatnonzero((of > 1) & (of <= 32))
    for d in range(1, int(size[small].max(initial=1))):
        i = member[member + d < len(tile)]
        i = i[tile[i] == tile[i + d]]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        a.append(i)
        b.append(i + d)
    for lo, n in zip(edge[~small].tolist(), size[~small].tolist(), strict=True):
        ones = np.bitwise_count(fp[lo : lo + n])
        order = np.argsort(ones, kind="stable") + lo
        ones = np.sort(ones)
        for p in range(0, n, 256):
            left = order[p : p + 256]
            for q in range(p, n, 256):
                if int(ones[q]) - int(ones[min(p + 256, n) - 1]) > radius:
                    break
                right = order[q : q + 256]
                i, j = np.nonzero(np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= radius)
                keep = left[i] != right[j]
                a.append(left[i][keep])
                b.append(right[j][keep])
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Spanning edges a, b of the fingerprints (column fp, distinct) within radius bits of each other."""
    width = -(-64 // (radius + 1))
    blocks = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * width).bitwiseAND((1 << min(width, 64 - k * width)) - 1).alias("value")) for k in range(radius + 1)]
    rows = distinct.select("fp", F.explode(F.array(*blocks)).alias("x")).select("fp", "x.block", "x.value")
    # tiles over the size are cut by population count, and by a hash within a count
    crowded = rows.groupBy("block", "value").count().filter(F.col("count") > tile).withColumn("parts", F.ceil(F.col("count") / F.lit(8 * tile)).cast("int")).drop("count")
    rows = rows.join(crowded, ["block", "value"], "left")
    ones, mine = F.bit_count("fp"), F.pmod(F.xxhash64("fp"), F.coalesce(F.col("parts"), F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    meets = F.flatten(
        F.transform(
            every,
            lambda p: F.transform(
                F.sequence(F.lit(-radius), F.lit(radius)),
                # the pair of parts (lower count and its hash part, higher count and its hash part)
                lambda d: F.when(d < 0, F.xxhash64(ones + d, p, ones, F.col("mine")))
                .when(d > 0, F.xxhash64(ones, F.col("mine"), ones + d, p))
                .otherwise(F.xxhash64(ones, F.least(p, F.col("mine")), ones, F.greatest(p, F.col("mine")))),
            ),
        )
    )
    keyed = rows.withColumn("mine", mine).withColumn("meets", F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets))
    keyed = keyed.select("fp", F.explode(F.array_distinct("meets")).alias("meet"), "block", "value").select("fp", F.xxhash64("block", "value", "meet").alias("tile"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_fp, tail_tile = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def found(fp: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, j = close_pairs(fp, of, radius)
            if len(i):
                node, low = local_components(fp[i].view(np.int64), fp[j].view(np.int64))
                keep = node != low
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(low[keep])], ["a", "b"])

        for batch in batches:
            fp = np.concatenate([tail_fp, batch.column("fp").to_numpy().view(np.uint64)])
            of = np.concatenate([tail_tile, batch.column("tile").to_numpy()])
            whole = int(np.searchsorted(of, of[-1])) if len(of) else 0
            yield from found(fp[:whole], of[:whole])
            tail_fp, tail_tile = fp[whole:], of[whole:]
        yield from found(tail_fp, tail_tile)

    n = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return keyed.repartition(int(n), "tile").sortWithinPartitions("tile").mapInArrow(releasing(compare), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, fp, component_id (smallest doc_id that links reach) for each row of docs."""
    marks = written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped = written(grouped, "grouped")
    # written, so that the join sees its size and adaptive execution can split a large component
    least = written(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(grouped.join(least, "root").select("fp", "component_id"), "named")
    return marks.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def hex_digits(fp="fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
