"""For each 64-bit name in each document: is it in another document, or in one with a smaller id?

Names are dealt to buckets by their bits and travel packed, a row for each slice of documents and
bucket. A slice sends a name once at most for its smallest (and, where that matters, largest) doc_id;
what it can answer itself it keeps. A task remembers names that came back, in one slice or in two that follow each other, and
answers from that, so a name in a third of all documents, or in every slice, comes to its bucket a few times from each task. Answers come back as one byte for each name of a document, in the order
that the document finds again by itself: distinct names by bucket, then by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, binaries, map_slices, partitions
from .textarrays import ragged

LAST = np.iinfo(np.int64).max
_COLUMNS = "kind int, bucket int, slice long, doc_ids binary, keys binary, counts binary, names binary, extra binary, extra_docs binary"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_id as a long and ``key``, which names the row's id and text."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def buckets_of(docs: DataFrame) -> int:
    """Buckets that hold some 64 MB of text each, as many as there are shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size >> 26))


def entries(row: np.ndarray, names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each row's distinct names in the order of answers, and for each name its answer's place."""
    bucket = names % np.uint64(buckets)
    order = np.lexsort((names, bucket, row))
    r, n = row[order], names[order]
    head = np.r_[True, (r[1:] != r[:-1]) | (n[1:] != n[:-1])] if len(order) else np.zeros(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(head) - 1
    return order[head], place


def absent(held: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each name among those held, and which are not there; both are sorted and distinct."""
    place = np.searchsorted(held, names)
    if not len(held):
        return place, np.ones(len(names), bool)
    return place, held[np.minimum(place, len(held) - 1)] != names


class Returning:
    """Names that a task has met in two documents or in two slices running: the least and largest doc_id of each. At most LIMIT; then it begins anew."""

    LIMIT = 1 << 18

    def __init__(self):
        self.names, self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last = (self.names, self.low, self.high)

    @staticmethod
    def _both(held: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where names are that are held, among the names and among those held."""
        place, new = absent(held, names)
        i = np.flatnonzero(~new)
        return i, place[i]

    def meet(self, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of doc_ids of a slice's names (sorted) with what is remembered of them, and which are remembered for the first time."""
        own = (names, low.copy(), high.copy())
        low, high, known = low.copy(), high.copy(), np.zeros(len(names), bool)
        i, j = self._both(self.names, names)
        low[i], high[i], known[i] = np.minimum(low[i], self.low[j]), np.maximum(high[i], self.high[j]), True
        self.low[j], self.high[j] = low[i], high[i]
        i, j = self._both(self.last[0], names)
        low[i], high[i] = np.minimum(low[i], self.last[1][j]), np.maximum(high[i], self.last[2][j])
        fresh = ~known & (low != high)
        if fresh.any():
            kept = len(self.names) + fresh.sum() <= self.LIMIT
            both = [np.concatenate([old, new[fresh]]) if kept else new[fresh] for old, new in ((self.names, names), (self.low, low), (self.high, high))]
            order = np.argsort(both[0])
            self.names, self.low, self.high = (x[order] for x in both)
        self.last = own
        return low, high, fresh


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(LAST).to_numpy()


def answers(docs: DataFrame, buckets: int, names_of: Callable, earlier: bool, *columns: str) -> DataFrame:
    """key, doc_id and answers of each document: a byte for each of its distinct names.

    names_of(batch) gives the row and the name of each position. earlier: 1 if a document with a
    smaller doc_id has the name; else 1 if a document with another doc_id has it.
    """
    number, returning = [0], Returning()

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, ids, keys = batch.num_rows, ids_of(batch), batch.column("key").to_numpy()
        row, names = names_of(batch)
        first, _ = entries(row, names, buckets)
        row, names = row[first], names[first]
        distinct, of = np.unique(names, return_inverse=True)
        low = np.full(len(distinct), LAST, np.int64)
        high = np.full(len(distinct), np.iinfo(np.int64).min, np.int64)
        np.minimum.at(low, of, ids[row])
        np.maximum.at(high, of, ids[row])
        low, high, fresh = returning.meet(distinct, low, high)
        known = ids[row] > low[of] if earlier else (low != high)[of]
        slice_ = (TaskContext.get().partitionId() << 32) + number[0]
        number[0] += 1
        per_row = np.bincount(row, minlength=rows).astype(np.int32)
        out = [(1, int(slice_ % buckets), slice_, ids.tobytes(), keys.tobytes(), per_row.tobytes(), known.astype(np.uint8).tobytes(), b"", b"")]
        asked = np.flatnonzero(~known)
        bucket = (names[asked] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        asked, bucket = asked[order], bucket[order]
        extra = np.zeros(0, np.int64) if earlier else np.flatnonzero(fresh)
        extra_bucket = (distinct[extra] % np.uint64(buckets)).astype(np.int64)
        extra = extra[np.argsort(extra_bucket, kind="stable")]
        extra_bucket = np.sort(extra_bucket, kind="stable")
        edges, extra_edges = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(extra_bucket, np.arange(buckets + 1))
        for b in range(buckets):
            some, more = asked[edges[b] : edges[b + 1]], extra[extra_edges[b] : extra_edges[b + 1]]
            if len(some) or len(more):
                who, n = np.unique(row[some], return_counts=True)
                doubled = np.repeat(distinct[more], 2)
                both = np.stack([low[more], high[more]], axis=1).ravel()
                out.append((0, b, slice_, ids[who].tobytes(), who.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), names[some].tobytes(), doubled.tobytes(), both.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6], strict=True)], ["kind", "bucket", "slice", "doc_ids", "keys", "counts", "names", "extra", "extra_docs"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            own = batch.filter(pa.compute.equal(batch.column("kind"), 1))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("kind", "bucket", "slice", "doc_ids", "keys", "counts", "names")], ["kind", "bucket", "slice", "doc_ids", "keys", "counts", "answers"])
            other = batch.filter(pa.compute.equal(batch.column("kind"), 0))
            if other.num_rows:
                held.append(other)
        if not held:
            return
        rows = pa.Table.from_batches(held).to_pydict()
        sizes = np.array([len(x) // 8 for x in rows["names"]])
        names = np.frombuffer(b"".join(rows["names"]), np.uint64)
        ids = np.repeat(np.frombuffer(b"".join(rows["doc_ids"]), np.int64), np.frombuffer(b"".join(rows["counts"]), np.int32))
        distinct, of = np.unique(np.concatenate([names, np.frombuffer(b"".join(rows["extra"]), np.uint64)]), return_inverse=True)
        every = np.concatenate([ids, np.frombuffer(b"".join(rows["extra_docs"]), np.int64)])
        low = np.full(len(distinct), LAST, np.int64)
        np.minimum.at(low, of, every)
        if earlier:
            bits = low[of[: len(names)]] < ids
        else:
            high = np.full(len(distinct), np.iinfo(np.int64).min, np.int64)
            np.maximum.at(high, of, every)
            bits = (low != high)[of[: len(names)]]
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * n, pa.int32()), pa.array(rows["bucket"], pa.int32()), pa.array(rows["slice"]), pa.array([b""] * n, pa.binary()), pa.array(rows["keys"], pa.binary()), pa.array(rows["counts"], pa.binary()), binaries(bits.view(np.uint8), sizes)],
            ["kind", "bucket", "slice", "doc_ids", "keys", "counts", "answers"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if group and group[0]["slice"] != r["slice"]:
                    yield from _merged(group)
                    group = []
                group.append(r)
        if group:
            yield from _merged(group)

    asked = map_slices(docs, ask, _COLUMNS, "doc_id", "key", "text", *columns)
    replied = asked.repartitionById(buckets, F.col("bucket")).mapInArrow(releasing(reply), "kind int, bucket int, slice long, doc_ids binary, keys binary, counts binary, answers binary")
    return replied.repartition(buckets, "slice").sortWithinPartitions("slice", F.desc("kind"), "bucket").mapInArrow(releasing(gather), "key long, doc_id long, answers binary")


def _merged(group: list[dict]) -> Iterator[pa.RecordBatch]:
    own, rest = group[0], group[1:]
    per_row = np.frombuffer(own["counts"], np.int32).astype(np.int64)
    out = np.frombuffer(own["answers"], np.uint8).copy()
    if rest:
        # parts of the answers: for each bucket and document, in bucket order; wanted by document first
        bits = np.frombuffer(b"".join(r["answers"] for r in rest), np.uint8)
        who = np.frombuffer(b"".join(r["keys"] for r in rest), np.int32)
        n = np.frombuffer(b"".join(r["counts"] for r in rest), np.int32).astype(np.int64)
        start = np.cumsum(n) - n
        order = np.argsort(who, kind="stable")
        out[out == 0] = bits[np.repeat(start[order], n[order]) + ragged(n[order])]
    ids = np.frombuffer(own["doc_ids"], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own["keys"], np.int64)), pa.array(ids, mask=ids == LAST), binaries(out, per_row)], ["key", "doc_id", "answers"])


def with_answers(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """docs (with key) and the answers of each row; equal rows have equal answers."""
    one = found.groupBy("key", "doc_id").agg(F.first("answers").alias(name)).select(F.col("key").alias("k"), F.col("doc_id").alias("d"), name)
    return docs.join(one, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("k", "d")
