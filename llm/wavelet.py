"""Token ids of a corpus as wavelet matrices, one succinct file for each shard.

A shard holds the ids of consecutive documents. Its wavelet matrix has one plane of bits for each bit
of an id, highest first; every plane lists the bit in the order that the planes before it have sorted
the ids into (zeros first, stably). Counts of ones before every 512th bit give rank in constant time,
and with it access to any id, counting of an id in a range, and the places of its occurrences (select, by halving over those counts),
all from the file's bytes without unpacking it.

Documents are sorted by doc_id over all shards (equal ids by their texts, null first). A null text
is an empty one and has the end id alone; an empty table gives no shard. A very long text makes its shard longer, which
one task holds whole; other columns of docs are left out. Repeated rows are written once each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_folder, importable, partitions, releasing, store, written
from .textarrays import plain, slices
from .tokens import encoder, ended

#: Ids that a shard holds, about.
SHARD = 2 << 20
BLOCK = 512
_MAGIC = b"WVM1"


def build(ids: np.ndarray, counts: np.ndarray, doc_ids: list) -> bytes:
    """The file of a shard: header, documents' id counts and doc_ids, zero counts, planes with their ranks."""
    n, levels = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    planes, zeros, rows = [], [], ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels - 1, -1, -1):
        bits = (rows >> level & 1).astype(bool)
        packed = np.packbits(bits)
        padded = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        planes.append(np.cumsum(np.r_[np.uint32(0), ones], dtype=np.uint32).tobytes() + packed.tobytes())
        zeros.append(n - int(ones.sum()))
        rows = np.concatenate([rows[~bits], rows[bits]])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], np.int64)
    head = _MAGIC + struct.pack("<QIH", n, len(doc_ids), levels) + struct.pack(f"<{levels}Q", *zeros)
    return head + counts.astype("<u4").tobytes() + names.astype("<i8").tobytes() + known.tobytes() + b"".join(planes)


class WaveletMatrix:
    """Queries on a shard's file."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("no wavelet matrix")
        self.n, docs, self.levels = struct.unpack_from("<QIH", data, 4)
        at = 18
        self.zeros = struct.unpack_from(f"<{self.levels}Q", data, at)
        at += 8 * self.levels
        self.counts = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        names, known = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(a) if b else None for a, b in zip(names, known, strict=True)]
        at += 9 * docs
        blocks, size = -(-(-(-self.n // 8)) // (BLOCK // 8)) + 1, -(-self.n // 8)
        self.ranks, self.planes = [], []
        for _ in range(self.levels):
            self.ranks.append(np.frombuffer(data, "<u4", blocks, at))
            self.planes.append(np.frombuffer(data, np.uint8, size, at + 4 * blocks))
            at += 4 * blocks + size

    def rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        part = plane[block * BLOCK // 8 : i // 8]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())
        return ones + (int(plane[i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.levels):
            bit, ones = self._bit(k, i), self.rank(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among the places lo..hi."""
        hi = self.n if hi is None else min(hi, self.n)
        lo, hi = self._range(token, min(lo, hi), hi)
        return hi - lo

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for k in range(self.levels):
            a, b = self.rank(k, lo), self.rank(k, hi)
            one = token >> (self.levels - 1 - k) & 1
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if one else (lo - a, hi - b)
        return lo, hi

    def select(self, token: int, j: int) -> int:
        """The place of the j-th occurrence (from 0) of an id, or -1."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= j < hi - lo:
            return -1
        i = lo + j
        for k in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - k) & 1
            i = self._select_bit(k, one, i - self.zeros[k] if one else i)
        return i

    def _select_bit(self, level: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) such bit of a plane: by the counts before every block, then within one block."""
        ranks = self.ranks[level]
        before = lambda block: int(ranks[block]) if bit else min(block * BLOCK, self.n) - int(ranks[block])
        block, over = 0, len(ranks) - 1
        while over - block > 1:
            middle = (block + over) // 2
            block, over = (middle, over) if before(middle) <= j else (block, middle)
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - before(block)])

    def locate(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def all(self) -> np.ndarray:
        """Every id in order: planes are undone from the lowest bit up."""
        rows = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[k], count=self.n).view(bool)
            back = np.empty_like(rows)
            back[~bits] = rows[: self.zeros[k]]
            back[bits] = rows[self.zeros[k] :] | (1 << (self.levels - 1 - k))
            rows = back
        return rows


def shards(docs: DataFrame, path: str, words: bool = False, end_id: int = 2, size: int = SHARD) -> DataFrame:
    """Writes the corpus as files in a new shared folder; a row for each: part, number, n_tokens, file (its path).

    Only files of attempts that have ended are in the table. Documents with equal ids are dealt by their first characters,
    in the order of texts.
    """
    spark = docs.sparkSession
    folder = file_folder(spark, "wavelet")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, docs_, held = [], [], [], 0

        def file() -> pa.RecordBatch:
            name = f"{folder}/{part:08d}-{number:04d}-{uuid.uuid4().hex}.wvm"
            fs, place = store(name)
            fs.create_dir(place.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(place, compression=None) as out:
                out.write(build(np.concatenate(ids), np.concatenate(sizes), docs_))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([held]), pa.array([name])], ["part", "number", "n_tokens", "file"])

        for batch in batches:
            texts = plain(batch.column("text"))
            for lo, hi in slices(texts):
                found, counts = encoder(path, words).encode(texts.slice(lo, hi - lo))
                ids.append(ended(found, counts, end_id))
                sizes.append(counts + 1)
                docs_ += batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                held += len(ids[-1])
                if held >= size:
                    yield file()
                    number, ids, sizes, docs_, held = number + 1, [], [], [], 0
        if ids:
            yield file()

    importable(spark)
    start = F.substring("text", 1, 16)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), "doc_id", start).sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(releasing(pack), "part long, number long, n_tokens long, file string"), "wavelet-files")


def opened(path: str) -> WaveletMatrix:
    """The matrix in a file of a shared folder."""
    fs, place = store(path)
    with fs.open_input_stream(place, compression=None) as file:
        return WaveletMatrix(file.read())


def documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    spark = files.sparkSession
    # ids before each part: one row a part comes to the driver
    bases, total = [], 0
    for part, n in sorted(map(tuple, files.groupBy("part").agg(F.sum("n_tokens")).collect())):
        bases.append((part, total))
        total += n
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part").select("file", (F.col("base") + F.coalesce(before, F.lit(0))).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                matrix = opened(file)
                ids, start = matrix.all().astype("<u4"), np.cumsum(matrix.counts) - matrix.counts
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(start.tolist(), matrix.counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(matrix.doc_ids, pa.int64()), pa.array(start + base), pa.array(matrix.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a file is much work for a small row
    return starts.repartition(partitions(spark), "file").mapInArrow(releasing(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
