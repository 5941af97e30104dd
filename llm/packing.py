"""Best-fit packing of token pieces into sequences of a fixed capacity.

Pieces are dealt at random into groups of a bounded size; a group is packed in one task, so the
work is spread evenly whatever the lengths are, and a group wastes less than one sequence. Within a
group the Martello-Toth reduction first fixes item sets that dominate every alternative:

* an item beside which not even the smallest other item fits fills a sequence alone;
* an item and one that exactly fills its rest;
* an item beside which no two others fit, with the largest single one that fits;
* an item beside which two others but no three fit, with the largest single one if that fills no less than
  the best two, or with the best two if their larger is the largest that fits and at most one item lies
  between them, or no two of those between fit.

Some optimal solution holds each such set, so what remains is a smaller instance with the same
optimum plus the sequences fixed; best-fit decreasing packs it.

Nulls: a null text is an empty one (its end id alone); a null doc_id is carried as null. Repeated
rows are packed once each; they are dealt by their places in the table of pieces, so they spread over the groups.
An empty table gives an empty result; other columns of docs are left out. A very long text is tokenized whole by one
task and cut into pieces, which are then rows like any others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, map_slices, written
from .textarrays import plain
from .tokens import drop, encoder, ended

#: Pieces that are packed together.
GROUP = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, words: bool, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece of each document: its ids' place, number and crc32."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder(path, words).encode(plain(batch.column("text")))
        ids, counts = ended(ids, counts, end_id), counts + 1
        ids = ids.astype("<u4")
        n = -(-counts // capacity)
        row = np.repeat(np.arange(len(counts)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(counts[row] - start, capacity)
        at = (np.cumsum(counts) - counts)[row] + start
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_slices(docs.withColumn("doc_id", F.col("doc_id").cast("long")), cut, PIECES, "doc_id", "text", last=drop)


def reduce_instance(lengths: np.ndarray, capacity: int) -> tuple[list[list[int]], list[int]]:
    """Item sets that the dominance rules fix, and the items left, both as positions in lengths."""
    by: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        by.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(by)
    fixed: list[list[int]] = []

    def take(size: int) -> int:
        i = by[size].pop()
        if not by[size]:
            del by[size]
            del sizes[bisect_left(sizes, size)]
        return i

    def left(size: int, large: int) -> int:
        """Items of a size beside one of the largest."""
        return len(by.get(size, ())) - (size == large)

    def smallest(n: int, large: int) -> list[int]:
        out: list[int] = []
        for size in sizes:
            out += [size] * min(n - len(out), left(size, large))
            if len(out) == n:
                break
        return out

    def largest(room: int, large: int) -> int:
        """The largest other item that fits (one does)."""
        k = bisect_left(sizes, room + 1) - 1
        return sizes[k] if left(sizes[k], large) > 0 else sizes[k - 1]

    def largest_pair(room: int, large: int) -> tuple[int, int]:
        """The two other items that fill a room best, the larger first; of equal sums the one with the largest item."""
        best, lo, hi = (0, 0), 0, len(sizes) - 1
        while lo <= hi:
            a, b = sizes[hi], sizes[lo]
            if a + b > room or left(a, large) < 1:
                hi -= 1
                continue
            if left(b, large) > (a == b) and a + b > sum(best):
                best = (a, b)
            lo += 1
        return best

    def dominates(pair: tuple[int, int], rest: int, large: int) -> bool:
        """Whether no other two that fit can do better than the pair, whose larger item is the largest that fits."""
        a, b = pair
        if a == b:
            return True
        # items from a on (one of them taken) down to those over b, in order
        above = left(a, large) - 1
        sizes_over = []
        for k in range(bisect_left(sizes, b + 1), bisect_left(sizes, a)):
            n = left(sizes[k], large)
            above += n
            if len(sizes_over) < 2:
                sizes_over += [sizes[k]] * min(n, 2 - len(sizes_over))
            if above > 1 and len(sizes_over) == 2:
                break
        if above <= 1:
            return True
        sizes_over += [a] * (2 - len(sizes_over))
        return sum(sizes_over) > rest

    while sizes:
        large, rest = sizes[-1], capacity - sizes[-1]
        least = smallest(3, large)
        if not least or least[0] > rest:
            fixed.append([take(large)])
            continue
        if rest in by and (rest != large or len(by[large]) > 1):
            first = take(large)
            fixed.append([first, take(rest)])
            continue
        if len(least) < 2 or least[0] + least[1] > rest:
            first = take(large)
            fixed.append([first, take(sizes[bisect_left(sizes, rest + 1) - 1])])
            continue
        if len(least) > 2 and sum(least) <= rest:
            break  # three others may fit beside the largest item: these rules settle no more
        single, pair = largest(rest, large), largest_pair(rest, large)
        if single >= sum(pair):
            first = take(large)
            fixed.append([first, take(single)])
        elif pair[0] == single and dominates(pair, rest, large):
            first = take(large)
            fixed.append([first, take(pair[0]), take(pair[1])])
        else:
            break
    # exact pairs among the rest
    for large in sizes[::-1]:
        rest = capacity - large
        while large in by and rest in by and (rest != large or len(by[large]) > 1):
            first = take(large)
            fixed.append([first, take(rest)])
    return fixed, [i for s in sizes[::-1] for i in by[s]]


def best_fit(lengths: np.ndarray, items: list[int], capacity: int) -> list[list[int]]:
    """Items (largest first), each to the fullest sequence that holds it."""
    out: list[list[int]] = []
    rooms: list[int] = []  # ascending; by room the sequences that have it
    having: dict[int, list[int]] = {}
    for i in items:
        size = int(lengths[i])
        k = bisect_left(rooms, size)
        if k == len(rooms):
            at, room = len(out), capacity
            out.append([])
        else:
            room = rooms[k]
            at = having[room].pop()
            if not having[room]:
                del having[room], rooms[k]
        out[at].append(i)
        if room > size:
            if room - size not in having:
                insort(rooms, room - size)
                having[room - size] = []
            having[room - size].append(at)
    return out


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item."""
    fixed, left = reduce_instance(lengths, capacity)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, items in enumerate(fixed + best_fit(lengths, left, capacity)):
        at = 0
        for i in items:
            sequence[i], offset[i] = k, at
            at += int(lengths[i])
    return sequence, offset


def pack(docs: DataFrame, path: str, words: bool = True, capacity: int = 4096, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """Every piece with sequence_id and offset; no sequence holds more than capacity ids and none has gaps."""
    found = written(pieces(docs, path, words, capacity, end_id), "pieces")
    groups = max(1, -(-found.count() // group))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        groups_of = rows.column("group").to_numpy()
        order = np.argsort(groups_of, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(groups_of[order])) + 1):
            some = rows.take(pa.array(part)).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            sequence, offset = pack_group(some.column("length").to_numpy(), capacity)
            number = int(groups_of[part[0]])
            out = some.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence + (number << 32))).append_column("offset", pa.array(offset))
            yield from out.to_batches()

    # by the number of the row in the written table, so that equal rows spread like any others
    dealt = found.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.repartitionById(groups, F.col("group").cast("int")).mapInArrow(releasing(place), PIECES + ", sequence_id long, offset long")
