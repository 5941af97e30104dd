"""Hard negatives by a multiway hyperplane tree whose split points know how far their siblings' points are.

Vectors get one more coordinate that brings all to the length of the longest, anchors a zero there: an inner product is then
a distance, and a window of scores is an annulus around the anchor. A tree is grown on a bounded sample
(SAMPLE rows, fewer for vectors of many components): each node takes up to FANOUT points far from each other, and
a point belongs to the nearest of them. Every row goes down the tree to its leaf, and leaves are packed into blocks of about
BLOCK rows. From the blocks come, for every split point and every subtree beside it, the least and the
largest distance of all rows there. An anchor passes over a subtree if by some split point's range no row in it can lie in any of
its annuli, then over blocks by their own ranges, and scores what is left in whole numbers. Its own leaf comes first: the
scores found there narrow the annuli. Nothing depends on the sample but the work.

Components are floor(scale * x), x as double. Rows with a null label, a null vector, or any component that is null or not finite
(after scaling) take no part. Rows that agree in id, label and vector count once; rows with the same id are never
each other's positives or negatives. A null id is no anchor and comes last among ties. Vectors shorter than the longest end
in zeros. An empty table, and one without anchors, gives an empty result; other columns are left out. Scores are exact:
where sums may pass 2^53 they are made of Python's integers, and one beyond 64 bits raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import importable, written

#: Rows that the tree is grown on at most, and components of them all together.
SAMPLE, SAMPLE_VALUES = 16_384, 1 << 21
FANOUT, BLOCK, CHUNK = 16, 1024, 256
#: Blocks of a leaf that meet its anchors under one key.
STRIPE = 8
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Relative width by which ranges are widened against rounding.
SLACK = 1e-6


def prepared(df: DataFrame, vec_id: str, label, vector: str, scale: int = 256) -> DataFrame:
    """id, label, v (array of whole doubles) of the rows that take part."""
    scaled = F.transform(F.col(vector), lambda x: F.col("scale") * x.cast("double"))
    some = df.withColumn("scale", F.lit(float(scale))).select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return some.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & fine).select("id", "label", F.transform("v", _floor).alias("v"))


def _floor(x: Column) -> Column:
    """Floor of a double as a double, also beyond the range of long (where all doubles are whole); no negative zero."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x) + F.lit(0.0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from an array of lists that all have dim values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def longer(v: np.ndarray, square: float) -> np.ndarray:
    """Rows with a last coordinate that brings their squared length to a given one."""
    return np.concatenate([v, np.sqrt(np.maximum(square - (v * v).sum(axis=1), 0))[:, None]], axis=1)


class Tree:
    """levels[k][node] are the split points of a node (FANOUT rows, unused ones NaN); all leaves are equally deep."""

    def __init__(self, sample: np.ndarray, square: float, depth: int):
        self.square, self.depth = square, depth
        points = longer(sample, square)
        self.levels = [np.full((FANOUT**k, FANOUT, points.shape[1]), np.nan) for k in range(depth)]
        node = np.zeros(len(points), np.int64)
        for k in range(depth):
            if k:
                # a way that no point of the sample takes after rounding still leads on
                self.levels[k][:, 0] = self.levels[k - 1].reshape(len(self.levels[k]), -1)
            for n in np.unique(node):
                mine = np.flatnonzero(node == n)
                some = self._apart(points[mine])
                self.levels[k][n, : len(some)] = points[mine][some]
            node = self._below(points, node, k)

    @staticmethod
    def _apart(points: np.ndarray) -> list[int]:
        """Up to FANOUT different points, each the farthest from those before it."""
        chosen = [0]
        far = ((points - points[0]) ** 2).sum(axis=1)
        while len(chosen) < FANOUT and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        return chosen

    def _below(self, points: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
        out = np.empty_like(node)
        order = np.argsort(node, kind="stable")
        edge = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])
        for lo, hi in zip(edge, np.r_[edge[1:], len(order)], strict=True):
            mine = order[lo:hi]
            near = points[mine] @ self.levels[k][node[mine[0]]].T
            out[mine] = node[mine[0]] * FANOUT + np.nanargmax(near, axis=1)
        return out

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the way of the nearest split point (all have one length)."""
        points, node = longer(v, self.square), np.zeros(len(v), np.int64)
        for k in range(self.depth):
            node = self._below(points, node, k) if len(points) else node
        return node

    def apart(self, points: np.ndarray, k: int, node: np.ndarray) -> np.ndarray:
        """Distances of points to the split points of their nodes on a level (NaN for unused ones)."""
        dots = np.einsum("nd,nfd->nf", points, self.levels[k][node])
        return np.sqrt(np.maximum((points * points).sum(axis=1)[:, None] + self.square - 2 * dots, 0))

    def ranges(self, v: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of the rows of a leaf to the split points above it, level by level (depth * FANOUT)."""
        points = longer(v, self.square)
        d = []
        for k in range(self.depth):
            node = leaf // FANOUT ** (self.depth - k)
            d.append(np.sqrt(np.maximum(2 * self.square - 2 * points @ self.levels[k][node].T, 0)))
        all_d = np.concatenate(d, axis=1)
        return all_d.min(axis=0), all_d.max(axis=0)


def annuli(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances between which rows with scores lo to hi lie (anchors by windows); an empty window gets an empty annulus."""
    both = (v * v).sum(axis=1)[:, None] + square
    near, far = np.sqrt(np.maximum(both - 2 * np.minimum(hi, both), 0)), np.sqrt(np.maximum(both - 2 * np.maximum(lo, -both), 0))
    none = lo > hi
    return np.where(none, np.inf, near), np.where(none, -np.inf, far)


def _meets(d: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Whether rows at distances low to high from split points can lie in one of the annuli of anchors at distances d from those points.

    d: anchors by split points; low, high: the same shape with any axes between; near, far: anchors by annuli.
    """
    least = np.fmax.reduce(np.maximum(np.maximum(d - high, low - d), 0), axis=-1)
    most = np.fmin.reduce(d + high, axis=-1)
    shape = (len(near),) + (1,) * (least.ndim - 1) + (-1,)
    near, far, slack = near.reshape(shape), far.reshape(shape), slack.reshape((len(slack),) + (1,) * least.ndim)
    return ((least[..., None] <= far + slack) & (most[..., None] >= near - slack)).any(axis=-1)


def search(batch: pa.RecordBatch, tree: Tree, low: list[np.ndarray], high: list[np.ndarray], dim: int) -> Iterator[pa.RecordBatch]:
    """The anchors of a batch, once for each leaf that their annuli reach."""
    step = max(1, 65_536 // FANOUT**tree.depth)
    for at in range(0, len(batch), step):
        some = batch.slice(at, step)
        v, near, far = matrix(some.column("v"), dim), *_windows(some, dim, tree.square)
        points = np.concatenate([v, np.zeros((len(v), 1))], axis=1)
        slack = SLACK * np.sqrt((v * v).sum(axis=1) + tree.square)
        who, node = np.arange(len(v)), np.zeros(len(v), np.int64)
        for k in range(tree.depth):
            d = tree.apart(points[who], k, node)[:, None, :]
            # axes: pair of anchor and node, child, split point
            there = _meets(d, low[k][node], high[k][node], near[who], far[who], slack[who]) & ~np.isnan(low[k][node][:, :, 0])
            pair, child = np.nonzero(there)
            who, node = who[pair], node[pair] * FANOUT + child
        out = some.take(pa.array(who))
        yield pa.RecordBatch.from_arrays([pa.array(node), *out.columns], ["leaf", *out.schema.names])


def _windows(batch, dim: int, square: float) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(float) for c in ("lo", "hi"))
    return annuli(matrix(batch.column("v"), dim), lo, hi, square)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole doubles as longs."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in row] for row in x.tolist()], object)
    return np.array((whole(a) @ whole(b).T).tolist(), np.int64)


def best(score: np.ndarray, ids: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first k wanted columns of each row by score, then id."""
    row, column = np.nonzero(wanted)
    order = np.lexsort((ids[column], np.invert(score[row, column]), row))
    row, column = row[order], column[order]
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(head, np.diff(np.r_[head, len(row)]))
    return row[place < k], column[place < k]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 8):
    """Arrow batches of few rows, for rows that are packed blocks, while a table is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Index:
    """Rows (id, label, v) in the blocks of a tree's leaves, and the ranges of its split points."""

    def __init__(self, rows: DataFrame):
        spark = self.spark = rows.sparkSession
        importable(spark)
        rows = written(rows, "rows")
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        self.n, self.dim, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
        if not self.n or not self.dim:
            self.n = 0
            return
        self.square = longest * (1 + 1e-12)
        short = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(self.dim) - F.size("v")))
        rows = rows.select("id", "label", short.alias("v"), F.xxhash64("id", "label", "v").alias("key"))
        few = max(FANOUT, min(SAMPLE, SAMPLE_VALUES // self.dim))
        # tasks send no more than their share of about twice as many
        some = rows.filter(F.abs(F.col("key") / 2.0**63) <= max(2 * few, 1000) / self.n)
        sample = matrix(some.orderBy("key").limit(few).select("v").toArrow().column("v").combine_chunks(), self.dim)
        depth = next(d for d in (1, 2, 3) if d == 3 or self.n <= FANOUT**d * BLOCK)
        self.tree = tree = Tree(sample, self.square, depth)
        dim = self.dim

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(matrix(b.column("v"), dim))), *b.columns], ["leaf", *b.schema.names])

        placed = written(rows.mapInArrow(place, "leaf long, id long, label long, v array<double>, key long"), "placed")
        # a row for each leaf, FANOUT ** 3 at most
        self.sizes = F.broadcast(written(placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes"))
        dealt = placed.join(self.sizes, "leaf").withColumn("block", F.pmod("key", "blocks").cast("int"))
        packed = dealt.groupBy("leaf", "block").agg(F.collect_set(F.struct("key", "id", "label", "v")).alias("rows"))
        packed = written(packed, "packed")

        def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                low, high = [], []
                for leaf, rows in zip(b.column("leaf").to_pylist(), b.column("rows"), strict=True):
                    lo, hi = tree.ranges(matrix(rows.values.field("v"), dim), leaf)
                    low.append(lo.tolist())
                    high.append(hi.tolist())
                yield pa.RecordBatch.from_arrays([b.column("leaf"), b.column("block"), pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64()))], ["leaf", "block", "low", "high"])

        with small_batches(spark):
            ranges = written(packed.mapInArrow(ranged, "leaf long, block int, low array<double>, high array<double>"), "ranges")
        self.blocks = written(packed.join(ranges, ["leaf", "block"]).withColumn("stripe", F.floor(F.col("block") / STRIPE).cast("int")), "blocks")
        self._read_ranges(ranges)

    def _read_ranges(self, ranges: DataFrame) -> None:
        """low and high of [level][node, child, split point]: no more numbers than the tree has split points times FANOUT."""
        depth = self.tree.depth
        at = ranges.select("leaf", F.posexplode(F.arrays_zip("low", "high"))).select("leaf", F.floor(F.col("pos") / FANOUT).cast("int").alias("level"), (F.col("pos") % FANOUT).alias("point"), "col.low", "col.high")
        child = F.floor(F.col("leaf") / F.pow(F.lit(FANOUT), F.lit(depth - 1) - F.col("level"))).cast("long")
        found = at.filter(~F.isnan("low")).groupBy("level", child.alias("child"), "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        self.low = [np.full((FANOUT**k, FANOUT, FANOUT), np.nan) for k in range(depth)]
        self.high = [np.full((FANOUT**k, FANOUT, FANOUT), np.nan) for k in range(depth)]
        for r in found:
            self.low[r.level][r.child // FANOUT, r.child % FANOUT, r.point] = r.low
            self.high[r.level][r.child // FANOUT, r.child % FANOUT, r.point] = r.high

    def anchors(self, every: int) -> DataFrame:
        """leaf, key, id, label, v of the rows whose id is divisible."""
        mine = F.filter("rows", lambda r: r["id"] % every == 0)
        return written(self.blocks.select("leaf", F.inline(mine)), "anchors")

    def visits(self, anchors: DataFrame) -> DataFrame:
        """Anchors (key, id, label, v, lo, hi) with every leaf that their windows of scores reach."""
        tree, low, high, dim = self.tree, self.low, self.high, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from search(batch, tree, low, high, dim)

        names = "key long, id long, label long, v array<double>, lo array<long>, hi array<long>"
        return anchors.select("key", "id", "label", "v", "lo", "hi").mapInArrow(run, f"leaf long, {names}")

    def scored(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """key, w, other, score, place: for each anchor and window the first k rows by score, then id, of its own label or of others.

        visits: leaf, key, id, label, v, lo, hi; an anchor may come with any leaf once.
        """
        tree, dim = self.tree, self.dim
        visits = written(visits, "visits")
        chunks = visits.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        cut = visits.join(F.broadcast(chunks), "leaf").withColumn("chunk", F.pmod("key", "parts"))
        packed = cut.groupBy("leaf", "chunk").agg(F.collect_list(F.struct("key", "id", "label", "v", "lo", "hi")).alias("anchors"))
        stripes = F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / STRIPE).cast("int"))
        met = packed.join(self.sizes, "leaf").select("leaf", "anchors", F.explode(stripes).alias("stripe")).join(self.blocks, ["leaf", "stripe"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for leaf, anchors, rows, low, high in zip(batch.column("leaf").to_pylist(), batch.column("anchors"), batch.column("rows"), batch.column("low"), batch.column("high"), strict=True):
                    found = _compare(leaf, anchors.values, rows.values, np.array(low.as_py()), np.array(high.as_py()), tree, dim, same, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "w", "other", "score"])

        some = met.select("leaf", "anchors", "rows", "low", "high").mapInArrow(run, "key long, w int, other long, score long")
        # null ids travel as the largest number, which puts them last
        by = Window.partitionBy("key", "w").orderBy(F.desc("score"), "other")
        with small_batches(self.spark):
            return written(some.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k), "scored")


def _compare(leaf: int, anchors, rows, low: np.ndarray, high: np.ndarray, tree: Tree, dim: int, same: bool, k: int) -> list[np.ndarray]:
    """key, window, other and score of the best rows of a block for each anchor of a chunk that its ranges do not rule out."""
    of = lambda x, c: x.field(c).fill_null(HIGH).to_numpy(zero_copy_only=False)
    v = matrix(anchors.field("v"), dim)
    lo, hi = (anchors.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for c in ("lo", "hi"))
    near, far = annuli(v, lo.astype(float), hi.astype(float), tree.square)
    points = np.concatenate([v, np.zeros((len(v), 1))], axis=1)
    d = np.concatenate([tree.apart(points, j, np.full(len(v), leaf // FANOUT ** (tree.depth - j))) for j in range(tree.depth)], axis=1)
    slack = SLACK * np.sqrt((v * v).sum(axis=1) + tree.square)
    left = np.flatnonzero(_meets(d, low[None, :], high[None, :], near, far, slack))
    keys, ids, labels, other, label = of(anchors, "key")[left], of(anchors, "id")[left], of(anchors, "label")[left], of(rows, "id"), of(rows, "label")
    score = products(v[left], matrix(rows.field("v"), dim))
    fits = ((labels[:, None] == label[None, :]) == same) & (ids[:, None] != other[None, :])
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for w in range(lo.shape[1]):
        i, j = best(score, other, fits & (score >= lo[left, w][:, None]) & (score <= hi[left, w][:, None]), k)
        for column, values in zip(out, (keys[i], np.full(len(i), w, np.int32), other[j], score[i, j]), strict=True):
            column.append(values)
    return [np.concatenate(x) for x in out]


def hard_negatives(df: DataFrame, vec_id: str, label, vector: str, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; each one's first rows of its own label are its positives, and
    for each of those the first rows of other labels with low * positive <= 100 * negative <= high * positive its
    negatives. label: a column.
    """
    index = Index(prepared(df, vec_id, label, vector, scale))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.n:
        return df.sparkSession.createDataFrame([], schema)
    anchors = index.anchors(every)
    least, most = F.array(F.lit(LOW)).cast("array<bigint>"), F.array(F.lit(HIGH)).cast("array<bigint>")
    # positives: those of the own leaf bound how far the others can be
    seeds = index.scored(anchors.withColumns({"lo": least, "hi": most}), True, positives)
    bound = seeds.filter(F.col("place") == positives).select("key", F.col("score").alias("bound"))
    near = anchors.join(bound, "key", "left").select("key", "id", "label", "v", F.array(F.coalesce("bound", F.lit(LOW))).alias("lo"), most.alias("hi"))
    found = index.scored(index.visits(near), True, positives)
    windows = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "other", "score"))).alias("p"))
    lo, hi = F.transform("p", lambda x: _percent(low, x["score"], F.ceil)), F.transform("p", lambda x: _percent(high, x["score"], F.floor))
    # all anchors have as many windows; those that have no positive are empty
    pad = lambda x, value: F.slice(F.concat(x, F.array_repeat(F.lit(value), positives)), 1, positives)
    wanted = written(anchors.join(windows, "key").select("leaf", "key", "id", "label", "v", pad(lo, HIGH).alias("lo"), pad(hi, LOW).alias("hi")), "windows")
    # negatives: again the own leaf first
    first = index.scored(wanted, False, negatives).filter(F.col("place") == negatives)
    first = first.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("bound"))
    tight = F.transform("lo", lambda x, w: F.greatest(x, F.coalesce(F.element_at("bound", w), x)))
    narrowed = wanted.join(first, "key", "left").withColumn("lo", F.when(F.col("bound").isNull(), F.col("lo")).otherwise(tight))
    hard = index.scored(index.visits(narrowed), False, negatives)
    shown = lambda c: F.when(F.col(c) != HIGH, F.col(c))
    pairs = found.select("key", (F.col("place") - 1).alias("w"), shown("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.select("key", "w", F.col("place").alias("rank"), shown("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(pairs, ["key", "w"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _percent(percent: int, score: Column, rounded) -> Column:
    return rounded(F.lit(percent).cast("decimal(9,0)") * score.cast("decimal(19,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
