"""Boosted trees for ranking: pairwise gradients within requests, histograms on Spark.

Rows are binned once and packed into blocks of whole requests, so a request's pairs are in one row of a table and need
no further shuffle. Each round is one table (scores and gradients of all blocks); each level of a tree is one
aggregation of gradient sums by node, column and bin, of which only the best split of a node comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import importable, kept, small_batches
from .base import Model
from .encoding import encoded, ordered, statistics

#: Bins of a column (0: missing), rows of a request that are compared with each other, rows of a block.
BINS, GROUP, BLOCK = 64, 256, 4096
_BLOCK = "block long, n int, bins binary, groups binary, y binary, score binary, g binary, h binary"


def by_size(starts: np.ndarray, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """Places of the rows of groups of one size (groups by rows), a bounded number of pairs at a time. starts: with the end."""
    size = np.diff(starts)
    for n in np.unique(size):
        some = starts[:-1][size == n]
        step = max(1, limit // int(n * n))
        for k in range(0, len(some), step):
            yield some[k : k + step, None] + np.arange(n)


def pair_gradients(y: np.ndarray, score: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Downward gradient and curvature of the pairwise logistic loss.

    A pair weighs the difference of its labels as a share of the largest in its group, over the group's other rows: groups count
    alike whatever the level and spread of their labels, as they do in NDCG.
    """
    g, h = np.zeros(len(y)), np.zeros(len(y))
    for at in by_size(starts):
        if at.shape[1] < 2:
            continue
        spread = np.maximum(y[at].max(axis=1) - y[at].min(axis=1), 1e-12)
        better = np.maximum(y[at][:, :, None] - y[at][:, None, :], 0) / (spread * (at.shape[1] - 1))[:, None, None]
        doubt = 1 / (1 + np.exp(np.clip(score[at][:, :, None] - score[at][:, None, :], -50, 50)))
        pull, bend = better * doubt, better * doubt * (1 - doubt)
        g[at] = pull.sum(axis=2) - pull.sum(axis=1)
        h[at] = bend.sum(axis=2) + bend.sum(axis=1)
    return g, h


def group_ndcg(y: np.ndarray, score: np.ndarray, starts: np.ndarray, k: int = 10) -> tuple[float, int]:
    """Sum of NDCG@k over groups with a positive label, and their number."""
    total, n = 0.0, 0
    for at in by_size(starts):
        labels = y[at]
        weight = np.where(np.arange(at.shape[1]) < k, 1 / np.log2(np.arange(at.shape[1]) + 2), 0)
        got = np.take_along_axis(labels, np.argsort(-score[at], axis=1, kind="stable"), 1) @ weight
        best = -np.sort(-labels, axis=1) @ weight
        total += float((got[best > 0] / best[best > 0]).sum())
        n += int((best > 0).sum())
    return total, n


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of rows by columns: 0 for missing, else one more than the edges below the value."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j]))
    return out


class Tree:
    """A complete binary tree in arrays: bins up to ``cut`` of ``column`` go left; column -1 ends."""

    def __init__(self, depth: int):
        self.depth = depth
        self.column, self.cut = np.full(2**depth - 1, -1), np.zeros(2**depth - 1, int)
        self.value = np.zeros(2 ** (depth + 1) - 1)

    def nodes(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node that each row (rows by columns) reaches after so many levels; rows stay where a node ends."""
        node = np.zeros(len(bins), np.int64)
        for _ in range(self.depth if depth is None else depth):
            inner = np.minimum(node, len(self.column) - 1)
            moving = (node < len(self.column)) & (self.column[inner] >= 0)
            right = bins[np.arange(len(bins)), np.maximum(self.column[inner], 0)] > self.cut[inner]
            node = np.where(moving, 2 * node + 1 + right, node)
        return node

    def score(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]

    def plain(self) -> dict:
        return {"depth": self.depth, "column": self.column.tolist(), "cut": self.cut.tolist(), "value": self.value.tolist()}

    @staticmethod
    def made(plain: dict) -> Tree:
        out = Tree(plain["depth"])
        out.column, out.cut, out.value = np.array(plain["column"]), np.array(plain["cut"]), np.array(plain["value"])
        return out


def bounded(score: np.ndarray) -> np.ndarray:
    """Scores between 0 and 1 in the same order."""
    return 0.5 + 0.5 * score / (1 + np.abs(score))


def _arrays(row: dict, columns: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, columns)
    return bins, np.frombuffer(row["groups"], np.int32), *(np.frombuffer(row[c], np.float64) for c in ("y", "score", "g", "h"))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("block", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("bins", "groups", "y", "score", "g", "h")]]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def packed(df: DataFrame, group: str, label: str, columns: list[str], edges: list[np.ndarray], seed: int = 42, order: str = "idx") -> DataFrame:
    """Blocks of whole groups. A group beyond GROUP rows is dealt by a hash of its rows' ``order`` to parts that are compared
    within themselves; rows without a group belong to no pair and are left out."""
    some = df.filter(F.col(group).isNotNull() & F.col(label).isNotNull())
    sizes = some.groupBy(F.col(group).alias("group__")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts__")).filter("parts__ > 1")
    some = some.join(sizes, F.col(group) == F.col("group__"), "left")
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(order)), F.coalesce("parts__", F.lit(1)))
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    some = some.select(F.xxhash64(F.col(group), part).alias("group"), F.col(order).alias("order"), F.col(label).cast("double").alias("y"), values.alias("x"))
    blocks = max(1, -(-some.count() // BLOCK))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["group", "order"], kind="stable")
        x = np.array([[np.nan if v is None else v for v in r] for r in rows["x"]], float).reshape(len(rows), len(columns))
        names = rows["group"].to_numpy()
        starts = np.r_[np.flatnonzero(np.r_[True, names[1:] != names[:-1]]), len(rows)].astype(np.int32)
        zero = np.zeros(len(rows)).tobytes()
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "n": [len(rows)], "bins": [binned(x, edges).tobytes()], "groups": [starts.tobytes()], "y": [rows["y"].to_numpy(float).tobytes()], "score": [zero], "g": [zero], "h": [zero]})

    return some.withColumn("block", F.pmod("group", F.lit(blocks))).groupBy("block").applyInPandas(pack, _BLOCK)


def advanced(blocks: DataFrame, tree: Tree | None, columns: int) -> DataFrame:
    """Blocks after one more tree, with the gradients of the new scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                bins, groups, y, score, _, _ = _arrays(row, columns)
                score = score + tree.score(bins) if tree is not None else score
                g, h = pair_gradients(y, score, groups)
                out.append(row | {"score": score.tobytes(), "g": g.tobytes(), "h": h.tobytes()})
            yield _batch(out)

    return blocks.mapInArrow(run, _BLOCK)


def histograms(blocks: DataFrame, tree: Tree, level: int, columns: int) -> DataFrame:
    """node, column, bin, g and h: sums over the rows that reach a node of this level, added up within each task."""
    first, nodes = 2**level - 1, 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, columns, nodes * BINS))
        for batch in batches:
            for row in batch.to_pylist():
                bins, _, _, _, g, h = _arrays(row, columns)
                at = tree.nodes(bins, level)
                here = at >= first
                base, g, h = (at[here] - first) * BINS, g[here], h[here]
                for j in range(columns):
                    code = base + bins[here, j]
                    sums[0, j] += np.bincount(code, g, nodes * BINS)
                    sums[1, j] += np.bincount(code, h, nodes * BINS)
        column, code = np.nonzero(sums[1])
        ints = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays([ints(first + code // BINS), ints(column), ints(code % BINS), pa.array(sums[0][column, code]), pa.array(sums[1][column, code])], ["node", "column", "bin", "g", "h"])

    return blocks.mapInArrow(run, "node int, column int, bin int, g double, h double")


def best_splits(sums: DataFrame, smooth: float) -> DataFrame:
    """node, column, cut, gain, and g and h of the left side and of the node: the split of most gain; of equals the first column and bin."""
    one = sums.repartition("node", "column").groupBy("node", "column", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    of = Window.partitionBy("node", "column")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    left = one.select("node", "column", "bin", F.sum("g").over(upto).alias("lg"), F.sum("h").over(upto).alias("lh"), F.sum("g").over(of).alias("g"), F.sum("h").over(of).alias("h"))
    value = lambda g, h: g * g / (h + smooth)
    g, h, lg, lh = (F.col(c) for c in ("g", "h", "lg", "lh"))
    left = left.withColumn("gain", value(lg, lh) + value(g - lg, h - lh) - value(g, h))
    top = F.max_by(F.struct("column", F.col("bin").alias("cut"), "gain", "lg", "lh", "g", "h"), F.struct("gain", -F.col("column"), -F.col("bin")))
    return left.groupBy("node").agg(top.alias("s")).select("node", "s.*")


class GroupRanker(Model):
    """Boosting of pairwise logistic loss within requests; numeric columns as they are, categories by ordered target statistics.

    df has request_id, label and a unique idx. Rows without a request take no part in training.
    """

    def __init__(self, iterations: int = 20, depth: int = 5, rate: float = 0.2, smooth: float = 1.0, seed: int = 42):
        self.iterations, self.depth, self.rate, self.smooth, self.seed = iterations, depth, rate, smooth, seed
        self.trees: list[Tree] = []

    def train(self, df: DataFrame, numeric: list[str], categorical: list[str]) -> GroupRanker:
        self.numeric, self.categorical = list(numeric), list(categorical)
        names = self.numeric + self.categorical
        some = df.filter(F.col("request_id").isNotNull() & F.col("label").isNotNull())
        some = some.select("idx", "request_id", F.col("label").cast("double").alias("label"), *[f"`{c}`" for c in names])
        self.mean = some.agg(F.avg("label")).first()[0] or 0.0
        self.found = kept(statistics(some, self.categorical, "label"), "statistics")
        made = ordered(some, self.categorical, "label", self.mean, seed=self.seed) if self.categorical else some
        columns = self.numeric + [f"{c}__stat" for c in self.categorical]
        # a column more than once under its own name would be asked for twice
        made = kept(made.select("idx", "request_id", "label", *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]), "ranking")
        plain = [f"x{i}" for i in range(len(columns))]
        shares = [k / (BINS - 1) for k in range(1, BINS - 1)]
        quantiles = made.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in plain]).stat.approxQuantile(plain, shares, 0.002)
        self.edges = [np.unique(np.array(q, float)) for q in quantiles]
        blocks = kept(packed(made, "request_id", "label", plain, self.edges, self.seed), "blocks")
        self.trees, self.gains, tree = [], np.zeros(len(columns)), None
        with small_batches(blocks.sparkSession):
            for _ in range(self.iterations):
                blocks = kept(advanced(blocks, tree, len(columns)), "round")
                tree = self._grown(blocks, len(columns))
                if tree.column[0] < 0:
                    break
                self.trees.append(tree)
            self.blocks = blocks
        return self

    def _grown(self, blocks: DataFrame, columns: int) -> Tree:
        tree = Tree(self.depth)
        sums: dict[int, tuple[float, float]] = {}
        for level in range(self.depth):
            found = best_splits(histograms(blocks, tree, level, columns), self.smooth).collect()
            split = [s for s in found if s.gain > 1e-9]
            for s in found:
                sums.setdefault(s.node, (s.g, s.h))
            for s in split:
                tree.column[s.node], tree.cut[s.node] = s.column, s.cut
                self.gains[s.column] += s.gain
                sums[2 * s.node + 1], sums[2 * s.node + 2] = (s.lg, s.lh), (s.g - s.lg, s.h - s.lh)
            if not split:
                break
        for node, (g, h) in sums.items():
            tree.value[node] = self.rate * g / (h + self.smooth)
        return tree

    def predict(self, df: DataFrame) -> DataFrame:
        """df with score, between 0 and 1 (the sum of trees over its distance from none), as metrics that pad lists with zeros expect."""
        missing = [c for c in self.numeric + self.categorical if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}")
        importable(df.sparkSession)
        edges, trees = self.edges, self.trees

        @F.pandas_udf("double")
        def score(*values: pd.Series) -> pd.Series:
            bins = binned(np.stack([v.to_numpy(float, na_value=np.nan) for v in values], axis=1), edges)
            return pd.Series(bounded(sum((t.score(bins) for t in trees), np.zeros(len(bins)))))

        out = encoded(df, self.categorical, self.found, self.mean)
        columns = self.numeric + [f"{c}__stat" for c in self.categorical]
        value: Column = score(*[F.col(f"`{c}`").cast("double") for c in columns]) if columns else F.lit(0.0)
        return out.withColumn("score", value).select(*[F.col(f"`{c}`") for c in df.columns if c != "score"], "score")

    def importance(self) -> dict[str, float]:
        """Shares of the gain of all splits, in percent."""
        total = self.gains.sum() or 1.0
        return dict(zip(self.numeric + self.categorical, (100 * self.gains / total).tolist(), strict=True))

    def loss_importance(self, k: int = 10) -> dict[str, float]:
        """How much NDCG@k on the rows of training falls when a column changes places within requests: all columns from one pass."""
        trees, columns, seed = self.trees, len(self.gains), self.seed
        used = sorted({int(c) for t in trees for c in t.column if c >= 0})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lost, groups = np.zeros(columns), 0
            for batch in batches:
                for row in batch.to_pylist():
                    bins, starts, y, *_ = _arrays(row, columns)
                    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                    scored = lambda b: sum((t.score(b) for t in trees), np.zeros(len(b)))
                    base, n = group_ndcg(y, scored(bins), starts, k)
                    groups += n
                    for c in used:
                        moved = bins.copy()
                        moved[:, c] = bins[np.lexsort((np.random.default_rng([seed, row["block"], c]).random(len(of)), of)), c]
                        lost[c] += base - group_ndcg(y, scored(moved), starts, k)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(columns, dtype=np.int32)), pa.array(lost), pa.array(np.full(columns, groups, np.int64))], ["column", "lost", "groups"])

        with small_batches(self.blocks.sparkSession):
            rows = self.blocks.mapInArrow(run, "column int, lost double, groups long").groupBy("column").agg((F.sum("lost") / F.greatest(F.sum("groups"), F.lit(1))).alias("lost")).collect()
        lost = {r["column"]: r["lost"] for r in rows}
        return {c: lost.get(i, 0.0) for i, c in enumerate(self.numeric + self.categorical)}

    def save(self, path: str) -> None:
        """Trees and edges as one JSON line, and beside them the statistics of categories."""
        spark = self.found.sparkSession
        made = {k: getattr(self, k) for k in ("iterations", "depth", "rate", "smooth", "seed", "numeric", "categorical", "mean")}
        made |= {"trees": [t.plain() for t in self.trees], "edges": [e.tolist() for e in self.edges], "gains": self.gains.tolist()}
        spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/trees")
        self.found.write.mode("overwrite").parquet(f"{path}/statistics")

    @staticmethod
    def load(path: str) -> GroupRanker:
        spark = SparkSession.active()
        made = json.loads(spark.read.text(f"{path}/trees").first()[0])
        out = GroupRanker(*(made[k] for k in ("iterations", "depth", "rate", "smooth", "seed")))
        out.numeric, out.categorical, out.mean = made["numeric"], made["categorical"], made["mean"]
        out.trees, out.edges, out.gains = [Tree.made(t) for t in made["trees"]], [np.array(e) for e in made["edges"]], np.array(made["gains"])
        out.found = spark.read.parquet(f"{path}/statistics")
        return out
