"""Vectors of words from their character n-grams: skip-gram with negative samples, trained in rounds of Spark jobs.

A word's vector is the mean of those of its n-grams (and of itself), which are hashed to a table of BUCKETS rows, so unseen and
misspelt words have vectors near those that they share n-grams with. Pairs of a word and a word near it are
counted on Spark. In a round every task takes steps over its pairs on a copy of the tables (of a fixed size, whatever the corpus), and the
tables of the next round are the means of what the tasks made of each row, by how often they changed it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import importable, kept

#: Rows of the tables of n-grams and of contexts; lengths of n-grams; words on either side; negative samples a pair.
BUCKETS, SHORTEST, LONGEST, NEAR, NEGATIVES = 1 << 15, 3, 5, 5, 5
#: Pairs that a step takes at once, and n-grams of a word at most that count (the first ones of very long words).
STEP, GRAMS = 256, 64


def grams(word: str) -> list[int]:
    """Buckets of a word and of its n-grams, between marks of its two ends."""
    marked = f"<{word}>"
    some = [marked, *[marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)]]
    return [zlib.crc32(g.encode()) % BUCKETS for g in dict.fromkeys(some[:GRAMS])]


def context(word: str) -> int:
    return zlib.crc32(b"\0" + word.encode()) % BUCKETS


class Tables:
    """Vectors of n-gram buckets (inner) and of context buckets (outer)."""

    def __init__(self, inner: np.ndarray, outer: np.ndarray):
        self.inner, self.outer = inner, outer

    @staticmethod
    def start(size: int, seed: int) -> Tables:
        dice = np.random.default_rng(seed)
        return Tables(((dice.random((BUCKETS, size)) - 0.5) / size).astype(np.float32), np.zeros((BUCKETS, size), np.float32))

    def _matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of each word, filled up, and the share of each in its word's vector."""
        of = [grams(w) for w in words]
        out, share = np.zeros((len(of), max(map(len, of), default=1)), np.int64), np.zeros((len(of), max(map(len, of), default=1)), np.float32)
        for i, g in enumerate(of):
            out[i, : len(g)], share[i, : len(g)] = g, 1 / len(g)
        return out, share

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.inner.shape[1]), np.float32)
        for k in range(0, len(words), 4096):
            g, share = self._matrix(words[k : k + 4096])
            out[k : k + 4096] = np.einsum("ng,ngd->nd", share, self.inner[g])
        return out

    def learn(self, words: list[str], contexts: list[str], n: np.ndarray, passes: int, rate: float, dice: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Steps over pairs (each as often as the root of its count, as frequent ones teach little more), of which every n-gram of
        a word takes the whole; how often each row of both tables changed."""
        changed = np.zeros((2, BUCKETS), np.int64)
        names = list(dict.fromkeys(words))
        at = {w: i for i, w in enumerate(names)}
        g, share = self._matrix(names)
        who, other = np.array([at[w] for w in words]), np.array([context(w) for w in contexts])
        pairs = np.repeat(np.arange(len(words)), np.ceil(np.sqrt(n)).astype(int))
        for _ in range(passes):
            order = dice.permutation(pairs)
            for lo in range(0, len(order), STEP):
                some = order[lo : lo + STEP]
                w, c = who[some], np.concatenate([other[some][:, None], dice.permuted(np.repeat(other[some][:, None], NEGATIVES, axis=1), axis=0)], axis=1)
                # a negative that is the pair's own context teaches nothing
                fresh = np.concatenate([np.ones((len(some), 1), bool), c[:, 1:] != c[:, :1]], axis=1)
                v, o = np.einsum("ng,ngd->nd", share[w], self.inner[g[w]]), self.outer[c]
                z = np.clip(np.einsum("nd,ncd->nc", v, o), -30, 30)
                pull = (np.r_[1.0, np.zeros(NEGATIVES)][None, :] - 1 / (1 + np.exp(-z))) * fresh * rate
                step_v = np.einsum("nc,ncd->nd", pull, o)
                np.add.at(self.outer, c, (pull[:, :, None] * v[:, None, :]).astype(np.float32))
                used = share[w] > 0
                np.add.at(self.inner, g[w][used], np.broadcast_to(step_v[:, None, :], (*used.shape, step_v.shape[1]))[used].astype(np.float32))
                np.add.at(changed[0], g[w][used], 1)
                np.add.at(changed[1], c[fresh], 1)
        return changed[0], changed[1]


def pairs_of(items: DataFrame, words: str) -> DataFrame:
    """word, context and n: how often a word stands within NEAR words of another."""
    near = F.flatten(F.transform(words, lambda w, i: F.transform(F.filter(F.slice(words, F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR)) + NEAR + 1), lambda c: c != w), lambda c: F.struct(w.alias("word"), c.alias("context")))))
    return items.select(F.inline(near)).groupBy("word", "context").agg(F.count("*").alias("n"))


def trained(items: DataFrame, words: str, size: int = 64, rounds: int = 3, passes: int = 3, rate: float = 0.25, seed: int = 42, share: int = 200_000) -> Tables:
    """Tables from arrays of words; share: distinct pairs that a task takes."""
    pairs = kept(pairs_of(items, words), "pairs")
    n = pairs.count()
    tables = Tables.start(size, seed)
    parts = max(1, -(-n // share))
    # dealt by the word, so that most n-grams change in few tasks; equal on reruns
    pairs = kept(pairs.repartition(parts, F.pmod(F.xxhash64(F.lit(seed), "word"), F.lit(parts))).sortWithinPartitions("word", "context"), "dealt")
    for round_ in range(rounds if n else 0):
        shared = items.sparkSession.sparkContext.broadcast((tables.inner, tables.outer))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            rows = [b for b in batches if len(b)]
            if not rows:
                return
            t = pa.Table.from_batches(rows)
            mine = Tables(*(x.copy() for x in shared.value))
            dice = np.random.default_rng([seed, round_, zlib.crc32(t.column("word")[0].as_py().encode())])
            changed = mine.learn(t.column("word").to_pylist(), t.column("context").to_pylist(), t.column("n").to_numpy(), passes, rate, dice)
            for kind, (table, often) in enumerate(zip((mine.inner, mine.outer), changed, strict=True)):
                at = np.flatnonzero(often)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(often[at]), pa.array(list(table[at]), pa.list_(pa.float32()))], ["kind", "bucket", "often", "v"])

        moved = pairs.mapInArrow(run, "kind int, bucket int, often long, v array<float>")
        mean = F.array(*[F.sum(F.col("often") * F.get("v", F.lit(i))) / F.sum("often") for i in range(size)])
        # no more rows than the tables have
        made = moved.groupBy("kind", "bucket").agg(mean.alias("v")).toArrow()
        inner, outer = tables.inner.copy(), tables.outer.copy()
        kind, bucket = made.column("kind").to_numpy(), made.column("bucket").to_numpy()
        v = made.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float32) if len(kind) else np.zeros((0, size), np.float32)
        inner[bucket[kind == 0]], outer[bucket[kind == 1]] = v[kind == 0], v[kind == 1]
        tables = Tables(inner, outer)
        shared.unpersist()
    return tables


def text_vectors(items: DataFrame, key: str, words: str, tables: Tables) -> DataFrame:
    """key and vector: the mean of a text's word vectors, each brought to unit length; zeros without words."""
    importable(items.sparkSession)
    shared, size = items.sparkSession.sparkContext.broadcast((tables.inner, tables.outer)), tables.inner.shape[1]

    @F.pandas_udf("array<double>")
    def mean(texts: pd.Series) -> pd.Series:
        mine = Tables(*shared.value)
        cut = [[w for w in t if w] if t is not None else [] for t in texts]
        names = list(dict.fromkeys(w for t in cut for w in t))
        v = mine.words(names).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        at = {w: i for i, w in enumerate(names)}
        return pd.Series([v[[at[w] for w in t]].mean(axis=0).tolist() if t else [0.0] * size for t in cut])

    return items.select(key, mean(words).alias("vector"))
