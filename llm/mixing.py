"""Mixing sources to target weights by balanced sampling (the cube method).

A document of a source with target / size = r is taken floor(r) times, and once more with
probability r - floor(r). Which documents get the extra copy is decided by the flight phase of the
cube method: as long as three documents of a source have fractional probabilities there is a
direction that changes neither the expected number of documents nor the expected number of words;
the probabilities move along it, one way or the other at random and without bias, until one of them
is 0 or 1. Flights run in parallel over bounded parts of a source; the at most two documents that a
part leaves open meet again in fewer parts, until each source has one part. There the landing
decides the last two so that the source's words come closest to the target.

Random numbers and parts are hashes of the seed and the documents, so reruns agree, whatever the
partitions are; only which of equal rows is taken may change. A null source is a source
of its own, sorted last; a null text has no words and is never taken beyond its share; documents
without words take part like any others. Repeated rows are decided row by row. An empty table gives an empty result;
other columns of docs are left out; of a very long text only its number of words matters. One row for each source
comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Documents of a source whose probabilities move together.
PART = 8192


def targets(sizes: dict[str | None, int], share: float, weights: tuple[float, ...], most: float) -> dict[str | None, float]:
    """Words to take of each source: by weight, at most ``most`` times its size, the excess shared again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = share * sum(sizes.values()), list(names), dict.fromkeys(names, 0.0)
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if total * weight[s] / whole > most * sizes[s]]
        if not over:
            out |= {s: total * weight[s] / whole for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            total -= out[s]
            open_.remove(s)
    return out


def flight(p: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Moves probabilities until at most two are fractional; sums of p and of p * sizes stay."""
    p, tiny = p.astype(float).copy(), 1e-9
    scale = max(float(sizes.max(initial=0)), 1.0)
    x = (sizes / scale).tolist()
    rest = np.flatnonzero((p > tiny) & (p < 1 - tiny)).tolist()
    values, dice = p.tolist(), random.random(len(p) + 1).tolist()
    held, k, step = [], 0, 0
    while True:
        while len(held) < 3 and k < len(rest):
            held.append(rest[k])
            k += 1
        if len(held) < 3:
            break
        a, b, c = held
        # orthogonal to (1, 1, 1) and to the sizes
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if max(map(abs, u)) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for d, i in zip(u, held, strict=True):
            v = values[i]
            if d > 0:
                up, down = min(up, (1 - v) / d), min(down, v / d)
            elif d < 0:
                up, down = min(up, v / -d), min(down, (1 - v) / -d)
        move = up if dice[step] * (up + down) < down else -down
        step += 1
        for d, i in zip(u, held, strict=True):
            v = values[i] + move * d
            values[i] = 0.0 if v < tiny else 1.0 if v > 1 - tiny else v
        held = [i for i in held if 0.0 < values[i] < 1.0]
    return np.array(values)


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Settles the last few so that the words come closest to what was expected."""
    p = np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))
    left = np.flatnonzero((p > 0) & (p < 1))
    want = float((p[left] * sizes[left]).sum())
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(int(sizes[i]) for j, i in enumerate(left) if m >> j & 1) - want), m))
    for j, i in enumerate(left):
        p[i] = float(best >> j & 1)
    return p


def _settle(seed: int, level: int, last: bool) -> Callable:
    """One part of a source at one level; the last level lands."""

    def settle(batch: pd.DataFrame) -> pd.DataFrame:
        # neighbours in the order of the dice move together
        batch = batch.sort_values(["dice", "nth", "p"], kind="stable").reset_index(drop=True)
        sizes = batch["size"].to_numpy()
        p = flight(batch["p"].to_numpy(), sizes, np.random.default_rng([seed, level, int(batch["dice"].iloc[0] * (1 << 53))]))
        batch["p"] = landing(p, sizes) if last else p
        return batch

    return settle


def numbered(rows: DataFrame) -> DataFrame:
    """rows with row, a number of the row, and nth, its place among the rows of its doc_id, source and text_hash.

    Equal rows are counted in each partition first, so that no task sees all of a row that repeats without end.
    """
    key = ["doc_id", "source", "text_hash"]
    rows = rows if "row" in rows.columns else rows.withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("piece", F.shiftright("row", 33)), "mix-numbers")
    counts = rows.groupBy(*key, "piece").agg(F.count("*").alias("k"))
    again = counts.withColumn("before", F.sum("k").over(Window.partitionBy(*key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))).filter("before > 0")
    again = written(again.select(*[F.col(c).alias(f"{c}_") for c in key], F.col("piece").alias("piece_"), "before"), "mix-repeats")
    same = (F.col("piece") == F.col("piece_")) & F.col("text_hash").eqNullSafe(F.col("text_hash_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")) & F.col("source").eqNullSafe(F.col("source_"))
    local = F.row_number().over(Window.partitionBy(*key, "piece").orderBy("row"))
    out = rows.withColumn("local", local).join(again, same, "left").withColumn("nth", F.col("local") + F.coalesce("before", F.lit(0)))
    return written(out.select(*key, "size", "row", "nth"), "mix-places")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), most: float = 2.0, seed: int = 7, part: int = PART, row: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the document is taken), taken (words taken), row (a number of the row; with row those of docs, made by monotonically_increasing_id)."""
    spark = docs.sparkSession
    given = ["row"] if row else []
    rows = numbered(docs.select(F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("text_hash"), word_count().alias("size"), *given))
    # one row for each source comes to the driver
    totals = {r["source"]: (int(r["n"]), int(r["words"])) for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()}
    aims = targets({s: w for s, (_, w) in totals.items()}, share, weights, most)
    plan = [(s, totals[s][1], float(aims[s]), aims[s] / totals[s][1] if totals[s][1] else 0.0) for s in totals]
    plan_df = spark.createDataFrame(plan, "source string, source_size long, target double, rate double")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = (
        rows.join(plan_df.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("base", F.floor("rate").cast("int"))
        .withColumn("p", F.col("rate") - F.floor("rate"))
        .withColumn("dice", drawn)
    )
    whole = whole.withColumn("deal", F.xxhash64("dice", "nth"))
    whole = written(whole.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).when(F.col("p") > 1 - 1e-9, 1.0).otherwise(F.col("p"))), "mix-rows")
    open_rows = whole.filter((F.col("p") > 0) & (F.col("p") < 1)).select("source", "row", "nth", "size", "p", "dice", "deal")
    settled: DataFrame | None = None
    most_rows = max((n for n, _ in totals.values()), default=0)
    level = 0
    while most_rows:
        parts = -(-most_rows // part)
        last = parts == 1

        split = open_rows.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(level)), F.lit(parts)))
        moved = written(split.groupBy("source", "part").applyInPandas(_settle(seed, level, last), "source string, row long, nth long, size long, p double, dice double, deal long, part long").drop("part"), f"mix-{level}")
        done = moved.filter((F.col("p") <= 0) | (F.col("p") >= 1)).select("row", F.col("p").cast("int").alias("extra"))
        settled = done if settled is None else settled.union(done)
        if last:
            break
        open_rows = moved.filter((F.col("p") > 0) & (F.col("p") < 1))
        most_rows = max((int(r["n"]) for r in open_rows.groupBy("source").agg(F.count("*").alias("n")).collect()), default=0)
        level += 1
    if settled is not None:
        whole = whole.join(settled, "row", "left")
        copies = F.col("base") + F.coalesce(F.col("extra"), F.col("p").cast("int"))
    else:
        copies = F.col("base") + F.col("p").cast("int")
    return whole.withColumn("copies", copies).select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row")
