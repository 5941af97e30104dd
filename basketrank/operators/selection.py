"""Choice of features by correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and the absolute Pearson correlation of each pair of columns over rows where both are present.

    Columns are first shifted by their means; each batch then adds to matrices of sums over rows where both are
    present, so n columns cost n^2 numbers a task instead of n^2 / 2 expressions.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    some = df.select([F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    means = [m or 0.0 for m in some.agg(*[F.avg(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`"))) for c in columns]).first()]
    i, j = np.triu_indices(len(columns), 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(columns), len(columns)))
        for batch in batches:
            x = batch.to_numpy(float) - means
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x, 0.0)
            total += [there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x]
        yield pd.DataFrame({"i": i, "j": j, "n": total[0][i, j], "x": total[1][i, j], "y": total[2][i, j], "xx": total[3][i, j], "yy": total[4][i, j], "xy": total[5][i, j]})

    fields = ["n", "x", "y", "xx", "yy", "xy"]
    one = some.mapInPandas(sums, "i int, j int, n double, x double, y double, xx double, yy double, xy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in fields])
    spread = lambda s, ss: F.greatest(F.col("n") * F.col(ss) - F.col(s) * F.col(s), F.lit(0.0))
    value = F.abs(F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(spread("x", "xx") * spread("y", "yy"))))
    names = F.array(*map(F.lit, columns))
    return one.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), value.alias("corr"))


def select(columns: list[str], corr: dict[tuple[str, str], float | None], importance: dict[str, float], threshold: float = 0.9) -> list[str]:
    """Greedy groups around seeds in column order; the most important column of each group stays (ties: the first)."""
    free, kept = list(columns), []
    while free:
        seed = free.pop(0)
        near = [c for c in free if (x := corr.get((seed, c), corr.get((c, seed)))) is not None and not math.isnan(x) and x > threshold]
        free = [c for c in free if c not in near]
        kept.append(max([seed, *near], key=lambda c: importance.get(c, 0.0)))
    return [c for c in columns if c in kept]
