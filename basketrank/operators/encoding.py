"""Categories as numbers: ordered target statistics.

Each row's category becomes the mean label of the rows of that category before it in a fixed random order, so that no row
sees its own label; new rows get the mean over all. A prior row with the mean label stands before each category.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the prior counts for.
PRIOR = 1.0


def text_of(column: str) -> Column:
    """A category as text; null is one of its own."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("NA"))


def _mean(total: Column, n: Column, mean: float) -> Column:
    return (F.coalesce(total, F.lit(0.0)) + PRIOR * mean) / (F.coalesce(n, F.lit(0)) + PRIOR)


def ordered(df: DataFrame, columns: list[str], label: str, mean: float, order: str = "idx", seed: int = 42) -> DataFrame:
    """df with <column>__stat for each column: the mean label of earlier rows of its category. order: a unique column.

    The random order (a hash of ``order``) is cut into ranges, as many as the root of the largest category's rows. Sums before a
    range come from one row a category and range; sums within one from a window over it. So a category that most
    rows share is dealt to many tasks.
    """
    place = F.xxhash64(F.lit(seed), F.col(order))
    df = df.withColumn("place__", place)
    for c in columns:
        named = df.withColumn("value__", text_of(c))
        most = named.groupBy("value__").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        ranges = max(1, math.isqrt(most))
        named = named.withColumn("range__", F.floor((F.col("place__") / 2.0**64 + 0.5) * ranges).cast("int"))
        parts = named.groupBy("value__", "range__").agg(F.sum(label).alias("total"), F.count(label).alias("n"))
        so_far = Window.partitionBy("value__").orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
        starts = parts.select("value__", "range__", F.sum("total").over(so_far).alias("total__"), F.sum("n").over(so_far).alias("n__"))
        within = Window.partitionBy("value__", "range__").orderBy("place__", order).rowsBetween(Window.unboundedPreceding, -1)
        here = named.withColumns({"here__": F.sum(label).over(within), "seen__": F.count(label).over(within)})
        both = here.join(starts, ["value__", "range__"])
        zero = lambda x: F.coalesce(x, F.lit(0))
        stat = _mean(zero("here__") + zero("total__"), zero("seen__") + zero("n__"), mean)
        df = both.withColumn(f"{c}__stat", stat).drop("value__", "range__", "here__", "seen__", "total__", "n__")
    return df.drop("place__")


def statistics(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """column, value, total and n of the labels of each category."""
    out = None
    for c in columns:
        one = df.groupBy(text_of(c).alias("value")).agg(F.sum(label).alias("total"), F.count(label).alias("n")).select(F.lit(c).alias("column"), "value", F.col("total").cast("double"), "n")
        out = one if out is None else out.union(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "column string, value string, total double, n long")


def encoded(df: DataFrame, columns: list[str], found: DataFrame, mean: float) -> DataFrame:
    """df with <column>__stat from statistics; a category that they do not know gets the mean label."""
    for c in columns:
        one = found.filter(F.col("column") == c).select(F.col("value").alias("value__"), "total", "n")
        df = df.withColumn("value__", text_of(c)).join(one, "value__", "left").withColumn(f"{c}__stat", _mean(F.col("total"), F.col("n"), mean)).drop("value__", "total", "n")
    return df
