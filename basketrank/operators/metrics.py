"""Ranking and classification metrics as aggregations; df has the columns named."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import running


def ndcg(df: DataFrame, group: str, label: str, score: str, k: int = 10, order: str = "idx", mode: str = "reference") -> DataFrame:
    """One row ndcg: mean over groups with a positive sum; tied scores share their mean gain.

    reference: the ideal order is that of the k retrieved labels, and a list shorter than k is padded with zeros of score 0.
    standard: the ideal order is that of all labels of the group.
    """
    some = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s"), F.col(order).alias("o"))
    some = some.withColumn("total", F.sum("y").over(Window.partitionBy("g"))).filter("total > 0")
    by = Window.partitionBy("g").orderBy(F.desc("s"), "o")
    top = some.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).select("g", "y", "s")
    if mode == "reference":
        size = top.groupBy("g").agg(F.count("*").alias("n"))
        pad = size.filter(F.col("n") < k).select("g", F.explode(F.sequence(F.lit(1), F.lit(k) - F.col("n"))).alias("i")).select("g", F.lit(0.0).alias("y"), F.lit(0.0).alias("s"))
        top = top.unionByName(pad)
    rank = top.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s")))).withColumn("d", 1 / F.log2(F.col("r") + 1))
    gain = rank.groupBy("g", "s").agg((F.avg("y") * F.sum("d")).alias("x")).groupBy("g").agg(F.sum("x").alias("dcg"))
    pool = top if mode == "reference" else some
    best = pool.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("y")))).filter(F.col("r") <= k).groupBy("g").agg(F.sum(F.col("y") / F.log2(F.col("r") + 1)).alias("ideal"))
    return gain.join(best, "g").agg(F.coalesce(F.avg(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0))), F.lit(0.0)).alias("ndcg"))


def mean_average_precision(df: DataFrame, group: str, label: str, score: str, k: int = 10, order: str = "idx") -> DataFrame:
    """One row map: mean over groups with a positive of the sum of precisions at hits over all positives."""
    some = df.filter(F.col(group).isNotNull()).withColumn("hit", (F.col(label) > 0).cast("int"))
    by = Window.partitionBy(group).orderBy(F.desc(score), order)
    ranked = some.withColumn("r", F.row_number().over(by)).withColumn("hits", F.sum("hit").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    each = ranked.groupBy(group).agg(F.sum(F.when((F.col("r") <= k) & (F.col("hit") == 1), F.col("hits") / F.col("r")).otherwise(0.0)).alias("s"), F.sum("hit").alias("n"))
    return each.filter("n > 0").agg(F.coalesce(F.avg(F.col("s") / F.col("n")), F.lit(0.0)).alias("map"))


def novelty(df: DataFrame, popularity: DataFrame, k: int = 10) -> DataFrame:
    """Mean over users of the mean of 1 - popularity (product_id, popularity) in the top k by score."""
    by = Window.partitionBy("user_id").orderBy(F.desc("score"), "product_id")
    top = df.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).join(popularity, "product_id", "left")
    return top.groupBy("user_id").agg(F.avg(1 - F.coalesce("popularity", F.lit(0.0))).alias("x")).agg(F.avg("x").alias("novelty"))


def serendipity(df: DataFrame, k: int = 10) -> DataFrame:
    """Mean over users of the mean of score * (1 - has_purchased) in the top k."""
    by = Window.partitionBy("user_id").orderBy(F.desc("score"), "product_id")
    top = df.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k)
    return top.groupBy("user_id").agg(F.avg(F.col("score") * (1 - F.col("has_purchased"))).alias("x")).agg(F.avg("x").alias("serendipity"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from counts by score: wins and half of ties."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) > 0).cast("long")).alias("p"), F.sum((F.col(label) <= 0).cast("long")).alias("n"))
    won = running(by, ["s"], F.col("n"), "below")
    return won.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def log_loss(df: DataFrame, label: str, score: str) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg(F.avg(-(F.col(label) * F.ln(p) + (1 - F.col(label)) * F.ln(1 - p))).alias("logloss"))


def binarize(df: DataFrame, label: str) -> DataFrame:
    """Labels beyond 0 and 1 become whether they equal the largest."""
    top, graded = df.agg(F.max(label), F.max((~F.col(label).isin(0, 1)).cast("int"))).first()
    return df.withColumn(label, (F.col(label) == F.lit(top)).cast("double")) if graded else df
