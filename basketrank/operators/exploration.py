"""First looks at a log: counts, ranges, checks of keys, repeats and histograms, each one small aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import PURCHASE, VIEW, distinct, micros, number
from ..sources.shared import kept

QUARTILES = (0.25, 0.5, 0.75)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """How many distinct values a column has, null being one."""
    return df.agg(distinct(column).alias("n"))


def time_range(df: DataFrame) -> DataFrame:
    """First and last instant as text, and the days between them."""
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return df.agg(text(F.min("ts")).alias("earliest"), text(F.max("ts")).alias("latest"), ((F.max(micros()) - F.min(micros())) / 86_400_000_000).alias("days"))


def order_statistics(df: DataFrame, column: str, ranks: list[int], bins: int = 1024, small: int = 4096) -> dict[int, float]:
    """The values at some ranks (from 0) among a column's values that are not null, exactly.

    Each round counts an equal-width histogram of every interval that still holds a wanted rank, and goes on with the one bin
    the rank lies in, from the least to the largest value there. An interval of one value, or of few rows, ends it. What
    comes to the driver is bounded by the bins of the intervals, however many distinct values there are.
    """
    value = F.col(f"`{column}`").cast("double")
    some = df.select(value.alias("v")).filter("v is not null")
    low, high, n = some.agg(F.min("v"), F.max("v"), F.count("*")).first()
    out: dict[int, float] = {}
    # least and largest value, rows before, rows within, ranks wanted in it
    open_ = [(low, high, 0, n, sorted(set(ranks)))] if n else []
    while open_:
        done = [x for x in open_ if x[0] == x[1]]
        for lo, _, _, _, wanted in done:
            out |= dict.fromkeys(wanted, lo)
        open_ = [x for x in open_ if x[0] != x[1]]
        few = [x for x in open_ if x[3] <= small]
        for lo, hi, before, _, wanted in few:
            at = before
            rows = some.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").count().collect()
            for v, k in sorted((r.v, r["count"]) for r in rows):
                out |= {r: v for r in wanted if at <= r < at + k}
                at += k
        open_ = [x for x in open_ if x[3] > small]
        if not open_:
            break
        inside = lambda lo, hi: (F.col("v") >= lo) & (F.col("v") <= hi)
        # halves, as the width of an interval may pass the largest double
        place = lambda lo, hi: F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins), F.lit(bins - 1))
        cells = [F.when(inside(lo, hi), F.struct(F.lit(i).alias("i"), place(lo, hi).cast("int").alias("bin"))) for i, (lo, hi, *_) in enumerate(open_)]
        found = some.select("v", F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull()))).groupBy("i", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        following = []
        for i, (_, _, before, _, wanted) in enumerate(open_):
            for r in sorted((r for r in found if r.i == i), key=lambda r: r.bin):
                here = [k for k in wanted if before <= k < before + r.n]
                if here:
                    following.append((r.low, r.high, before, r.n, here))
                before += r.n
        open_ = following
    return out


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles of a column, between neighbours by their distance; None without values."""
    n = df.agg(F.count(f"`{column}`")).first()[0]
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    found = order_statistics(df, column, sorted({r for x in at for r in (math.floor(x), math.ceil(x))}))
    return [found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x)) for x in at]


def described(df: DataFrame, column: str) -> DataFrame:
    """Rows, mean, deviation, least, quartiles (between neighbours by their distance) and largest of a column."""
    df = kept(df.select(column), "described")
    quartiles = [F.lit(x).cast("double").alias(f"p{int(100 * q)}") for q, x in zip(QUARTILES, quantiles(df, column, QUARTILES), strict=True)]
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev(column).alias("std"), F.min(column).alias("least"), *quartiles, F.max(column).alias("largest"))


def distinct_per(df: DataFrame, key: str, column: str, nulls: bool = True) -> DataFrame:
    """Distinct values of a column for each key; nulls: a null key counts too."""
    return (df if nulls else df.filter(F.col(key).isNotNull())).groupBy(key).agg(distinct(column).alias("n"))


def keys_of_many(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys that have not just one value of a column."""
    return distinct_per(df, key, column, nulls=False).filter("n <> 1")


def one_to_many(df: DataFrame, key: str, column: str) -> DataFrame:
    """Whether any key has more than one value of a column."""
    return distinct_per(df, key, column, nulls=False).agg(F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("many"))


def _single(df: DataFrame, wanted: Column) -> DataFrame:
    """Users whose actions are all of one kind that is wanted, and their share of all."""
    by = df.groupBy("user_id").agg(F.min("action_type").alias("first"), F.max("action_type").alias("last"), number(F.col("action_type").isNull()).alias("unknown"))
    those = (F.col("first") == F.col("last")) & (F.col("unknown") == 0) & wanted
    return by.agg(number(those).alias("users"), F.try_divide(number(those), F.count("*")).alias("share"))


def view_only_users(df: DataFrame) -> DataFrame:
    return _single(df, F.col("first") == VIEW)


def single_action_users(df: DataFrame) -> DataFrame:
    return _single(df, F.col("first") != VIEW)


def duplicates(df: DataFrame, ignored: list[str]) -> DataFrame:
    """Rows that others equal in all but the ignored columns, and their share."""
    same = df.groupBy(*[c for c in df.columns if c not in ignored]).agg(F.count("*").alias("k"))
    again = F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0))
    return same.agg(again.alias("n"), F.try_divide(again, F.sum("k")).alias("share"))


def null_counts(df: DataFrame) -> DataFrame:
    """A row for each column: how many nulls."""
    one = df.agg(*[number(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)])))


def repeats(df: DataFrame) -> DataFrame:
    """For each product of a request: its rows, its actions in order, and how many different ones."""
    actions = F.array_sort(F.collect_set("action_type"))
    return df.groupBy("product_id", "request_id").agg(F.count("*").alias("n_repeats"), F.array_join(actions, ",").alias("actions"), F.size(actions).cast("long").alias("n_actions"))


def counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, most first."""
    return df.groupBy(column).agg(F.count("*").alias("actions_count")).orderBy(F.desc("actions_count"), column)


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The products bought most often; of equals the first by name."""
    bought = df.filter(F.col("action_type") == PURCHASE).groupBy("product_name").agg(F.count("*").alias("total_purchase"), F.min("product_id").alias("product_id"))
    return bought.orderBy(F.desc("total_purchase"), "product_name").limit(n)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0), its least value and its rows, of equal bins between the extremes; empty bins are left out."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width else F.lit(0)
    by = df.filter(F.col(column).isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return by.select("bin", (F.col("bin") * width + low).cast("double").alias("low"), "n")


def user_activity(df: DataFrame, bins: int = 50) -> DataFrame:
    """Histogram of users by how many rows they have."""
    return histogram(df.groupBy("user_id").agg(F.count("*").alias("rows")), "rows", bins)


def rows_per_day(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
