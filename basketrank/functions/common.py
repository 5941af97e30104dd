"""Expressions that generators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

VIEW, CLICK, CART, PURCHASE = "AT_View", "AT_Click", "AT_CartUpdate", "AT_Purchase"
DAY = 86_400_000_000

is_view = lambda: F.col("action_type") == VIEW
is_click = lambda: F.col("action_type") == CLICK
is_cart = lambda: F.col("action_type") == CART
is_buy = lambda: F.col("action_type").isin(CART, PURCHASE)


def micros(column: str | Column = "ts") -> Column:
    """Microseconds of a timestamp with or without zone (UTC sessions)."""
    return F.unix_micros(F.to_utc_timestamp(F.col(column) if isinstance(column, str) else column, "UTC"))


def number(condition: Column) -> Column:
    """How many rows meet a condition."""
    return F.count(F.when(condition, 1))


def distinct(column: str) -> Column:
    """Distinct values, null being one."""
    return F.countDistinct(column) + F.max(F.when(F.col(column).isNull(), 1).otherwise(0))


def attach(target: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows, each with what was found for its keys (null: nothing)."""
    return target.join(found, keys, "left")


def with_bounds(history: DataFrame) -> DataFrame:
    """History with its first and last instant (t_min, t_max, in microseconds), looked up at once as literals."""
    low, high = history.agg(F.min(micros()), F.max(micros())).first()
    return history.withColumns({"t_min": F.lit(low).cast("long"), "t_max": F.lit(high).cast("long")})


def running(df: DataFrame, order: list, amount: Column, name: str) -> DataFrame:
    """df with the sum of an amount over all rows before each one in a global order (no ties in it).

    Rows are range-partitioned and summed within partitions; one row a partition comes to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(parts, *order).withColumn("part__", F.spark_partition_id()), name)
    before, offsets = 0, []
    for part, total in sorted(map(tuple, dealt.groupBy("part__").agg(F.sum(amount)).collect())):
        offsets.append((part, before))
        before += total or 0
    starts = df.sparkSession.createDataFrame(offsets, "part__ int, start__ long")
    local = F.sum(amount).over(Window.partitionBy("part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("local__", F.coalesce(local, F.lit(0))).join(F.broadcast(starts), "part__").withColumn(name, F.col("local__") + F.col("start__")).drop("part__", "start__", "local__")
