"""Splits by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timewise(df: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows before, and rows from, the last instant less some days.

    The cut is looked up at once (one row) and stands in both plans as a literal, so that it reaches the scan. A frame
    without instants gives two empty ones.
    """
    cut = df.agg((F.max("ts") - F.expr(f"INTERVAL {days} DAYS")).cast("string").alias("cut")).first()["cut"]
    at = F.lit(cut).cast(df.schema["ts"].dataType)
    return df.filter(F.col("ts") < at), df.filter(F.col("ts") >= at)


def holdout(df: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    return timewise(df, days)


def train(df: DataFrame, days: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Train history and target, validation history and target."""
    before, validation = timewise(df, days)
    history, target = timewise(before, days)
    return history, target, before, validation


def final(df: DataFrame, held: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """History and target of all rows, the holdout merged back."""
    return timewise(df.unionByName(held), days)


def profile(df: DataFrame) -> DataFrame:
    """First and last instant, rows and whole days between them."""
    return df.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("days"))
