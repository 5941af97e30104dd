"""The log as a stream: running counts by user and hour, late rows by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import is_buy, is_view, number


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """user_id, hour, interactions, views and purchases; works on streams (ts a timestamp) and batches alike."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    s = s.withWatermark("ts", late) if s.isStreaming else s
    out = s.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("interactions"), number(is_view()).alias("views"), number(is_buy()).alias("purchases"))
    return out.select("user_id", F.col("w.start").alias("hour"), "interactions", "views", "purchases")
