"""Bars from a stream of ticks: the batch resampling as a watermarked streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_resample(ticks: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """symbol, ts, close, high, low, n of each bucket, given out once its watermark has passed. ticks: symbol, ts, price."""
    bucket = F.window("ts", width)
    out = ticks.withWatermark("ts", late).groupBy("symbol", bucket.alias("bucket")).agg(F.max_by("price", "ts").alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("n"))
    return out.select("symbol", F.col("bucket.start").alias("ts"), "close", "high", "low", "n")
