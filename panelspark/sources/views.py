"""Market-shaped views of the test tables: daily bars from lineitem, intraday ticks from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SYMBOL = ("l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str, symbol=SYMBOL) -> DataFrame:
    """symbol, date, close, high, low, volume; the close is a decimal sum over a count, so it does not depend on order."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat(*symbol).alias("symbol"), F.to_date("l_shipdate").alias("date"))
        .agg(
            (F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double") / F.count("*")).alias("close"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            F.sum(F.col("l_quantity").cast("long")).alias("volume"),
        )
    )


def walked(bars: DataFrame) -> DataFrame:
    """Bars whose closes walk, for signals and portfolios: 5000 and a thousandth of the sum so far of the rounded closes less
    their whole mean, all whole numbers until the last step; high and low keep their distance, on the same scale."""
    close = F.round("close").cast("long")
    means = bars.groupBy("symbol").agg(F.floor(F.sum(close) / F.count("*")).cast("long").alias("_mean"))
    so_far = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.join(means, "symbol").withColumn("_walk", 5000 + F.sum(close - F.col("_mean")).over(so_far) / 1000)
    away = lambda c: (F.col("_walk") + (F.col(c) - F.col("close")) / 1000).alias(c)
    return rows.select("symbol", "date", F.col("_walk").alias("close"), away("high"), away("low"), "volume")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, event_id, price."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))
