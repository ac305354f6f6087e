"""Bars to aligned panels: resampling, alignment, forward fill, returns. Panels are long: symbol, date, close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import ratio_change, series, so_far


def resample(ticks: DataFrame, width: str, price: str = "price", tie: str | None = None) -> DataFrame:
    """Coarser bars, left-closed and left-labelled: close last, high max, low min; empty buckets do not appear."""
    last = F.struct("ts", tie) if tie else F.col("ts")
    return ticks.groupBy("symbol", F.window("ts", width).alias("bucket")).agg(F.max_by(price, last).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.count("*").alias("n")).select("symbol", F.col("bucket.start").alias("ts"), "close", "high", "low", "n")


def resample_bars(bars: DataFrame, width: str) -> DataFrame:
    """The same for bars: the mean spread is kept too."""
    return bars.groupBy("symbol", F.window("ts", width).alias("bucket")).agg(F.max_by("close", "ts").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.avg("spread").alias("spread")).select("symbol", F.col("bucket.start").alias("ts"), "close", "high", "low", "spread")


def daily(bars: DataFrame, relative_spread: Column | None = None) -> DataFrame:
    """Last close of each day and, if given, the mean relative spread."""
    extra = [F.avg(relative_spread).alias("rel_spread")] if relative_spread is not None else []
    return bars.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("close", "ts").alias("close"), *extra)


def last_per_date(rows: DataFrame, order: str = "ts", date: str = "date") -> DataFrame:
    """The last row of each symbol and date."""
    w = Window.partitionBy("symbol", date).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def all_pairs(bars: DataFrame, pairs: DataFrame | None = None, on: str = "ts") -> DataFrame:
    """Closes of every two symbols (sym_a before sym_b), or of the given pairs (sym_a, sym_b), on the times both have. Rows
    meet at their time, so each is shuffled once; of given pairs only the symbols that occur in them take part."""
    rows = bars.filter("close is not null").select("symbol", on, "close")
    left, right = (rows.select(F.col("symbol").alias(f"sym_{x}"), on, F.col("close").alias(x)) for x in "ab")
    if pairs is None:
        met = left.join(right, on).filter("sym_a < sym_b")
    else:
        left, right = (df.join(pairs.select(f"sym_{x}").distinct(), f"sym_{x}", "left_semi") for df, x in ((left, "a"), (right, "b")))
        met = left.join(right, on).join(pairs.select("sym_a", "sym_b").distinct(), ["sym_a", "sym_b"], "left_semi")
    return met.select(F.concat_ws("/", "sym_a", "sym_b").alias("pair"), "sym_a", "sym_b", on, "a", "b")


def common_history(panel: DataFrame) -> DataFrame:
    """The rows on dates where every symbol of the panel has a close: a count per date, no wide join."""
    symbols = panel.agg(F.countDistinct("symbol").alias("n_symbols"))
    full = panel.filter("close is not null").groupBy("date").agg(F.countDistinct("symbol").alias("n")).join(F.broadcast(symbols), F.col("n") == F.col("n_symbols"), "left_semi")
    return panel.join(full.select("date"), "date", "left_semi")


def union_panel(panel: DataFrame) -> DataFrame:
    """Every date of any symbol for every symbol; missing closes are NULL."""
    spine = panel.select("date").distinct().crossJoin(panel.select("symbol").distinct())
    return spine.join(panel.select("date", "symbol", "close"), ["date", "symbol"], "left").select("symbol", "date", "close")


def forward_filled(panel: DataFrame) -> DataFrame:
    """The union of dates with each symbol's last known close, from the first date on which all have one."""
    filled = union_panel(panel).withColumn("close", F.last("close", ignorenulls=True).over(so_far(series("symbol"))))
    return common_history(filled)


def with_costs(panel: DataFrame, costs: DataFrame) -> DataFrame:
    """A cost column aligned to the panel's dates and carried forward within them. costs: symbol, date, cost."""
    return panel.join(costs, ["symbol", "date"], "left").withColumn("cost", F.last("cost", ignorenulls=True).over(so_far(series("symbol"))))


def relative_spread(bars: DataFrame, specs: DataFrame) -> DataFrame:
    """Bars with rel_spread, the quoted spread in points times the point's size over the close. specs: symbol, point."""
    return bars.join(specs.select("symbol", "point"), "symbol", "left").withColumn("rel_spread", F.try_divide(F.col("spread") * F.col("point"), F.col("close"))).drop("point")


def with_returns(panel: DataFrame) -> DataFrame:
    """Simple returns between a symbol's consecutive rows, without filling."""
    return panel.withColumn("ret", ratio_change("close", series("symbol")))
