"""Quality of series: a report a symbol, gaps against the calendar, runs of missing days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.windows import series, trailing

STALE_RUN = 5
EXTREME = 0.5
MAX_GAP_PCT = 10


def business_days(start, end):
    """Weekdays from start to end as an array column."""
    return F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5)


def qc_report(bars: DataFrame, order: str = "date") -> DataFrame:
    """A row a symbol: rows, range, duplicates, missing, non-positive and negative prices, missing business days, stale
    runs, extreme moves, the issues in words and a status (FAIL, WARN or OK). No symbol that has rows is left out."""
    w = series("symbol", order=order)
    change = F.col("close") - F.lag("close").over(w)
    ret = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    flat = F.when(change == 0, 1).otherwise(0)
    rows = bars.withColumn("_date", F.to_date(order)).withColumn("_ret", ret).withColumn("_flat", flat)
    rows = rows.withColumn("_run", F.sum("_flat").over(trailing(w, STALE_RUN)))
    low = F.least("close", *[c for c in ("open", "high", "low") if c in bars.columns]) if {"high", "low"} & set(bars.columns) else F.col("close")
    agg = rows.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min(order).alias("first"), F.max(order).alias("last"),
        (F.count(order) - F.countDistinct(order)).alias("dup"), F.count_if(F.col("close").isNull() | F.isnan("close")).alias("missing"),
        F.count_if(F.col("close") <= 0).alias("nonpos"), F.coalesce(F.min(low) < 0, F.lit(False)).alias("negative"),
        F.max("_run").alias("stale"), F.count_if(F.abs("_ret") > EXTREME).alias("extreme"), F.countDistinct(F.when(F.weekday("_date") < 5, F.col("_date"))).alias("_present"),
        F.min("_date").alias("_from"), F.max("_date").alias("_to"),
    )
    agg = agg.withColumn("_days", F.size(business_days(F.col("_from"), F.col("_to")))).withColumn("missing_days", (F.col("_days") - F.col("_present")).cast("long"))
    gaps = 100 * F.col("missing_days") > MAX_GAP_PCT * F.greatest("_days", F.lit(1))
    said = lambda condition, *parts: F.when(condition, F.concat(*parts))
    issues = F.array_compact(F.array(
        said(F.col("dup") > 0, F.col("dup").cast("string"), F.lit(" duplicate timestamps")), said(F.col("missing") > 0, F.col("missing").cast("string"), F.lit(" missing closes")),
        said(F.col("nonpos") > 0, F.col("nonpos").cast("string"), F.lit(" non-positive closes")), said(F.col("negative"), F.lit("negative prices")),
        said(gaps, F.col("missing_days").cast("string"), F.lit(" missing business days")), said(F.col("stale") >= STALE_RUN, F.lit("stale run")),
        said(F.col("extreme") > 0, F.col("extreme").cast("string"), F.lit(" extreme moves")),
    ))
    bad = (F.col("dup") > 0) | (F.col("missing") > 0) | (F.col("nonpos") > 0) | F.col("negative")
    out = agg.withColumn("issues", issues).withColumn("status", F.when(bad, "FAIL").when(F.size("issues") > 0, "WARN").otherwise("OK"))
    return out.select("symbol", "n_rows", "first", "last", "dup", "missing", "nonpos", "negative", "missing_days", "stale", "extreme", F.concat_ws("; ", "issues").alias("issues"), "status")


def quick_report(bars: DataFrame, order: str = "date") -> DataFrame:
    """The smaller report, a row a symbol: rows, range, duplicates, non-positive and missing closes, zero returns and the
    largest absolute return."""
    w = series("symbol", order=order)
    rows = bars.withColumn("_ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    return rows.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.min(order).alias("first"), F.max(order).alias("last"), (F.count(order) - F.countDistinct(order)).alias("dup"),
        F.count_if(F.col("close") <= 0).alias("nonpos"), F.count_if(F.col("close").isNull() | F.isnan("close")).alias("missing"),
        F.count_if(F.col("_ret") == 0).alias("zero_returns"), F.max(F.abs("_ret")).alias("largest_move"),
    )


def file_runs(start: str, end: str, files: DataFrame) -> DataFrame:
    """first, last and days of each run of weekdays without a file between two dates. files: date."""
    have = files.select(F.lit("").alias("symbol"), "date").distinct()
    edges = files.sparkSession.createDataFrame([("", start), ("", end)], "symbol string, date string").withColumn("date", F.to_date("date"))
    days = have.unionByName(edges)  # the range's edges bound the calendar, but a run at an edge counts them too
    span = days.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    calendar = span.select(F.explode(business_days(F.col("a"), F.col("b"))).alias("date")).filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    marked = calendar.join(have.select("date", F.lit(1).alias("here")), "date", "left")
    # the calendar has a row a weekday: its size depends on the range, not on the data
    island = marked.withColumn("island", F.sum(F.coalesce("here", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return island.filter("here is null").groupBy("island").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days")).drop("island")


def halting(bars: DataFrame, start: str, end: str, files: DataFrame, longest: int = 4) -> DataFrame:
    """bars, or an error where a run of more than `longest` weekdays has no file: a late publication or a broken source,
    not holidays."""
    worst = file_runs(start, end, files).filter(F.col("days") > longest).agg(F.min(F.struct("first", "days")).alias("_run"))
    said = F.concat(F.col("_run.days").cast("string"), F.lit(" weekdays without a file from "), F.col("_run.first").cast("string"))
    checked = bars.crossJoin(F.broadcast(worst)).withColumn("_run", F.when(F.col("_run").isNotNull(), F.raise_error(said)).cast("string"))
    return checked.filter("_run is null").drop("_run")


def passing(bars: DataFrame, report: DataFrame) -> DataFrame:
    """The bars of symbols whose status is not FAIL."""
    return bars.join(report.filter("status <> 'FAIL'").select("symbol"), "symbol", "left_semi")


def calendar_gaps(bars: DataFrame) -> DataFrame:
    """symbol and weekday without a bar, between the symbol's first and last date."""
    span = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("symbol", F.explode(business_days(F.col("a"), F.col("b"))).alias("date"))
    return days.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti")


def skipped_days(start: str, end: str, files: DataFrame, listed: DataFrame) -> DataFrame:
    """date and reason of weekdays without a file (weekday-404), or with one that lacks the symbol (not-listed).
    files: date; listed: date, symbol."""
    spark = files.sparkSession
    days = spark.range(1).select(F.explode(business_days(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    missing = days.join(files.select("date"), "date", "left_anti").withColumn("reason", F.lit("weekday-404")).withColumn("symbol", F.lit(None).cast("string"))
    expected = days.join(files.select("date").distinct(), "date", "left_semi").crossJoin(listed.select("symbol").distinct())
    absent = expected.join(listed.select("date", "symbol"), ["date", "symbol"], "left_anti").withColumn("reason", F.lit("not-listed"))
    return missing.unionByName(absent).select("symbol", "date", "reason")


def missing_runs(bars: DataFrame, longest: int = 4) -> DataFrame:
    """Runs of consecutive missing weekdays of each symbol longer than `longest`: symbol, first, last, days. Islands are
    numbered by how many present weekdays precede them."""
    span = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("symbol", F.explode(business_days(F.col("a"), F.col("b"))).alias("date"))
    marked = days.join(bars.select("symbol", "date", F.lit(1).alias("here")), ["symbol", "date"], "left")
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    island = marked.withColumn("island", F.sum(F.coalesce("here", F.lit(0))).over(w)).filter("here is null")
    return island.groupBy("symbol", "island").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days")).filter(F.col("days") > longest).select("symbol", "first", "last", "days")


def valid_prices(prices: DataFrame, column: str = "close") -> DataFrame:
    """symbol and whether all its prices are present, finite and positive."""
    ok = F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) > 0) & (F.col(column) < float("inf"))
    return prices.groupBy("symbol").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("valid"))
