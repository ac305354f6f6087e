"""Corporate actions: prices strictly before an ex-date are divided, volumes multiplied; several actions compound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.windows import ratio_change, series

ACTIONS = "symbol string, ex_date date, price_div double, vol_mult double"


def steps(actions: DataFrame) -> DataFrame:
    """symbol, from_date, to_date and the factors in between (to_date exclusive; NULL: open): one row a stretch, so that
    each bar meets one row only. Grows with the actions alone."""
    per = actions.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ex_date", "price_div", "vol_mult"))).alias("acts"))
    n = F.size("acts")
    later = lambda i, f: F.aggregate(F.slice("acts", i + 1, F.greatest(n - i, F.lit(0))), F.lit(1.0), lambda acc, a: acc * a[f])
    stretch = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        F.when(i > 0, F.get(F.col("acts"), i - 1)["ex_date"]).alias("from_date"), F.get(F.col("acts"), i)["ex_date"].alias("to_date"), later(i, "price_div").alias("div"), later(i, "vol_mult").alias("mult")))
    return per.select("symbol", F.explode(stretch).alias("s")).select("symbol", "s.*")


def adjusted(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with adjusted prices and volume. A pure function of the raw bars: never apply it to its own result."""
    prices = [c for c in ("open", "high", "low", "close") if c in bars.columns]
    on = (bars["symbol"] == F.col("_s.symbol")) & (F.col("_s.from_date").isNull() | (bars["date"] >= F.col("_s.from_date"))) & (F.col("_s.to_date").isNull() | (bars["date"] < F.col("_s.to_date")))
    joined = bars.join(steps(actions).alias("_s"), on, "left")
    div, mult = F.coalesce(F.col("_s.div"), F.lit(1.0)), F.coalesce(F.col("_s.mult"), F.lit(1.0))
    changed = {**{c: bars[c] / div for c in prices}, **({"volume": bars["volume"] * mult} if "volume" in bars.columns else {})}
    return joined.select(*[changed.get(c, bars[c]).alias(c) for c in bars.columns])


def residual_jumps(bars: DataFrame, actions: DataFrame, start: str, end: str, limit: float = 0.5) -> DataFrame:
    """symbol, date and return where an adjusted series within the range still moves by more than the limit."""
    inside = adjusted(bars, actions).filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return inside.withColumn("ret", ratio_change("close", series("symbol"))).filter(F.abs("ret") > limit).select("symbol", "date", "ret")
