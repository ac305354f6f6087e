"""Trend signals and exposures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.lineage import settled
from panelspark.functions.windows import clip, ratio_change, rolling, series
from panelspark.operators.rolling import breakout, ewm, momentum

MOMENTUM = (21, 63, 126, 252)
CROSSOVERS = ((8, 24), (16, 48), (32, 96))
BREAKOUT = (63, 126)
#: Rows of the crossover's scale, and how many must be present.
SCALE_ROWS, SCALE_LEAST = 252, 63


def crossover(panel: DataFrame, pairs=CROSSOVERS, name: str = "ewma") -> DataFrame:
    """Mean over (fast, slow) of tanh of the averages' difference over its own trailing deviation."""
    w = series("symbol")
    spans = sorted({s for p in pairs for s in p})
    out = ewm(panel, "close", {f"_m{s}": ("mean", s) for s in spans})
    for f, s in pairs:
        out = out.withColumn(f"_x{f}_{s}", F.col(f"_m{f}") - F.col(f"_m{s}"))
    one = [F.tanh(F.try_divide(F.col(f"_x{f}_{s}"), rolling(F.stddev_samp, f"_x{f}_{s}", w, SCALE_ROWS, SCALE_LEAST))) for f, s in pairs]
    return out.withColumn(name, reduce(lambda a, b: a + b, one) / len(one)).select(*panel.columns, name)


def families(panel: DataFrame) -> DataFrame:
    """The three families' signals as columns tsmom, ewma and bo."""
    w = series("symbol")
    return crossover(panel).withColumn("tsmom", momentum("close", w, MOMENTUM)).withColumn("bo", breakout("close", w, BREAKOUT))


def forecast(chosen: tuple[str, ...]):
    """Column: the mean of the chosen families within [-1, 1], NULL until all of them are defined."""
    return clip(reduce(lambda a, b: a + b, [F.col(c) for c in chosen]) / len(chosen), -1.0, 1.0)


def overlay_grid(panel: DataFrame, grid: list[tuple[int, int, float]], rows: int = 63, most: float = 1.0, span: int = 20) -> DataFrame:
    """symbol, date, close and exposures, an array with one of every (fast, slow, target deviation): all averages are worked
    out in one pass over the panel, and no row is copied for a configuration."""
    w = series("symbol")
    spans = sorted({s for f, s, _ in grid} | {f for f, _, _ in grid})
    out = ewm(panel.select("symbol", "date", "close"), "close", {f"_r{s}": ("rec", s) for s in spans}).withColumn("_sd", rolling(F.stddev_samp, "close", w, rows))
    out = ewm(settled(out.withColumn("_ret", ratio_change("close", w)), "overlay"), "_ret", {"_vol": ("sd", span)})
    one = []
    for f, s, target in grid:
        signal = F.tanh(F.try_divide(F.col(f"_r{f}") - F.col(f"_r{s}"), F.col("_sd")))
        expo = F.coalesce(F.when(signal.isNotNull(), F.greatest(signal, F.lit(0.0))) * F.try_divide(F.lit(target), F.col("_vol")), F.lit(0.0))
        one.append(clip(expo, 0.0, most))
    return out.select("symbol", "date", "close", F.array(*one).alias("exposures"))


def overlay_names(grid: list[tuple[int, int, float]]) -> list[str]:
    return [f"{f:03d}/{s:03d}/{target}" for f, s, target in grid]
