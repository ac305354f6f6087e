"""Row windows over ordered series, with the full-window rule: a rolling value needs all its rows present."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg, x: Column | str, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    """agg(x) over the trailing rows, NULL until `least` (by default all) of them are present."""
    x = F.col(x) if isinstance(x, str) else x
    over = trailing(w, rows)
    return F.when(F.count(x).over(over) >= (least or rows), agg(x).over(over))


def ratio_change(x: Column | str, w: WindowSpec, rows: int = 1) -> Column:
    """x / x[-rows] - 1, NULL where either is missing or the base is 0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(x, F.lag(x, rows).over(w)) - 1


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def finite(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
