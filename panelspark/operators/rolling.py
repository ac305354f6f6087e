"""Rolling statistics, exponentially weighted moments, equity curves and drawdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.positions import chunked, decayed_sums, parted
from panelspark.functions.windows import rolling, series, so_far, trailing

#: Rows of a block of the exponentially weighted sums; within one, weights stay within a double's range for spans >= 2.
EWM_BLOCK = 256


def regression_slope(y: str, x: str, w: WindowSpec, rows: int) -> Column:
    """Slope of y on x over the trailing rows, NULL until all are there."""
    over = trailing(w, rows)
    both = F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)).over(over)
    return F.when(both == rows, F.try_divide(F.covar_pop(y, x).over(over), F.var_pop(x).over(over)))


def zscore(x: str, w: WindowSpec, rows: int) -> Column:
    return F.try_divide(F.col(x) - rolling(F.avg, x, w, rows), rolling(F.stddev_samp, x, w, rows))


def spread_zscore(pairs: DataFrame, rows: int = 60, keys: tuple[str, ...] = ("pair",), order: str = "ts") -> DataFrame:
    """beta, resid and z of log price a on log price b: chained windows over one partitioning, in chunks of long keys."""

    def build(part: DataFrame, by: tuple[str, ...]) -> DataFrame:
        w = series(*by, order=order)
        out = part.withColumn("_la", F.ln("a")).withColumn("_lb", F.ln("b")).withColumn("beta", regression_slope("_la", "_lb", w, rows))
        out = out.withColumn("resid", F.col("_la") - F.col("beta") * F.col("_lb"))
        return out.withColumn("z", zscore("resid", w, rows)).drop("_la", "_lb")

    return chunked(pairs, keys, order, 2 * (rows - 1), build)


def ratio_windows(pairs: DataFrame, rows: int, by: tuple[str, ...], order: str) -> DataFrame:
    """spread, z and spread_sd of a less the rolling mean of a/b times b, as windows of whole keys."""
    w = series(*by, order=order)
    out = pairs.withColumn("_q", F.try_divide("a", "b")).withColumn("spread", F.col("a") - rolling(F.avg, "_q", w, rows) * F.col("b"))
    return out.withColumn("z", zscore("spread", w, rows)).withColumn("spread_sd", rolling(F.stddev_samp, "spread", w, rows)).drop("_q")


def ratio_zscore(pairs: DataFrame, rows: int = 60, keys: tuple[str, ...] = ("pair",), order: str = "ts") -> DataFrame:
    """ratio_windows in chunks of long keys."""
    return chunked(pairs, keys, order, 2 * (rows - 1), lambda part, by: ratio_windows(part, rows, by, order))


def average_range(w: WindowSpec, rows: int = 14) -> Column:
    return rolling(F.avg, F.col("high") - F.col("low"), w, rows)


def breakout(x: str, w: WindowSpec, lookbacks: tuple[int, ...]) -> Column:
    """Place of x in its trailing range, from -1 at the low to 1 at the high, averaged over lookbacks."""
    one = lambda k: 2 * F.try_divide(F.col(x) - rolling(F.min, x, w, k), rolling(F.max, x, w, k) - rolling(F.min, x, w, k)) - 1
    return sum((one(k) for k in lookbacks[1:]), one(lookbacks[0])) / len(lookbacks)


def momentum(x: str, w: WindowSpec, lookbacks: tuple[int, ...]) -> Column:
    """Mean sign of the trailing returns, NULL until the longest lookback is there."""
    one = lambda k: F.signum(F.try_divide(F.col(x), F.lag(x, k).over(w)) - 1)
    return sum((one(k) for k in lookbacks[1:]), one(lookbacks[0])) / len(lookbacks)


def turnover(position: str, w: WindowSpec) -> Column:
    return F.abs(F.col(position) - F.lag(position).over(w))


def ewm(df: DataFrame, column: str, out: dict[str, tuple[str, float]], keys: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """Add exponentially weighted columns of `column`; out: name -> (kind, span), kind one of

    mean  weights (1 - a)^(t - i) over the rows since the first present one, a = 2 / (span + 1)
    rec   the recursive form: the first present value, then (1 - a) times the last plus a times the new
    sd    bias-corrected standard deviation with the weights of mean, NULL at the first present value

    A missing row ages the weights and repeats the last value. The sums are functions.positions.decayed_sums: time grows
    with the rows, and no task holds a whole series.
    """
    x = F.col(column)
    rows = parted(df, keys, order)
    firsts = rows.filter(x.isNotNull()).groupBy(*keys).agg(F.min_by(column, order).alias("_first"), F.min(order).alias("_from"))
    rows = rows.join(firsts, list(keys), "left")
    present = F.when(x.isNotNull(), 1.0)
    sums: dict[str, tuple[Column, float]] = {}
    names = {}
    for name, (kind, span) in out.items():
        q, s = 1 - 2 / (span + 1), str(span).replace(".", "_")
        names[name] = s
        if kind == "rec":
            sums[f"_r{s}"] = F.when(F.col(order) == F.col("_from"), x).otherwise((1 - q) * x), q
            continue
        sums[f"_w{s}"] = present, q
        if kind == "mean":
            sums[f"_x{s}"] = x, q
        else:  # about the first value, so that squares do not swallow the spread
            away = x - F.col("_first")
            sums[f"_d{s}"], sums[f"_e{s}"], sums[f"_v{s}"] = (away, q), (away * away, q), (present, q * q)
    rows = decayed_sums(rows, keys, order, sums, EWM_BLOCK)
    values = []
    for name, (kind, _) in out.items():
        s = names[name]
        if kind == "rec":
            value = F.col(f"_r{s}")
        elif kind == "mean":
            value = F.try_divide(F.col(f"_x{s}"), F.col(f"_w{s}"))
        else:
            weight = F.col(f"_w{s}")
            about = F.try_divide(F.col(f"_d{s}"), weight)
            spread = F.greatest(F.try_divide(F.col(f"_e{s}"), weight) - about * about, F.lit(0.0))
            free = weight * weight - F.col(f"_v{s}")
            value = F.when(free > 1e-12, F.sqrt(spread * F.try_divide(weight * weight, free)))
        values.append(F.when(F.col(order) >= F.col("_from"), value).alias(name))
    return rows.select(*df.columns, *values)


def drawdowns(df: DataFrame, ret: str = "ret", keys: tuple[str, ...] = ("config_id",), order: str = "date") -> DataFrame:
    """equity, peak and dd (share of the peak) of compounded returns; a missing return is 0."""
    w = so_far(series(*keys, order=order))
    out = df.withColumn("equity", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))
    return out.withColumn("peak", F.max("equity").over(w)).withColumn("dd", (F.col("peak") - F.col("equity")) / F.col("peak"))


def additive_drawdowns(df: DataFrame, gain: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """equity and dd (in the unit of gain) of gains that add up."""
    w = so_far(series(*keys, order=order))
    return df.withColumn("equity", F.sum(gain).over(w)).withColumn("_peak", F.max("equity").over(w)).withColumn("dd", F.col("_peak") - F.col("equity")).drop("_peak")
