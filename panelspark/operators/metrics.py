"""Return metrics, deflated Sharpe ratios, correlations and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.normal import expected_max_sharpe, normal_cdf
from panelspark.functions.windows import series
from panelspark.operators.rolling import drawdowns

YEAR = 252


def skew(x: Column | str) -> Column:
    """Population skewness, 0 without spread."""
    return F.when(F.var_pop(x) > 0, F.skewness(x)).otherwise(0.0)


def excess_kurtosis(x: Column | str) -> Column:
    return F.when(F.var_pop(x) > 0, F.kurtosis(x)).otherwise(-3.0)


def performance(returns: DataFrame, keys: tuple[str, ...] = ("config_id",), order: str = "date") -> DataFrame:
    """n, mean, sd, annualised Sharpe, total and annual return, largest drawdown, worst day, skew, excess kurtosis."""
    rows = drawdowns(returns, "ret", keys, order)
    out = rows.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.product(1 + F.coalesce("ret", F.lit(0.0))).alias("_grown"), F.max("dd").alias("maxdd"), F.min("ret").alias("worst_day"), skew("ret").alias("skew"), excess_kurtosis("ret").alias("kurt"))
    out = out.withColumn("sharpe", F.coalesce(F.try_divide(F.col("mean"), F.col("sd")), F.lit(0.0)) * YEAR**0.5).withColumn("total_return", F.col("_grown") - 1)
    return out.withColumn("annual_return", F.pow("_grown", F.lit(float(YEAR)) / F.col("n")) - 1).drop("_grown")


def segments(returns: DataFrame, share: float, keys: tuple[str, ...] = ("config_id",), order: str = "date") -> DataFrame:
    """returns with segment: 'train' for the first floor(n * share) rows of each key, 'test' for the rest."""
    every = Window.partitionBy(*keys)
    rn = F.row_number().over(series(*keys, order=order))
    return returns.withColumn("segment", F.when(rn <= F.floor(F.count("*").over(every) * share), "train").otherwise("test"))


def risk_limits(returns: DataFrame, capital: float = 100_000.0, day_limit: float = 0.05, keys: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """Days with a loss beyond the limit, largest drawdown and final equity of a starting capital."""
    return drawdowns(returns, "ret", keys).groupBy(*keys).agg(F.count_if(F.col("ret") < -day_limit).alias("bad_days"), F.max("dd").alias("maxdd"), (capital * F.product(1 + F.coalesce("ret", F.lit(0.0)))).alias("final_equity"))


def return_correlation(panel: DataFrame) -> DataFrame:
    """i, j, n, corr of the symbols' returns on the dates both have, i <= j."""
    a = panel.filter("ret is not null").select("date", F.col("symbol").alias("i"), F.col("ret").alias("x"))
    b = panel.filter("ret is not null").select("date", F.col("symbol").alias("j"), F.col("ret").alias("y"))
    return a.join(b, "date").filter("i <= j").groupBy("i", "j").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"))


def deflated_sharpe(returns: DataFrame, trials: int, keys: tuple[str, ...] = ("config_id",), sr_var: float | None = None) -> DataFrame:
    """sr, sr0 and dsr: the probability that a Sharpe ratio beats the best of `trials` worthless configurations."""
    m = returns.groupBy(*keys).agg(F.count("ret").alias("n"), F.try_divide(F.avg("ret"), F.stddev_pop("ret")).alias("sr"), skew("ret").alias("g3"), (excess_kurtosis("ret") + 3).alias("g4"))
    var = F.lit(sr_var) if sr_var is not None else F.try_divide(1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") * F.col("sr"), (F.col("n") - 1).cast("double"))
    m = m.withColumn("sr_sd", F.sqrt(var)).withColumn("sr0", expected_max_sharpe(F.col("sr_sd"), F.lit(trials)))
    return m.withColumn("dsr", normal_cdf(F.try_divide(F.col("sr") - F.col("sr0"), F.col("sr_sd")))).select(*keys, "n", "sr", "sr0", "dsr")


def best_config(summary: DataFrame, score: str = "sharpe", tie: str = "config_id") -> DataFrame:
    """The row with the highest score; of equal ones the first by tie."""
    return summary.orderBy(F.desc_nulls_last(score), tie).limit(1)


def fold_sharpes(returns: DataFrame, folds: int, keys: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """Annualised Sharpe of each contiguous fold with more than 5 rows and some spread."""
    rows = returns.withColumn("fold", F.ntile(folds).over(series(*keys)))
    out = rows.groupBy(*keys, "fold").agg(F.count("ret").alias("n"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * YEAR**0.5).alias("sharpe"))
    return out.filter((F.col("n") > 5) & F.col("sharpe").isNotNull())


def distribution(values: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, min, median, max, 5th percentile (linear) and share above 0."""
    x = F.col(column)
    return values.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.median(x).alias("median"), F.max(x).alias("high"), F.percentile(x, 0.05).alias("p5"), F.avg((x > 0).cast("double")).alias("positive"))


def cost_diagnostics(ledger: DataFrame, capital: float = 100_000.0, keys: tuple[str, ...] = ("symbol", "config_id")) -> DataFrame:
    """Rebalances, total cost, basis points a year, smallest cash."""
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    return ledger.groupBy(*keys).agg(F.count_if(F.col("cost") > 0).alias("rebalances"), F.sum("cost").alias("total_cost"), F.try_divide(1e4 * F.sum("cost") / capital, years).alias("bps_per_year"), F.min(F.col("equity") - F.col("pos_frac") * F.col("equity")).alias("min_cash"))
