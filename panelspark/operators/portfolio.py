"""Exposures to portfolio returns: inverse-volatility and risk-parity sizing, volatility targeting, friction."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.lineage import settled
from panelspark.functions.windows import clip, ratio_change, rolling, series, so_far
from panelspark.operators.rolling import ewm, turnover
from panelspark.operators.signals import families, forecast

MAX_SCALE = 50.0
REBALANCE_ROWS, COVARIANCE_ROWS = 21, 252


def inverse_vol_exposure(panel: DataFrame, signal: str = "signal", span: int = 30) -> DataFrame:
    """expo: yesterday's signal over yesterday's exponentially weighted deviation; 0 where either is missing."""
    w = series("symbol")
    out = panel if "ret" in panel.columns else panel.withColumn("ret", ratio_change("close", w))
    out = ewm(out, "ret", {"_vol": ("sd", span)})
    return out.withColumn("expo", F.coalesce(F.try_divide(F.lag(signal).over(w), F.lag("_vol").over(w)), F.lit(0.0))).drop("_vol")


def scales(exposed: DataFrame, keys: tuple[str, ...] = ("config_id",), rows: int = 30) -> DataFrame:
    """Per config and date: inv_sd, one over yesterday's trailing deviation of the unscaled return (NULL: none)."""
    raw = exposed.groupBy(*keys, "date").agg(F.coalesce(F.sum(F.col("expo") * F.col("ret")), F.lit(0.0)).alias("raw"))
    w = series(*keys)
    return raw.withColumn("_sd", rolling(F.stddev_samp, "raw", w, rows)).withColumn("inv_sd", F.try_divide(F.lit(1.0), F.lag("_sd").over(w))).select(*keys, "date", "inv_sd")


def targeted(exposed: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("config_id",), rows: int = 30, cap: float = 1.0) -> DataFrame:
    """pos: exposure scaled to each target deviation, within +-cap. targets: target_id, target; crossed in late, after
    all that does not depend on the target."""
    scale = scales(exposed, keys, rows).crossJoin(F.broadcast(targets)).withColumn("scale", F.coalesce(F.least(F.col("target") * F.col("inv_sd"), F.lit(MAX_SCALE)), F.lit(0.0)))
    return exposed.join(scale.select(*keys, "date", "target_id", "scale"), [*keys, "date"]).withColumn("pos", clip(F.col("expo") * F.col("scale"), -cap, cap))


def portfolio_returns(positions: DataFrame, keys: tuple[str, ...], cost: str | None = None) -> DataFrame:
    """ret per config and date: the positions' returns, less turnover times cost if a cost column is named. A date on
    which nothing is known is a return of 0."""
    gain = F.coalesce(F.sum(F.col("pos") * F.col("ret")), F.lit(0.0))
    if cost:
        positions = positions.withColumn("_fric", F.coalesce(turnover("pos", series(*keys, "symbol")) * F.col(cost), F.lit(0.0)))
        gain = gain - F.sum("_fric")
    return positions.groupBy(*keys, "date").agg(gain.alias("ret"))


def _both_orders(half: DataFrame) -> DataFrame:
    """Each row of i <= j goes out as itself and, off the diagonal, once more with its names exchanged."""
    kept, other = (F.struct(F.col(p).alias("i"), F.col(q).alias("j"), "t", "s", "s22", F.col(u).alias("s31"), F.col(v).alias("s13")) for p, q, u, v in (("i", "j", "s31", "s13"), ("j", "i", "s13", "s31")))
    return half.select("window_id", F.explode(F.when(F.col("i") < F.col("j"), F.array(kept, other)).otherwise(F.array(kept))).alias("m")).select("window_id", "m.*")


def moments(windows: DataFrame) -> DataFrame:
    """Per window and pair of symbols (i, j), in either order: population moments of demeaned returns, as the shrinkage needs
    them. Products are formed for i <= j only; the other order is the same sums under exchanged names. windows: window_id,
    date, symbol, ret."""
    x = windows.withColumn("x", F.col("ret") - F.avg("ret").over(Window.partitionBy("window_id", "symbol")))
    a = x.select("window_id", "date", F.col("symbol").alias("i"), F.col("x").alias("xi"))
    b = x.select("window_id", "date", F.col("symbol").alias("j"), F.col("x").alias("xj"))
    xi, xj = F.col("xi"), F.col("xj")
    half = a.join(b, ["window_id", "date"]).filter("i <= j").groupBy("window_id", "i", "j").agg(F.count("*").alias("t"), F.avg(xi * xj).alias("s"), F.avg(xi * xi * xj * xj).alias("s22"), F.avg(xi * xi * xi * xj).alias("s31"), F.avg(xi * xj * xj * xj).alias("s13"))
    return _both_orders(half)


def shrunk_covariance(windows: DataFrame) -> DataFrame:
    """Constant-correlation shrinkage: window_id, i, j, cov (shrunk) and delta (the intensity). Mean products such as
    E[(xi^2 - Sii)(xi xj - Sij)] are E[xi^3 xj] - Sii Sij, so one pass of moments gives everything."""
    return _shrunk(settled(moments(windows), "moments"))


def _shrunk(m: DataFrame) -> DataFrame:
    var = m.filter("i = j").select("window_id", F.col("i").alias("k"), F.col("s").alias("v"))
    m = m.join(var.select("window_id", F.col("k").alias("i"), F.col("v").alias("vi")), ["window_id", "i"]).join(var.select("window_id", F.col("k").alias("j"), F.col("v").alias("vj")), ["window_id", "j"])
    si, sj, off = F.sqrt("vi"), F.sqrt("vj"), F.col("i") != F.col("j")
    m = m.withColumn("corr", F.try_divide(F.col("s"), si * sj)).withColumn("pi", F.col("s22") - F.col("s") * F.col("s"))
    m = m.withColumn("rho", F.when(off, F.try_divide(sj, si) * (F.col("s31") - F.col("vi") * F.col("s")) + F.try_divide(si, sj) * (F.col("s13") - F.col("vj") * F.col("s"))).otherwise(0.0))
    whole = m.groupBy("window_id").agg(F.avg(F.when(off, F.col("corr"))).alias("rbar"), F.sum("pi").alias("pi_sum"), F.sum(F.when(~off, F.col("pi"))).alias("pi_diag"), F.sum("rho").alias("rho_sum"), F.max("t").alias("rows"))
    m = m.join(whole, "window_id").withColumn("target", F.when(off, F.col("rbar") * si * sj).otherwise(F.col("s")))
    gap = m.groupBy("window_id").agg(F.sum((F.col("target") - F.col("s")) * (F.col("target") - F.col("s"))).alias("gamma"))
    m = m.join(gap, "window_id")
    kappa = F.coalesce(F.try_divide(F.col("pi_sum") - F.col("pi_diag") - F.col("rbar") / 2 * F.col("rho_sum"), F.col("gamma")), F.lit(0.0))
    m = m.withColumn("delta", F.greatest(F.least(kappa / F.col("rows"), F.lit(1.0)), F.lit(0.0)))
    return m.select("window_id", "i", "j", (F.col("delta") * F.col("target") + (1 - F.col("delta")) * F.col("s")).alias("cov"), "delta")


def equal_risk_weights(cov: np.ndarray, rounds: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Weights with equal shares of the risk: each in turn solves its own quadratic, the others held."""
    n = len(cov)
    x, share = np.full(n, 1 / n), 1 / n
    cx = cov @ x
    for _ in range(rounds):
        before = x.copy()
        for i in range(n):
            rest = cx[i] - cov[i, i] * x[i]
            new = (np.sqrt(rest * rest + 4 * cov[i, i] * share) - rest) / (2 * cov[i, i])
            cx += cov[:, i] * (new - x[i])
            x[i] = new
        if np.abs(x - before).max() < tol:
            break
    return x / x.sum()


def equal_risk(cov: DataFrame) -> DataFrame:
    """window_id, symbol, weight from a long covariance; equal weights where a variance is not positive."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="i", columns="j", values="cov").sort_index().sort_index(axis=1)
        good = bool((np.diag(wide) > 0).all())
        weight = equal_risk_weights(wide.to_numpy(float)) if good else np.full(len(wide), 1 / len(wide))
        return pd.DataFrame({"window_id": pdf["window_id"].iloc[0], "symbol": wide.index, "weight": weight})

    return cov.groupBy("window_id").applyInPandas(solve, "window_id long, symbol string, weight double")


def rebalance_windows(panel: DataFrame, rows: int = COVARIANCE_ROWS, every: int = REBALANCE_ROWS) -> DataFrame:
    """window_id (row number of the rebalance date), date, symbol, ret of the `rows` rows before each rebalance row:
    each row is dealt to the windows it belongs to by arithmetic on its number, not by a range join."""
    numbered = panel.withColumn("t", F.row_number().over(series("symbol")) - 1)
    last = numbered.agg(F.max("t").alias("last"))
    first_k = F.greatest(F.floor((F.col("t") - rows) / every) + 1, F.lit(0))
    last_k = F.least(F.floor(F.col("t") / every), F.floor((F.col("last") - rows) / every))
    dealt = numbered.filter("ret is not null").crossJoin(F.broadcast(last)).filter(last_k >= first_k).withColumn("_k", F.explode(F.sequence(first_k, last_k))).withColumn("window_id", F.col("_k") * every + rows)
    whole = dealt.groupBy("window_id").agg(F.countDistinct("date").alias("n")).filter(F.col("n") >= rows // 2)
    return dealt.join(whole, "window_id", "left_semi").select(F.col("window_id").cast("long").alias("window_id"), "date", "symbol", "ret")


#: The powers (a, b) whose sums over x^a y^b give the moments of demeaned x and y that the shrinkage needs.
POWERS = [(a, b) for a in range(4) for b in range(4) if a + b <= 4]
#: Symbols of a block of the Gram matrices.
BLOCK_SYMBOLS = 64


def _gram(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of powers of every two symbols of a slab's two blocks, the one that comes first in order as i."""
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    wide = pdf.pivot(index="t", columns="symbol", values="x").sort_index(axis=1)
    block = pdf.drop_duplicates("symbol").set_index("symbol")["blk"].reindex(wide.columns).to_numpy()
    x = wide.to_numpy(float)
    there = np.isfinite(x).astype(float)
    powers = [there, *(np.where(there > 0, x, 0.0) ** a for a in (1, 2, 3))]
    sums = {(a, b): powers[a].T @ powers[b] for a, b in POWERS}
    i, j = np.triu_indices(len(block))
    ours = ((block[i] == low) & (block[j] == high)) | ((block[i] == high) & (block[j] == low))
    i, j = i[ours], j[ours]
    names = wide.columns.to_numpy()
    out = {"slab": np.full(len(i), pdf["slab"].iloc[0]), "i": names[i], "j": names[j]}
    return pd.DataFrame(out | {f"p{a}{b}": sums[a, b][i, j] for a, b in POWERS})


def rebalance_moments(panel: DataFrame, rows: int = COVARIANCE_ROWS, every: int = REBALANCE_ROWS) -> DataFrame:
    """moments() of the windows of rebalance_windows(), for a panel whose symbols have the same dates. Rows are summed once, in
    slabs of the greatest length that windows and steps are multiples of, as Gram matrices of symbol blocks (each pair of
    blocks a group: the rows shuffled grow with the number of blocks, a task's with the block); a window's moments are
    those of its slabs' sums. Returns are taken about their symbol's mean first, so that powers do not swallow the spread."""
    size = math.gcd(rows, every)
    numbered = panel.select("symbol", "ret", F.row_number().over(series("symbol")).alias("t")).withColumn("t", (F.col("t") - 1).cast("long"))
    means = panel.groupBy("symbol").agg(F.avg("ret").alias("c"), F.count("*").alias("_rows"))
    last = means.agg(F.max("_rows").alias("rows"), F.count("*").alias("symbols")).first()
    if not last["symbols"]:
        return panel.sparkSession.createDataFrame([], "window_id long, i string, j string, t long, s double, s22 double, s31 double, s13 double")
    blocks, windows = -(-last["symbols"] // BLOCK_SYMBOLS), (last["rows"] - 1 - rows) // every
    x = numbered.filter("ret is not null").join(means, "symbol").select("symbol", "t", F.floor(F.col("t") / size).alias("slab"), (F.col("ret") - F.col("c")).alias("x"), F.pmod(F.xxhash64("symbol"), F.lit(blocks)).alias("blk"))
    x = settled(x, "centred")
    dealt = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("*", F.least("blk", "_o").alias("low"), F.greatest("blk", "_o").alias("high")).drop("_o")
    sums = dealt.groupBy("slab", "low", "high").applyInPandas(_gram, "slab long, i string, j string, " + ", ".join(f"p{a}{b} double" for a, b in POWERS))
    step, length = every // size, rows // size
    first = F.greatest(F.ceil((F.col("slab") - length + 1) / step), F.lit(0))
    of = F.explode(F.when(F.least(F.floor(F.col("slab") / step), F.lit(windows)) >= first, F.sequence(first, F.least(F.floor(F.col("slab") / step), F.lit(windows))))).alias("_k")
    names = [f"p{a}{b}" for a, b in POWERS]
    pairs = sums.select("*", of).groupBy("_k", "i", "j").agg(*[F.sum(c).alias(c) for c in names])
    own = x.groupBy("slab", "symbol").agg(F.count("*").alias("n"), F.sum("x").alias("s")).select("*", of).groupBy("_k", "symbol").agg((F.sum("s") / F.sum("n")).alias("m"))
    whole = x.groupBy("slab").agg(F.countDistinct("t").alias("n")).select("*", of).groupBy("_k").agg(F.sum("n").alias("n")).filter(F.col("n") >= rows // 2)
    m = pairs.join(whole.select("_k"), "_k", "left_semi")
    for k in "ij":
        m = m.join(own.select("_k", F.col("symbol").alias(k), F.col("m").alias(f"m{k}")), ["_k", k])

    def about(a: int, b: int):
        """Mean of (x - mi)^a (y - mj)^b from the sums of powers."""
        terms = [math.comb(a, k) * math.comb(b, q) * F.pow(-F.col("mi"), F.lit(a - k)) * F.pow(-F.col("mj"), F.lit(b - q)) * F.col(f"p{k}{q}") for k in range(a + 1) for q in range(b + 1)]
        return reduce(lambda u, v: u + v, terms) / F.col("p00")

    half = m.filter("p00 > 0").select((F.col("_k") * every + rows).cast("long").alias("window_id"), "i", "j", F.col("p00").cast("long").alias("t"), about(1, 1).alias("s"), about(2, 2).alias("s22"), about(3, 1).alias("s31"), about(1, 3).alias("s13"))
    return _both_orders(half)


def rebalance_covariance(panel: DataFrame, rows: int = COVARIANCE_ROWS, every: int = REBALANCE_ROWS) -> DataFrame:
    """shrunk_covariance() of the windows before every rebalance row."""
    return _shrunk(settled(rebalance_moments(panel, rows, every), "moments"))


def risk_parity_weights(panel: DataFrame, rows: int = COVARIANCE_ROWS, every: int = REBALANCE_ROWS) -> DataFrame:
    """The panel with `weight`: the last rebalance's equal-risk weight, known a row later."""
    panel = settled(panel, "panel")
    weights = equal_risk(rebalance_covariance(panel, rows, every)).withColumnRenamed("window_id", "t")
    w = series("symbol")
    out = panel.withColumn("t", (F.row_number().over(w) - 1).cast("long")).join(weights, ["t", "symbol"], "left")
    return out.withColumn("weight", F.last("weight", ignorenulls=True).over(so_far(w))).withColumn("weight", F.lag("weight").over(w)).drop("t")


SIGNAL_SETS = {"TSMOM": ("tsmom",), "TSMOM+EWMA": ("tsmom", "ewma"), "TSMOM+EWMA+BO": ("tsmom", "ewma", "bo")}
VOL_TARGETS = {"0.30%": 0.003, "0.40%": 0.004, "0.50%": 0.005}


def trend_grid(panel: DataFrame, sizings: tuple[str, ...] = ("invvol", "lw_rp"), vol_targets=VOL_TARGETS) -> DataFrame:
    """config_id, date, ret of every vol target x sizing x signal set. Signals and sizings are worked out once, targets
    are crossed in at the scale step."""
    spark = panel.sparkSession
    w = series("symbol")
    rows = families(panel.select("symbol", "date", "close").withColumn("ret", ratio_change("close", w)))
    rows = settled(ewm(rows, "ret", {"_vol": ("sd", 30)}), "trend-features")
    if "lw_rp" in sizings:
        rows = risk_parity_weights(rows)
    parts = []
    for size in sizings:
        factor = F.col("weight") if size == "lw_rp" else F.lit(1.0)
        for name, chosen in SIGNAL_SETS.items():
            parts.append((f"{size}/{name}", F.coalesce(F.try_divide(F.lag(forecast(chosen)).over(w) * factor, F.lag("_vol").over(w)), F.lit(0.0))))
    for i, (_, expo) in enumerate(parts):
        rows = rows.withColumn(f"_e{i}", expo)
    stacked = rows.select("symbol", "date", "ret", F.explode(F.array(*[F.struct(F.lit(n).alias("config_id"), F.col(f"_e{i}").alias("expo")) for i, (n, _) in enumerate(parts)])).alias("c")).select("symbol", "date", "ret", "c.*")
    targets = spark.createDataFrame(list(vol_targets.items()), "target_id string, target double")
    out = portfolio_returns(targeted(settled(stacked, "exposures"), targets), ("config_id", "target_id"))
    return out.select(F.concat_ws("/", "target_id", "config_id").alias("config_id"), "date", "ret")
