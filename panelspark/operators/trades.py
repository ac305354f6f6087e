"""Trades: pair mean reversion, single-leg reversion with a trend filter, an integer-share ledger; their summaries."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.normal import erfi, expected_max_sharpe, normal_cdf
from panelspark.functions.windows import series
from panelspark.operators.metrics import excess_kurtosis, skew
from panelspark.operators.rolling import additive_drawdowns, average_range, ewm, ratio_windows, ratio_zscore, spread_zscore
from panelspark.operators.sequential import scan

PAIR_TRADE = "trade_no long, bars long, entry_z double, exit_z double, gross double, fric double, net double, stopped int"


def pair_trades(legs: DataFrame, specs: DataFrame, rows: int = 60, entry: float = 2.0, leave: float = 0.4, stop: float = 3.2, notional: float = 25_000.0, cost_mult: float = 1.0) -> DataFrame:
    """Mean-reversion trades of each pair: against the spread when |z| > entry and beta > 0, closed when |z| falls under
    `leave` or passes `stop`; half of the spread and commission is paid at each end. A bar that closes a trade opens
    none; a trade open at the end is not counted.

    legs: pair, sym_a, sym_b, ts, a, b, spread_a, spread_b (in points). specs: symbol, point, mult, comm_rt.
    """
    spec = lambda side: specs.select(F.col("symbol").alias(f"sym_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("point", "mult", "comm_rt")])
    z = spread_zscore(legs, rows).join(spec("a"), "sym_a").join(spec("b"), "sym_b")
    number = F.row_number().over(series("pair", order="ts")) - 1
    half = lambda s: (F.col(f"spread_{s}") * F.col(f"point_{s}") * F.col(f"mult_{s}") + F.col(f"comm_rt_{s}")) * 0.5
    z = z.select("pair", "ts", "a", "b", "beta", "z", number.alias("i"), "mult_a", "mult_b", half("a").alias("half_a"), half("b").alias("half_b"))

    def machine(_):
        state = {"open": None, "n": 0}

        def feed(c):
            out = []
            live = np.flatnonzero(np.isfinite(c["z"].astype(float)) & np.isfinite(c["beta"].astype(float)) & (c["i"] > rows))
            for k in live:
                size, held = abs(c["z"][k]), state["open"]
                if held is None:
                    if size > entry and c["beta"][k] > 0:
                        lots_a, lots_b = notional / (c["mult_a"][k] * c["a"][k]), c["beta"][k] * notional / (c["mult_b"][k] * c["b"][k])
                        state["open"] = (-1 if c["z"][k] > 0 else 1, c["i"][k], c["z"][k], c["a"][k], c["b"][k], lots_a, lots_b, lots_a * c["half_a"][k] + lots_b * c["half_b"][k])
                elif size < leave or size > stop:
                    side, since, z0, a0, b0, lots_a, lots_b, paid = held
                    gross = side * (lots_a * c["mult_a"][k] * (c["a"][k] - a0) - lots_b * c["mult_b"][k] * (c["b"][k] - b0))
                    fric = (paid + lots_a * c["half_a"][k] + lots_b * c["half_b"][k]) * cost_mult
                    state["n"] += 1
                    out.append((state["n"], c["i"][k] - since, z0, c["z"][k], gross, fric, gross - fric, int(size > stop)))
                    state["open"] = None
            names = ("trade_no", "bars", "entry_z", "exit_z", "gross", "fric", "net", "stopped")
            return dict(zip(names, zip(*out, strict=True), strict=True)) if out else {}

        return feed

    return scan(z, ["pair"], "ts", machine, f"pair string, {PAIR_TRADE}")


def pair_summary(trades: DataFrame, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """A row a pair: trades, mean gross, friction and net, total, win rate, ratio, median bars, stop share, net of the
    first n // 2 trades and of the rest, largest drawdown of the summed net."""
    half = F.floor(F.count("*").over(Window.partitionBy(*keys)) / 2)
    rows = additive_drawdowns(trades, "net", keys, "trade_no").withColumn("_early", F.row_number().over(series(*keys, order="trade_no")) <= half)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg("gross").alias("gross_pt"), F.avg("fric").alias("fric_pt"), F.avg("net").alias("net_pt"), F.sum("net").alias("net_total"),
        (100 * F.avg((F.col("net") > 0).cast("double"))).alias("winrate"), F.when(F.avg("fric") > 0, F.avg("gross") / F.avg("fric")).alias("ratio"), F.median("bars").alias("med_bars"),
        (100 * F.avg("stopped")).alias("stop_pct"), F.avg(F.when(F.col("_early"), F.col("net"))).alias("net_pt_h1"), F.avg(F.when(~F.col("_early"), F.col("net"))).alias("net_pt_h2"), F.max("dd").alias("maxdd"),
    )
    return out


@dataclass(frozen=True)
class SingleLeg:
    """Parameters of the single-leg strategy."""

    rows: int = 60
    entry: float = 2.0
    stop: float = 3.0
    range_mult: float = 3.5
    trend_span: int = 200
    range_rows: int = 14
    use_trend: bool = True


LEG_TRADE = "trade_no long, ts timestamp, bars long, reason string, sgn int, gross_pts double, net_pts double, r double"


def leg_features(bars: DataFrame, p: SingleLeg = SingleLeg(), keys: tuple[str, ...] = ("symbol",), windows: tuple[int, ...] = ()) -> DataFrame:
    """z (of window p.rows, and z<rows> of each of windows), trend, range and i columns: trend and range, which no window
    changes, are worked out once. bars: symbol, ts, a (traded close), b (other leg), high, low, bid_ask."""
    w = series(*keys, order="ts")
    out = ewm(bars, "a", {"trend": ("rec", p.trend_span)}, keys, "ts").withColumn("range", average_range(w, p.range_rows)).withColumn("i", F.row_number().over(w) - 1)
    names = [*out.columns]
    for k in windows or (p.rows,):
        name = f"z{k}" if windows else "z"
        out = ratio_windows(out, k, keys, "ts").select(*names, F.col("z").alias(name))
        names.append(name)
    return out


def warmup(p: SingleLeg) -> int:
    """Rows that are only watched: the longer of the window and the trend's span."""
    return max(p.rows, p.trend_span)


def leg_trades(features: DataFrame, configs: DataFrame, use_trend: bool = True) -> DataFrame:
    """Long below -entry while above the trend, short above entry while below it; the stop lies range_mult ranges away
    and is hit within a bar at its price; else out when |z| reaches `stop`, or z crosses 0. One bid-ask a trade; r is
    the net over the stop's distance.

    configs: config_id, entry, stop, range_mult, warmup (rows that are only watched), and rows (the window whose z<rows> is
    used) where features holds several. The list of configurations goes to the driver and with the tasks; each symbol's
    rows are shuffled once and run through all of them.
    """
    grid = [r.asDict() for r in configs.collect()]

    def one(config):
        state = {"open": None, "n": 0}
        zed = f"z{config['rows']}" if "rows" in config else "z"

        def feed(c):
            z, width = c[zed].astype(float), c["range"].astype(float)
            use = np.flatnonzero(np.isfinite(z) & np.isfinite(width) & (width > 0) & (c["i"] > config["warmup"]))
            z, width, price, trend, low, high, i = z[use], width[use], *(c[n][use].astype(float) for n in ("a", "trend", "low", "high")), c["i"][use]
            up, down = (price > trend, price < trend) if use_trend else (True, True)
            side_of = np.where((z < -config["entry"]) & up, 1, np.where((z > config["entry"]) & down, -1, 0))
            opens, k, out = np.flatnonzero(side_of), 0, []
            while k < len(z):
                if state["open"] is None:
                    at = np.searchsorted(opens, k)
                    if at == len(opens):
                        break
                    k = int(opens[at])
                    side, far = int(side_of[k]), width[k] * config["range_mult"]
                    state["open"] = (side, i[k], price[k], far, price[k] - side * far)
                    k += 1
                    continue
                side, since, paid, far, level = state["open"]
                step = 32
                while k < len(z):  # the first row that closes: looked for in stretches that double
                    part = slice(k, k + step)
                    stopped = (low[part] <= level) if side == 1 else (high[part] >= level)
                    hit = stopped | (np.abs(z[part]) >= config["stop"]) | (side * z[part] >= 0)
                    if hit.any():
                        first = int(np.argmax(hit))
                        k += first
                        leave, reason = (level, "SL") if stopped[first] else (price[k], "ALGO" if abs(z[k]) >= config["stop"] else "TGT")
                        gross = side * (leave - paid)
                        net = gross - c["bid_ask"][use[k]]
                        state["n"] += 1
                        out.append((config["config_id"], state["n"], c["ts"][use[k]], i[k] - since, reason, side, gross, net, net / far))
                        state["open"] = None
                        k += 1
                        break
                    k, step = k + step, 2 * step
            return out

        return feed

    def machine(_):
        feeds = [one(config) for config in grid]

        def feed(c):
            out = [row for f in feeds for row in f(c)]
            names = ("config_id", "trade_no", "ts", "bars", "reason", "sgn", "gross_pts", "net_pts", "r")
            return dict(zip(names, zip(*out, strict=True), strict=True)) if out else {}

        return feed

    return scan(features, ["symbol"], "ts", machine, f"symbol string, config_id string, {LEG_TRADE}")


def risk_summary(trades: DataFrame, risk: float = 0.015, keys: tuple[str, ...] = ("symbol", "config_id")) -> DataFrame:
    """Statistics of trades in risk units, a row a key."""
    rows = additive_drawdowns(trades, "r", keys, "trade_no")
    days = F.greatest(F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86_400), F.lit(1))
    share = lambda x: 100 * F.avg(x.cast("double"))
    per_trade = F.coalesce(F.try_divide(F.avg("r"), F.stddev_pop("r")), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("trades"), share(F.col("r") > 0).alias("win"), F.avg("r").alias("avg_r"), F.median("r").alias("med_r"), F.sum("r").alias("sum_r"), (F.sum("r") * risk * 100).alias("ret_pct"),
        (F.greatest(F.max("dd"), F.lit(0.0)) * risk * 100).alias("maxdd_pct"), skew("r").alias("skew"), excess_kurtosis("r").alias("kurt"), per_trade.alias("sr_trade"), (per_trade * F.sqrt(F.count("*") / (days / 365.0))).alias("sr_ann"),
        (F.count("*") / days).alias("tpd"), *[share(F.col("reason") == x).alias(f"{x.lower()}_pct") for x in ("SL", "TGT", "ALGO")], share(F.col("sgn") == 1).alias("long_pct"),
    )


def by_side(trades: DataFrame, keys: tuple[str, ...] = ("symbol", "config_id")) -> DataFrame:
    return trades.groupBy(*keys, "sgn").agg(F.count("*").alias("n"), (100 * F.avg((F.col("r") > 0).cast("double"))).alias("win"), F.avg("r").alias("avg_r"), F.sum("r").alias("sum_r"))


def sweep_ranking(summary: DataFrame, trials: int, least_trades: int = 30, top: int = 8) -> DataFrame:
    """Of each symbol, the configurations with enough trades and the largest total by rank; the best one has sr0 and dsr,
    its deflated Sharpe a trade, with trials the number of configurations tried, too few trades or not."""
    first = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("sum_r"), "config_id"))
    best = summary.filter(F.col("trades") >= least_trades).withColumn("rank", first).filter(F.col("rank") <= top)
    sr = F.col("sr_trade")
    sd = F.sqrt(F.try_divide(1 - F.col("skew") * sr + (F.col("kurt") + 2) / 4 * sr * sr, (F.col("trades") - 1).cast("double")))
    sr0 = F.when(F.col("rank") == 1, expected_max_sharpe(sd, F.lit(trials)))
    return best.withColumn("_sd", sd).withColumn("sr0", sr0).withColumn("dsr", normal_cdf(F.try_divide(sr - F.col("sr0"), F.col("_sd")))).drop("_sd")


#: Transaction-cost rates of an exchange-traded fund, delivery (fixed values).
COSTS = {"brokerage": 0.0, "exchange": 0.0000307, "regulator": 0.000001, "tax_buy": 0.0, "tax_sell": 0.00001, "stamp_buy": 0.00015, "gst": 0.18, "depository_sell": 13.0}


def trade_cost(value, sells, rates: dict = COSTS):
    """Cost of a trade of a value: numbers, or columns with sells a boolean column."""
    common = (rates["brokerage"] + value * (rates["exchange"] + rates["regulator"])) * (1 + rates["gst"])
    buy, sell = value * (rates["tax_buy"] + rates["stamp_buy"]), value * rates["tax_sell"] + rates["depository_sell"] * (1 + rates["gst"])
    return common + (F.when(sells, sell).otherwise(buy) if isinstance(sells, Column) else sell if sells else buy)


def affordable(cash: float, price: float, rates: dict = COSTS) -> int:
    """Most shares that cash buys, cost included: solved, then put right by one either way."""
    per_share = trade_cost(price, False, {**rates, "brokerage": 0.0}) + price
    n = max(0, math.floor((cash - rates["brokerage"] * (1 + rates["gst"])) / per_share))
    fits = lambda k: cash - k * price - trade_cost(k * price, False, rates) >= 0
    while n > 0 and not fits(n):
        n -= 1
    while fits(n + 1):
        n += 1
    return n


LEDGER = "date date, equity double, cost double, pos_frac double, strat_ret double"


def share_ledger(exposures: DataFrame, capital: float = 100_000.0, max_cost_ratio: float = 0.0, deadband: float = 0.0, rates: dict = COSTS, configs: list[str] | None = None) -> DataFrame:
    """Whole-share positions that follow an exposure, after costs: equity, cost, pos_frac and strat_ret a row. Buys
    shrink until cash stays non-negative; a trade is left out if it costs too much or the exposure moved too little.

    exposures: symbol, date, close (positive and finite, else an error) and, with configs, an array exposures with one of
    each of them, so that a symbol's rows are shuffled once for all; else config_id and exposure.
    """

    def one(key):
        s = {"shares": 0, "cash": float(capital), "at": 0.0, "equity": None}

        def feed(c, want):
            price, want = c["close"].astype(float), np.nan_to_num(want.astype(float))
            if not (np.isfinite(price).all() and (price > 0).all()):
                raise ValueError(f"prices of {key} must be finite and positive")
            out = {n: np.zeros(len(price)) for n in ("equity", "cost", "pos_frac", "strat_ret")}
            for k, (p, w) in enumerate(zip(price.tolist(), want.tolist(), strict=True)):
                move = math.floor(w * (s["cash"] + s["shares"] * p) / p) - s["shares"]
                if move > 0:
                    move = min(move, affordable(s["cash"], p, rates))
                if move:
                    value = abs(move) * p
                    cost = trade_cost(value, move < 0, rates)
                    if not ((max_cost_ratio > 0 and cost > max_cost_ratio * value) or (deadband > 0 and abs(w - s["at"]) < deadband)):
                        s["cash"] -= move * p + cost
                        s["shares"] += move
                        s["at"] = w
                        out["cost"][k] = cost
                held = s["shares"] * p
                equity = s["cash"] + held
                out["equity"][k], out["pos_frac"][k] = equity, held / equity
                out["strat_ret"][k] = 0.0 if s["equity"] is None else equity / s["equity"] - 1
                s["equity"] = equity
            return {"date": c["date"], **out}

        return feed

    def machine(key):
        if configs is None:
            single = one(key)
            return lambda c: single(c, c["exposure"])
        feeds = [(name, one(key)) for name in configs]

        def feed(c):
            wanted = np.stack(c["exposures"])
            parts = [{"config_id": np.repeat(name, len(c["close"])), **f(c, wanted[:, k])} for k, (name, f) in enumerate(feeds)]
            return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}

        return feed

    keys = ["symbol", "config_id"] if configs is None else ["symbol"]
    return scan(exposures, keys, "date", machine, f"symbol string, config_id string, {LEDGER}")


def friction_calibration(legs: DataFrame, rows: int = 60) -> DataFrame:
    """A row a pair: median deviation of its spread, mean bid-ask, and the cost in deviations. legs: pair, ts, a, b, bid_ask."""
    z = ratio_zscore(legs, rows)
    return z.groupBy("pair").agg(F.median("spread_sd").alias("sigma"), F.avg("bid_ask").alias("bid_ask")).withColumn("cost", F.try_divide("bid_ask", "sigma"))


def entry_thresholds(costs: DataFrame, multiples: tuple[float, ...] = (0.0, 1.0, 2.0, 5.0), low: float = -4.0, high: float = -0.05, points: int = 400) -> DataFrame:
    """pair, multiple, cost and the entry (in deviations) with the best mean gain a time unit of a mean-reverting spread,
    from entry a to exit -a: found on a grid and then on a finer one around its best point."""
    cases = costs.select("pair", F.explode(F.array(*map(F.lit, multiples))).alias("multiple"), "cost").withColumn("cost", F.col("cost") * F.col("multiple"))

    def best(start: Column, end: Column, frame: DataFrame) -> DataFrame:
        grid = frame.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("a", start + (end - start) * F.col("_k") / (points - 1))
        grid = grid.withColumn("_den", 2 * erfi(-F.col("a") / F.lit(2.0) ** 0.5))
        value = F.when(F.col("_den") > 0, -(-2 * F.col("a") - F.col("cost")) / F.col("_den")).otherwise(1e9)
        return grid.withColumn("value", value).groupBy("pair", "multiple", "cost").agg(F.min_by("a", F.struct("value", "_k")).alias("a"), F.min("value").alias("value"))

    step = (high - low) / points
    coarse = best(F.lit(low), F.lit(high), cases).withColumnsRenamed({"a": "a0", "value": "v0"})
    fine = best(F.col("a0") - step, F.col("a0") + step, coarse).join(coarse, ["pair", "multiple", "cost"])
    return fine.select("pair", "multiple", "cost", (-F.when(F.col("value") < F.col("v0"), F.col("a")).otherwise(F.col("a0"))).alias("entry"))
