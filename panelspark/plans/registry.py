"""Registered queries over the market-shaped views, each with its DuckDB equivalent where SQL can express it.

Dates and times are returned as text and doubles rounded to six places, so that both engines' results compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.lineage import scratch, settled
from panelspark.functions.positions import numbered
from panelspark.functions.windows import rolling, series
from panelspark.operators import adjust, build, ledger, metrics, panel, portfolio, qc, rolling as roll, signals, trades, validation
from panelspark.plans import sql
from panelspark.sources import bars
from panelspark.sources.views import daily_bars, ticks, walked

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Dates and times as text, doubles to six places, whole numbers as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("double", "float"):
            c = F.round(c, 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


r6 = sql.r6


def e6(c: str):
    """Returns in millionths, so that six places say something of them."""
    return (1e6 * F.col(c)).alias(f"{c}_e6")


BARS = """bars AS (SELECT concat(l_returnflag, l_linestatus) AS symbol, CAST(l_shipdate AS date) AS date,
    CAST(sum(CAST(l_extendedprice AS decimal(15,2))) AS double) / count(*) AS close, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    CAST(sum(CAST(l_quantity AS bigint)) AS bigint) AS volume FROM lineitem GROUP BY 1, 2)"""
PANEL = BARS + """, cb AS (SELECT *, CAST(round(close) AS bigint) AS c FROM bars), wkm AS (SELECT symbol, CAST(floor(CAST(sum(c) AS double) / count(*)) AS bigint) AS m FROM cb GROUP BY 1),
wk0 AS (SELECT cb.*, 5000 + CAST(sum(c - m) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS double) / 1000 AS walk FROM cb JOIN wkm USING (symbol)),
px AS (SELECT symbol, date, walk AS close, walk + (high - close) / 1000 AS high, walk + (low - close) / 1000 AS low FROM wk0),
cm AS (SELECT * FROM px WHERE date IN (SELECT date FROM px GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM px))),
r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM cm)"""
TICKS = """hour AS (SELECT event_type AS symbol, time_bucket(INTERVAL 60 MINUTES, ts) AS ts, arg_max(value, {'a': ts, 'b': event_id}) AS close,
    max(value) AS high, min(value) AS low, count(*) AS n FROM events GROUP BY 1, 2)"""
LEGS = """leg AS MATERIALIZED (SELECT concat(a.symbol, '/', b.symbol) AS symbol, a.ts, a.close AS a, b.close AS b, a.high, a.low, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ts) - 1 AS i
    FROM hour a JOIN hour b ON a.ts = b.ts AND a.symbol < b.symbol)"""


def base(spark, sf_dir) -> DataFrame:
    """The walking panel on its common dates, with returns: symbol, date, close, high, low, volume, ret. Bars are written
    once, as alignment and signals read them several times over."""
    return panel.with_returns(panel.common_history(settled(walked(daily_bars(spark, sf_dir)), "walked")))


def _span(rows) -> tuple[str, str]:
    """First and last date."""
    r = rows.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).first()
    return r["a"], r["b"]


def hourly(spark, sf_dir, every="60 minutes") -> DataFrame:
    return panel.resample(ticks(spark, sf_dir), every, tie="event_id")


# --- ingest and quality ------------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT symbol, CAST(date AS varchar) AS date, {r6('close', 'close')}, {r6('high', 'high')}, {r6('low', 'low')}, volume FROM bars")
def daily_bars_view(spark, sf_dir):
    return tidy(daily_bars(spark, sf_dir))


@query(f"WITH {TICKS} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r6('close', 'close')}, {r6('high', 'high')}, {r6('low', 'low')}, n FROM hour")
def resample_hourly(spark, sf_dir):
    return tidy(hourly(spark, sf_dir))


@query(f"WITH {PANEL} SELECT symbol, CAST(date AS varchar) AS date, {r6('close', 'close')}, {r6('1e6 * ret', 'ret_e6')} FROM r")
def panel_common_history(spark, sf_dir):
    return tidy(base(spark, sf_dir).select("symbol", "date", "close", e6("ret")))


@query(f"""WITH {BARS}, u AS (SELECT d.date, s.symbol, b.close FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s
    LEFT JOIN bars b ON b.date = d.date AND b.symbol = s.symbol),
    f AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM u)
    SELECT symbol, CAST(date AS varchar) AS date, {r6('close', 'close')} FROM f
    WHERE date IN (SELECT date FROM f WHERE close IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM f))""")
def panel_forward_filled(spark, sf_dir):
    return tidy(panel.forward_filled(daily_bars(spark, sf_dir)))


@query(f"""WITH {BARS}, x AS (SELECT *, close / lag(close) OVER w - 1 AS ret, CASE WHEN close - lag(close) OVER w = 0 THEN 1 ELSE 0 END AS flat FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    y AS (SELECT *, sum(flat) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS run FROM x),
    g AS (SELECT symbol, count(*) AS n_rows, min(date) AS first, max(date) AS last, count(date) - count(DISTINCT date) AS dup, count(*) FILTER (WHERE close IS NULL) AS missing,
        count(*) FILTER (WHERE close <= 0) AS nonpos, min(least(close, high, low)) < 0 AS negative, CAST(max(run) AS bigint) AS stale, count(*) FILTER (WHERE abs(ret) > 0.5) AS extreme,
        count(DISTINCT CASE WHEN dayofweek(date) BETWEEN 1 AND 5 THEN date END) AS present FROM y GROUP BY symbol),
    h AS (SELECT *, (SELECT count(*) FROM generate_series(CAST(g.first AS timestamp), CAST(g.last AS timestamp), INTERVAL 1 DAY) t(d) WHERE dayofweek(d) BETWEEN 1 AND 5) AS days FROM g),
    k AS (SELECT *, days - present AS missing_days FROM h),
    l AS (SELECT *, concat_ws('; ', CASE WHEN dup > 0 THEN concat(dup, ' duplicate timestamps') END, CASE WHEN missing > 0 THEN concat(missing, ' missing closes') END,
        CASE WHEN nonpos > 0 THEN concat(nonpos, ' non-positive closes') END, CASE WHEN negative THEN 'negative prices' END,
        CASE WHEN 100 * missing_days > 10 * greatest(days, 1) THEN concat(missing_days, ' missing business days') END, CASE WHEN stale >= 5 THEN 'stale run' END,
        CASE WHEN extreme > 0 THEN concat(extreme, ' extreme moves') END) AS issues FROM k)
    SELECT symbol, n_rows, CAST(first AS varchar) AS first, CAST(last AS varchar) AS last, dup, missing, nonpos, negative, missing_days, stale, extreme, issues,
        CASE WHEN dup > 0 OR missing > 0 OR nonpos > 0 OR negative THEN 'FAIL' WHEN issues <> '' THEN 'WARN' ELSE 'OK' END AS status FROM l""")
def qc_report(spark, sf_dir):
    return tidy(qc.qc_report(daily_bars(spark, sf_dir)))


@query(f"""WITH {BARS}, x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars)
    SELECT symbol, count(*) AS n_rows, CAST(min(date) AS varchar) AS first, CAST(max(date) AS varchar) AS last, count(date) - count(DISTINCT date) AS dup, count(*) FILTER (WHERE close <= 0) AS nonpos,
    count(*) FILTER (WHERE close IS NULL) AS missing, count(*) FILTER (WHERE ret = 0) AS zero_returns, {r6('max(abs(ret))', 'largest_move')} FROM x GROUP BY symbol""")
def quick_report(spark, sf_dir):
    return tidy(qc.quick_report(daily_bars(spark, sf_dir)))


@query(f"""WITH {BARS}, fi AS (SELECT DISTINCT date FROM bars WHERE day(date) NOT BETWEEN 10 AND 19), sp AS (SELECT min(date) AS a, max(date) AS b FROM bars),
    wk AS (SELECT d AS date FROM (SELECT CAST(unnest(generate_series(CAST(a AS timestamp), CAST(b AS timestamp), INTERVAL 1 DAY)) AS date) AS d FROM sp) WHERE dayofweek(d) BETWEEN 1 AND 5),
    m AS (SELECT wk.date, CASE WHEN fi.date IS NULL THEN 0 ELSE 1 END AS here FROM wk LEFT JOIN fi USING (date)), i AS (SELECT *, sum(here) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
    SELECT CAST(min(date) AS varchar) AS first, CAST(max(date) AS varchar) AS last, count(*) AS days, count(*) > 4 AS halts FROM i WHERE here = 0 GROUP BY island""")
def missing_files(spark, sf_dir):
    """Runs of weekdays without a file where days numbered 10 to 19 have none, and whether they halt a job."""
    rows = settled(daily_bars(spark, sf_dir), "bars")
    return tidy(qc.file_runs(*_span(rows), rows.select("date").distinct().filter("day(date) not between 10 and 19")).withColumn("halts", F.col("days") > 4))


def _one_dialect(spark, sf_dir) -> DataFrame:
    """Bars of all symbols under the two header dialects of exchange files (those before 'B' modern, series EQ; the others
    legacy, series BE), with padded keys and either date spelling, made one again."""
    raw = daily_bars(spark, sf_dir).withColumn("open", F.col("close"))
    shapes = [(bars.MODERN, F.col("date").cast("string"), "EQ", raw.filter("symbol < 'B'")), (bars.LEGACY, F.upper(F.date_format("date", "dd-MMM-yyyy")), "BE", raw.filter("symbol >= 'B'"))]
    out = [bars.one_dialect(df.select(date.alias(d["date"]), F.concat(F.col("symbol"), F.lit(" ")).alias(d["symbol"]), F.lit(series_).alias(d["series"]), *[F.col(c).alias(d[c]) for c in (*bars.PRICES, "volume")])) for d, date, series_, df in shapes]
    return out[0].unionByName(out[1]).select("date", "symbol", "series", "close", "volume")


DIALECTS = f"WITH {BARS} SELECT CAST(date AS varchar) AS date, symbol, CASE WHEN symbol < 'B' THEN 'EQ' ELSE 'BE' END AS series, {r6('close', 'close')}, {r6('volume', 'volume')} FROM bars"


@query(DIALECTS)
def exchange_dialects(spark, sf_dir):
    return tidy(_one_dialect(spark, sf_dir))


@query(DIALECTS)
def exchange_dialects_all(spark, sf_dir):
    """The name that exchange_dialects had for all symbols while it left some out; kept for its callers."""
    return exchange_dialects(spark, sf_dir)


@query(f"""WITH {BARS}, q AS (SELECT symbol, date, (1 + volume % 7) * 0.01 / close AS rel FROM bars WHERE symbol <> 'AF' OR dayofweek(date) <> 2), d AS (SELECT b.symbol, b.date, q.rel FROM bars b LEFT JOIN q USING (symbol, date))
    SELECT symbol, CAST(date AS varchar) AS date, {r6("1e6 * last_value(rel IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 'cost_e6')} FROM d""")
def aligned_costs(spark, sf_dir):
    """Relative spreads, missing on one symbol's Tuesdays, aligned to the bars' dates and carried forward."""
    rows = daily_bars(spark, sf_dir)
    specs = rows.select("symbol").distinct().withColumn("point", F.lit(0.01))
    costs = panel.relative_spread(rows.withColumn("spread", 1 + F.col("volume") % 7), specs).filter("symbol <> 'AF' or dayofweek(date) <> 3").select("symbol", "date", F.col("rel_spread").alias("cost"))
    return tidy(panel.with_costs(rows.select("symbol", "date"), costs).select("symbol", "date", (1e6 * F.col("cost")).alias("cost_e6")))


DAYS = f"""{BARS}, span AS (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY symbol),
    days AS (SELECT symbol, CAST(unnest(generate_series(CAST(a AS timestamp), CAST(b AS timestamp), INTERVAL 1 DAY)) AS date) AS date FROM span),
    wk AS (SELECT * FROM days WHERE dayofweek(date) BETWEEN 1 AND 5)"""


@query(f"WITH {DAYS} SELECT symbol, CAST(date AS varchar) AS date FROM wk ANTI JOIN bars USING (symbol, date)")
def calendar_gaps(spark, sf_dir):
    return tidy(qc.calendar_gaps(daily_bars(spark, sf_dir)))


@query(f"""WITH {DAYS}, m AS (SELECT wk.symbol, wk.date, CASE WHEN b.date IS NULL THEN 0 ELSE 1 END AS here FROM wk LEFT JOIN bars b ON b.symbol = wk.symbol AND b.date = wk.date),
    i AS (SELECT *, sum(here) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
    SELECT symbol, CAST(min(date) AS varchar) AS first, CAST(max(date) AS varchar) AS last, count(*) AS days FROM i WHERE here = 0 GROUP BY symbol, island HAVING count(*) > 1""")
def missing_runs(spark, sf_dir):
    return tidy(qc.missing_runs(daily_bars(spark, sf_dir), longest=1))


@query(f"""WITH {BARS}, wk AS (SELECT d AS date FROM (SELECT CAST(unnest(generate_series(CAST(min(date) AS timestamp), CAST(max(date) AS timestamp), INTERVAL 1 DAY)) AS date) AS d FROM bars) WHERE dayofweek(d) BETWEEN 1 AND 5),
    fi AS (SELECT DISTINCT date FROM bars WHERE day(date) <> 13), sy AS (SELECT DISTINCT symbol FROM bars)
    SELECT CAST(NULL AS varchar) AS symbol, CAST(date AS varchar) AS date, 'weekday-404' AS reason FROM wk WHERE date NOT IN (SELECT date FROM fi)
    UNION ALL SELECT sy.symbol, CAST(wk.date AS varchar), 'not-listed' FROM wk JOIN fi USING (date) CROSS JOIN sy WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = sy.symbol AND b.date = wk.date)""")
def skipped_days(spark, sf_dir):
    """Over all dates of the table; days numbered 13 have no file."""
    rows = settled(daily_bars(spark, sf_dir), "bars")
    files = rows.select("date").distinct().filter("day(date) <> 13")
    return tidy(qc.skipped_days(*_span(rows), files, rows.select("date", "symbol")))


@query(f"WITH {BARS} SELECT symbol, count(*) FILTER (WHERE close IS NULL OR close <= 0) = 0 AS valid FROM bars GROUP BY symbol")
def valid_prices(spark, sf_dir):
    return qc.valid_prices(daily_bars(spark, sf_dir))


ACTIONS = [("AF", "1996-03-04", 10.0, 10.0), ("AF", "1998-07-01", 2.0, 2.0), ("NO", "1997-01-15", 5.0, 5.0), ("RF", "1999-05-20", 4.0, 4.0)]
ACTIONS_SQL = "acts(symbol, ex_date, price_div, vol_mult) AS (VALUES " + ", ".join(f"('{s}', DATE '{d}', {p}, {v})" for s, d, p, v in ACTIONS) + ")"
ADJUSTED = f"""{BARS}, {ACTIONS_SQL}, adj AS (SELECT b.symbol, b.date, b.close / coalesce(product(a.price_div), 1) AS close, b.high / coalesce(product(a.price_div), 1) AS high,
    b.low / coalesce(product(a.price_div), 1) AS low, b.volume * coalesce(product(a.vol_mult), 1) AS volume
    FROM bars b LEFT JOIN acts a ON a.symbol = b.symbol AND b.date < a.ex_date GROUP BY b.symbol, b.date, b.close, b.high, b.low, b.volume)"""


def _actions(spark):
    return spark.createDataFrame(ACTIONS, "symbol string, ex_date string, price_div double, vol_mult double").withColumn("ex_date", F.to_date("ex_date"))


@query(f"WITH {ADJUSTED} SELECT symbol, CAST(date AS varchar) AS date, {r6('close', 'close')}, {r6('high', 'high')}, {r6('low', 'low')}, {r6('volume', 'volume')} FROM adj")
def corporate_action_adjust(spark, sf_dir):
    return tidy(adjust.adjusted(daily_bars(spark, sf_dir), _actions(spark)))


@query(f"""WITH {ADJUSTED}, j AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM adj)
    SELECT symbol, CAST(date AS varchar) AS date, {r6('ret', 'ret')} FROM j WHERE abs(ret) > 0.5""")
def residual_jumps(spark, sf_dir):
    rows = settled(daily_bars(spark, sf_dir), "bars")
    return tidy(adjust.residual_jumps(rows, _actions(spark), *_span(rows)))


# --- signals -----------------------------------------------------------------------------------------------------

_W = "PARTITION BY symbol ORDER BY date"
MOMENTUM_SQL = "(" + " + ".join(f"sign(close / lag(close, {k}) OVER ({_W}) - 1)" for k in signals.MOMENTUM) + f") / {len(signals.MOMENTUM)}"


def _range(k):
    w = f"OVER ({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {w} = {k} THEN 2 * (close - min(close) {w}) / (max(close) {w} - min(close) {w}) - 1 END"


BREAKOUT_SQL = "(" + " + ".join(_range(k) for k in signals.BREAKOUT) + f") / {len(signals.BREAKOUT)}"


@query(f"WITH {PANEL} SELECT symbol, CAST(date AS varchar) AS date, {r6(MOMENTUM_SQL, 'signal')} FROM r")
def momentum_signal(spark, sf_dir):
    return tidy(base(spark, sf_dir).select("symbol", "date", roll.momentum("close", series("symbol"), signals.MOMENTUM).alias("signal")))


@query(f"WITH {PANEL} SELECT symbol, CAST(date AS varchar) AS date, {r6(BREAKOUT_SQL, 'signal')} FROM r")
def breakout_signal(spark, sf_dir):
    return tidy(base(spark, sf_dir).select("symbol", "date", roll.breakout("close", series("symbol"), signals.BREAKOUT).alias("signal")))


def _hours(spark, sf_dir, every="60 minutes"):
    """The coarser bars, written once for those who read them twice."""
    return settled(hourly(spark, sf_dir, every), "hours")


def _legs(hours):
    return panel.all_pairs(hours)


PAIRS = TICKS + """, legs AS (SELECT concat(a.symbol, '/', b.symbol) AS pair, a.symbol AS sym_a, b.symbol AS sym_b, a.ts, a.close AS a, b.close AS b, a.high, a.low, ln(a.close) AS la, ln(b.close) AS lb
    FROM hour a JOIN hour b ON a.ts = b.ts AND a.symbol < b.symbol),
bt AS (SELECT *, CASE WHEN count(*) OVER w = 60 THEN covar_pop(la, lb) OVER w / var_pop(lb) OVER w END AS beta FROM legs WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
rs AS (SELECT *, la - beta * lb AS resid FROM bt),
z AS (SELECT *, CASE WHEN count(resid) OVER w = 60 THEN (resid - avg(resid) OVER w) / stddev_samp(resid) OVER w END AS z, row_number() OVER (PARTITION BY pair ORDER BY ts) - 1 AS i
    FROM rs WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {PAIRS} SELECT pair, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r6('beta', 'beta')}, {r6('resid', 'resid')}, {r6('z', 'z')} FROM z")
def rolling_beta_zscore(spark, sf_dir):
    return tidy(roll.spread_zscore(_legs(_hours(spark, sf_dir))).select("pair", "ts", "beta", "resid", "z"))


@query(f"""WITH {PANEL} SELECT a.symbol AS i, b.symbol AS j, count(*) AS n, {r6('corr(a.ret, b.ret)', 'corr')} FROM r a JOIN r b ON a.date = b.date AND a.symbol <= b.symbol
    WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2""")
def return_correlation(spark, sf_dir):
    return tidy(metrics.return_correlation(base(spark, sf_dir)))


def _ewm_sql(source: str, column: str, span: int, name: str, kind: str) -> str:
    """A CTE with symbol, i and the weighted mean or deviation: a self-join with weights q^(t - i)."""
    w = f"pow({1 - 2 / (span + 1)!r}, t.i - s.i)"
    x = f"s.{column}"
    mean = f"sum({w} * {x}) / sum({w})"
    if kind == "mean":
        value = mean
    else:
        value = f"CASE WHEN count(*) > 1 THEN sqrt(greatest(sum({w} * {x} * {x}) / sum({w}) - pow({mean}, 2), 0) * pow(sum({w}), 2) / (pow(sum({w}), 2) - sum({w} * {w}))) END"
    return f"{name} AS (SELECT t.symbol, t.i, {value} AS v FROM {source} t JOIN {source} s ON s.symbol = t.symbol AND s.i <= t.i AND s.i > t.i - {40 * span} WHERE {x} IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {PANEL}, {_ewm_sql('r', 'ret', 30, 'v', 'sd')} SELECT r.symbol, CAST(r.date AS varchar) AS date, {r6('v.v', 'vol')} FROM r LEFT JOIN v USING (symbol, i)")
def ewm_vol(spark, sf_dir):
    return tidy(roll.ewm(base(spark, sf_dir), "ret", {"vol": ("sd", 30)}).select("symbol", "date", "vol"))


def _crossover_sql(pairs) -> tuple[str, str]:
    spans = sorted({s for p in pairs for s in p})
    ctes = ", ".join(_ewm_sql("r", "close", s, f"m{s}", "mean") for s in spans)
    diffs = ", ".join(f"m{f}.v - m{s}.v AS x{f}_{s}" for f, s in pairs)
    joins = " ".join(f"JOIN m{s} USING (symbol, i)" for s in spans)
    w = f"OVER ({_W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    total = " + ".join(f"tanh(x{f}_{s} / CASE WHEN count(x{f}_{s}) {w} >= 63 THEN nullif(stddev_samp(x{f}_{s}) {w}, 0) END)" for f, s in pairs)
    return f"{PANEL}, {ctes}, d AS (SELECT r.symbol, r.date, r.i, r.close, r.ret, {diffs} FROM r {joins})", f"({total}) / {len(pairs)}"


_CTE, _CROSS = _crossover_sql(signals.CROSSOVERS)


@query(f"WITH {_CTE} SELECT symbol, CAST(date AS varchar) AS date, {r6(_CROSS, 'signal')} FROM d")
def ewma_crossover(spark, sf_dir):
    return tidy(signals.crossover(base(spark, sf_dir), name="signal").select("symbol", "date", "signal"))


@query(f"""WITH {_CTE}, e AS (SELECT symbol, date, ({MOMENTUM_SQL} + {_CROSS} + {BREAKOUT_SQL}) / 3 AS f FROM d)
    SELECT symbol, CAST(date AS varchar) AS date, {r6('CASE WHEN f IS NOT NULL THEN greatest(least(f, 1), -1) END', 'forecast')} FROM e""")
def ensemble_forecast(spark, sf_dir):
    return tidy(signals.families(base(spark, sf_dir)).select("symbol", "date", signals.forecast(("tsmom", "ewma", "bo")).alias("forecast")))


# --- portfolios --------------------------------------------------------------------------------------------------

#: Lookbacks whose trend is followed or, negative, faded; and rows of the deviation.
LOOKBACKS, VOL_ROWS = (-15, 42, -126, 252), (20, 60)


def _config(k: int, v: int) -> str:
    return f"{'R' if k < 0 else 'L'}{abs(k):03d}/V{v:03d}"


def configs(spark, sf_dir) -> DataFrame:
    """config_id, date, ret of eight simple configurations: a lagged momentum sign, or its opposite, over a lagged trailing deviation."""
    w = series("symbol")
    rows = base(spark, sf_dir).select("symbol", "date", "close", "ret")
    for k in LOOKBACKS:
        rows = rows.withColumn(f"_s{abs(k)}", (1 if k > 0 else -1) * roll.momentum("close", w, (abs(k),)))
    for v in VOL_ROWS:
        rows = rows.withColumn(f"_v{v}", rolling(F.stddev_samp, "ret", w, v))
    one = [(_config(k, v), F.coalesce(F.try_divide(F.lag(f"_s{abs(k)}").over(w), F.lag(f"_v{v}").over(w)), F.lit(0.0)) * 0.001) for k in LOOKBACKS for v in VOL_ROWS]
    for i, (_, e) in enumerate(one):
        rows = rows.withColumn(f"_e{i}", e)
    rows = rows.select("symbol", "date", "ret", F.explode(F.array(*[F.struct(F.lit(n).alias("config_id"), F.col(f"_e{i}").alias("pos")) for i, (n, _) in enumerate(one)])).alias("c")).select("symbol", "date", "ret", "c.*")
    return portfolio.portfolio_returns(rows, ("config_id",))


def _configs_sql() -> str:
    sd = ", ".join(f"CASE WHEN count(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {v - 1} PRECEDING AND CURRENT ROW) = {v} THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {v - 1} PRECEDING AND CURRENT ROW) END AS v{v}" for v in VOL_ROWS)
    sg = ", ".join(f"{1 if k > 0 else -1} * sign(close / lag(close, {abs(k)}) OVER ({_W}) - 1) AS s{abs(k)}" for k in LOOKBACKS)
    one = " UNION ALL ".join(f"SELECT '{_config(k, v)}' AS config_id, date, ret, coalesce(lag(s{abs(k)}) OVER ({_W}) / nullif(lag(v{v}) OVER ({_W}), 0), 0) * 0.001 AS pos FROM fe" for k in LOOKBACKS for v in VOL_ROWS)
    return f"{PANEL}, fe AS (SELECT symbol, date, ret, {sd}, {sg} FROM r), po AS ({one}), cfg AS (SELECT config_id, date, coalesce(sum(pos * ret), 0) AS ret FROM po GROUP BY 1, 2)"


CONFIGS = _configs_sql()


@query(f"WITH {CONFIGS} SELECT config_id, CAST(date AS varchar) AS date, {r6('1e6 * ret', 'ret_e6')} FROM cfg")
def trend_portfolio(spark, sf_dir):
    return tidy(configs(spark, sf_dir).select("config_id", "date", e6("ret")))


def _target(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("signal", roll.momentum("close", series("symbol"), signals.MOMENTUM)).withColumn("config_id", F.lit("tsmom"))
    targets = spark.createDataFrame(list(portfolio.VOL_TARGETS.items()), "target_id string, target double")
    return portfolio.targeted(portfolio.inverse_vol_exposure(rows), targets)


TARGETED = f"""{PANEL}, {_ewm_sql('r', 'ret', 30, 'v', 'sd')}, sg AS (SELECT symbol, date, i, ret, {MOMENTUM_SQL} AS signal FROM r),
    ex AS (SELECT sg.symbol, sg.date, sg.ret, coalesce(lag(sg.signal) OVER (PARTITION BY sg.symbol ORDER BY sg.i) / nullif(lag(v.v) OVER (PARTITION BY sg.symbol ORDER BY sg.i), 0), 0) AS expo FROM sg LEFT JOIN v USING (symbol, i)),
    raw AS (SELECT date, coalesce(sum(expo * ret), 0) AS raw FROM ex GROUP BY date),
    sd AS (SELECT date, CASE WHEN count(raw) OVER w = 30 THEN stddev_samp(raw) OVER w END AS sd FROM raw WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    sc AS (SELECT date, lag(sd) OVER (ORDER BY date) AS sd FROM sd),
    tg(target_id, target) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in portfolio.VOL_TARGETS.items())}),
    po AS (SELECT tg.target_id, ex.symbol, ex.date, ex.ret, greatest(least(ex.expo * coalesce(least(tg.target / nullif(sc.sd, 0), 50), 0), 1), -1) AS pos FROM ex JOIN sc USING (date) CROSS JOIN tg)"""


@query(f"WITH {TARGETED} SELECT target_id, CAST(date AS varchar) AS date, {r6('1e6 * coalesce(sum(pos * ret), 0)', 'ret_e6')} FROM po GROUP BY target_id, date")
def vol_targeted_portfolio(spark, sf_dir):
    return tidy(portfolio.portfolio_returns(_target(spark, sf_dir), ("target_id",)).select("target_id", "date", e6("ret")))


@query(f"""WITH {TARGETED}, fr AS (SELECT *, coalesce(abs(pos - lag(pos) OVER (PARTITION BY target_id, symbol ORDER BY date)) * 0.0005, 0) AS fric FROM po)
    SELECT target_id, CAST(date AS varchar) AS date, {r6('1e6 * (coalesce(sum(pos * ret), 0) - sum(fric))', 'ret_e6')} FROM fr GROUP BY target_id, date""")
def vol_targeted_portfolio_costs(spark, sf_dir):
    return tidy(portfolio.portfolio_returns(_target(spark, sf_dir).withColumn("cost", F.lit(0.0005)), ("target_id",), "cost").select("target_id", "date", e6("ret")))


WEIGHTS_SQL = f"{sql.shrunk_windows(portfolio.COVARIANCE_ROWS, portfolio.REBALANCE_ROWS)}, {sql.EQUAL_RISK}"
GRID_SQL = f"WITH RECURSIVE {_CTE}, {_ewm_sql('r', 'ret', 30, 'vol', 'sd')}, {WEIGHTS_SQL}, " + sql.trend_grid(
    f"sg AS (SELECT symbol, date, i, ret, {MOMENTUM_SQL} AS tsmom, {_CROSS} AS ewma, {BREAKOUT_SQL} AS bo FROM d)", portfolio.SIGNAL_SETS, portfolio.VOL_TARGETS
)


@query(f"{GRID_SQL} SELECT config_id, CAST(date AS varchar) AS date, {r6('1e6 * ret', 'ret_e6')} FROM grid")
def trend_study_grid(spark, sf_dir):
    return tidy(portfolio.trend_grid(base(spark, sf_dir)).select("config_id", "date", e6("ret")))


@query(f"WITH {PANEL}, {sql.shrunk_windows(portfolio.COVARIANCE_ROWS, portfolio.REBALANCE_ROWS)} SELECT CAST(window_id AS bigint) AS window_id, i, j, {r6('1e6 * cov', 'cov_e6')}, {r6('delta', 'delta')} FROM cov")
def ledoit_wolf(spark, sf_dir):
    """The shrunk covariance of every rebalance window."""
    return tidy(portfolio.rebalance_covariance(settled(base(spark, sf_dir), "panel")).select("window_id", "i", "j", (1e6 * F.col("cov")).alias("cov_e6"), "delta"))


@query(f"WITH RECURSIVE {PANEL}, {WEIGHTS_SQL} SELECT symbol, CAST(date AS varchar) AS date, {r6('weight', 'weight')} FROM wt")
def risk_parity_weights(spark, sf_dir):
    return tidy(portfolio.risk_parity_weights(base(spark, sf_dir)).select("symbol", "date", "weight"))


# --- metrics -----------------------------------------------------------------------------------------------------

DRAWN = """eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY config_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM cfg),
    dd AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY config_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd FROM eq),
    mo AS (SELECT config_id, avg(ret) AS m, var_pop(ret) AS v FROM cfg GROUP BY 1),
    sk AS (SELECT c.config_id, avg(pow(ret - m, 3)) / pow(max(v), 1.5) AS skew, avg(pow(ret - m, 4)) / pow(max(v), 2) - 3 AS kurt FROM cfg c JOIN mo USING (config_id) GROUP BY 1)"""


@query(f"""WITH {CONFIGS}, {DRAWN} SELECT config_id, count(ret) AS n, {r6('1e6 * avg(ret)', 'mean_e6')}, {r6('1e6 * stddev_samp(ret)', 'sd_e6')}, {r6('max(dd)', 'maxdd')}, {r6('1e6 * min(ret)', 'worst_day_e6')}, {r6('max(skew)', 'skew')}, {r6('max(kurt)', 'kurt')},
    {r6('avg(ret) / stddev_samp(ret) * sqrt(252)', 'sharpe')}, {r6('product(1 + ret) - 1', 'total_return')}, {r6('pow(product(1 + ret), 252.0 / count(ret)) - 1', 'annual_return')} FROM dd JOIN sk USING (config_id) GROUP BY config_id""")
def performance_metrics(spark, sf_dir):
    return tidy(metrics.performance(configs(spark, sf_dir)).select("config_id", "n", *[e6(c) for c in ("mean", "sd", "worst_day")], "maxdd", "skew", "kurt", "sharpe", "total_return", "annual_return"))


@query(f"""WITH {CONFIGS}, sg AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY config_id ORDER BY date) <= floor(count(*) OVER (PARTITION BY config_id) * 0.6) THEN 'train' ELSE 'test' END AS segment FROM cfg)
    SELECT config_id, segment, count(*) AS n, {r6('avg(ret) / stddev_samp(ret) * sqrt(252)', 'sharpe')}, {r6('product(1 + ret) - 1', 'total_return')} FROM sg GROUP BY 1, 2""")
def train_test_metrics(spark, sf_dir):
    return tidy(metrics.performance(metrics.segments(configs(spark, sf_dir), 0.6), ("config_id", "segment")).select("config_id", "segment", "n", "sharpe", "total_return"))


@query(f"WITH {CONFIGS}, {DRAWN} SELECT config_id, count(*) FILTER (WHERE ret < -0.05) AS bad_days, {r6('max(dd)', 'maxdd')}, round(100000.0 * product(1 + ret), 2) AS final_equity FROM dd GROUP BY 1")
def risk_limits(spark, sf_dir):
    return tidy(metrics.risk_limits(configs(spark, sf_dir)).withColumn("final_equity", F.round("final_equity", 2)))


@query(f"""WITH {CONFIGS}, fo AS (SELECT *, ntile(5) OVER (PARTITION BY config_id ORDER BY date) AS fold FROM cfg)
    SELECT config_id, CAST(fold AS bigint) AS fold, count(*) AS n, {r6('avg(ret) / stddev_samp(ret) * sqrt(252)', 'sharpe')} FROM fo GROUP BY 1, 2""")
def fold_sharpes(spark, sf_dir):
    return tidy(metrics.fold_sharpes(configs(spark, sf_dir), 5))


@query(f"""WITH {CONFIGS}, {DRAWN}, b AS (SELECT config_id, count(*) AS n, avg(ret) / stddev_pop(ret) AS sr FROM cfg GROUP BY 1),
    s AS (SELECT b.*, sqrt((1 - skew * sr + (kurt + 2) / 4 * sr * sr) / (n - 1)) AS sd FROM b JOIN sk USING (config_id)),
    t AS (SELECT *, sd * {sql.quantiles(8)!r} AS sr0 FROM s)
    SELECT config_id, n, {r6('sr', 'sr')}, round(sr0, 6) AS sr0, {r6(sql.normal_cdf('(sr - sr0) / sd'), 'dsr')} FROM t""")
def deflated_sharpe(spark, sf_dir):
    return tidy(metrics.deflated_sharpe(configs(spark, sf_dir), 8))


@query(f"""WITH {PANEL}, {_ewm_sql('r', 'ret', 30, 'v', 'sd')}, sg AS (SELECT symbol, i, ret, sign(close / lag(close, 60) OVER ({_W}) - 1) AS s FROM r),
    p AS (SELECT sg.symbol, sg.ret * lag(sg.s) OVER w / nullif(lag(v.v) OVER w, 0) AS x FROM sg LEFT JOIN v USING (symbol, i) WINDOW w AS (PARTITION BY sg.symbol ORDER BY sg.i))
    SELECT symbol, count(x) AS n, {r6('avg(x) / stddev_samp(x) * sqrt(252)', 'sharpe')} FROM p GROUP BY symbol""")
def instrument_sharpe(spark, sf_dir):
    w = series("symbol")
    rows = roll.ewm(base(spark, sf_dir), "ret", {"vol": ("sd", 30)}).withColumn("s", roll.momentum("close", w, (60,)))
    rows = rows.withColumn("x", F.try_divide(F.col("ret") * F.lag("s").over(w), F.lag("vol").over(w)))
    return tidy(rows.groupBy("symbol").agg(F.count("x").alias("n"), (F.try_divide(F.avg("x"), F.stddev_samp("x")) * 252**0.5).alias("sharpe")))


# --- trades ------------------------------------------------------------------------------------------------------

SPEC = {"point": 0.01, "mult": 1.0, "comm_rt": 0.5, "spread": 5.0}


def _pair_trades(spark, sf_dir, **how):
    hours = _hours(spark, sf_dir)
    legs = _legs(hours).withColumn("spread_a", F.lit(SPEC["spread"])).withColumn("spread_b", F.lit(SPEC["spread"]))
    specs = hours.select("symbol").distinct().select("symbol", *[F.lit(SPEC[c]).alias(c) for c in ("point", "mult", "comm_rt")])
    return trades.pair_trades(legs, specs, **how)


#: The open state of a pair travels along its rows: entry row and what was fixed there.
PAIR_TRADES = PAIRS + """, ok AS (SELECT pair, i, a, b, beta, z, row_number() OVER (PARTITION BY pair ORDER BY i) AS k FROM z WHERE i > 60 AND z IS NOT NULL AND beta IS NOT NULL),
st AS (
    SELECT pair, k, i, a, b, beta, z, CASE WHEN abs(z) > 2 AND beta > 0 THEN k END AS entry, CAST(NULL AS bigint) AS closed FROM ok WHERE k = 1
    UNION ALL
    SELECT o.pair, o.k, o.i, o.a, o.b, o.beta, o.z,
        CASE WHEN s.entry IS NULL THEN CASE WHEN abs(o.z) > 2 AND o.beta > 0 THEN o.k END WHEN abs(o.z) < 0.4 OR abs(o.z) > 3.2 THEN NULL ELSE s.entry END,
        CASE WHEN s.entry IS NOT NULL AND (abs(o.z) < 0.4 OR abs(o.z) > 3.2) THEN s.entry END
    FROM st s JOIN ok o ON o.pair = s.pair AND o.k = s.k + 1),
tr AS (SELECT x.pair, row_number() OVER (PARTITION BY x.pair ORDER BY x.k) AS trade_no, x.i - e.i AS bars, e.z AS entry_z, x.z AS exit_z,
        CASE WHEN e.z > 0 THEN -1 ELSE 1 END * (25000.0 / e.a * (x.a - e.a) - e.beta * 25000.0 / e.b * (x.b - e.b)) AS gross,
        2 * (25000.0 / e.a + e.beta * 25000.0 / e.b) * (5 * 0.01 + 0.5) * 0.5 AS fric, CASE WHEN abs(x.z) > 3.2 THEN 1 ELSE 0 END AS stopped
    FROM st x JOIN ok e ON e.pair = x.pair AND e.k = x.closed WHERE x.closed IS NOT NULL)"""


@query(f"""WITH RECURSIVE {PAIR_TRADES} SELECT pair, trade_no, bars, {r6('entry_z', 'entry_z')}, {r6('exit_z', 'exit_z')}, {r6('gross', 'gross')}, {r6('fric', 'fric')}, {r6('gross - fric', 'net')}, CAST(stopped AS bigint) AS stopped FROM tr""")
def pair_trades(spark, sf_dir):
    return tidy(_pair_trades(spark, sf_dir))


@query(f"""WITH RECURSIVE {PAIR_TRADES}, e AS (SELECT *, gross - fric AS net, sum(gross - fric) OVER (PARTITION BY pair ORDER BY trade_no) AS equity, count(*) OVER (PARTITION BY pair) // 2 AS half FROM tr),
    d AS (SELECT *, max(equity) OVER (PARTITION BY pair ORDER BY trade_no) - equity AS dd FROM e)
    SELECT pair, count(*) AS trades, {r6('avg(gross)', 'gross_pt')}, {r6('avg(fric)', 'fric_pt')}, {r6('avg(net)', 'net_pt')}, {r6('sum(net)', 'net_total')}, {r6('100 * avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END)', 'winrate')},
    {r6('avg(gross) / avg(fric)', 'ratio')}, {r6('median(bars)', 'med_bars')}, {r6('100 * avg(stopped)', 'stop_pct')}, {r6('avg(net) FILTER (WHERE trade_no <= half)', 'net_pt_h1')}, {r6('avg(net) FILTER (WHERE trade_no > half)', 'net_pt_h2')}, {r6('max(dd)', 'maxdd')}
    FROM d GROUP BY pair""")
def pair_screen(spark, sf_dir):
    return tidy(trades.pair_summary(_pair_trades(spark, sf_dir)).orderBy(F.desc("net_pt")))


@query(ORACLE_SQL["pair_screen"])
def ranked_screen(spark, sf_dir):
    """The screen as one ranked CSV file, read back."""
    path = scratch(spark, "ranked")
    screen = pair_screen(spark, sf_dir)
    bars.write_ranked(screen, path)
    return spark.read.option("header", True).schema(screen.schema).csv(path)


def _leg_bars(spark, sf_dir, every="60 minutes"):
    hours = _hours(spark, sf_dir, every)
    legs = _legs(hours).select(F.col("pair").alias("symbol"), "sym_a", "ts", "a", "b")
    range_ = hours.select(F.col("symbol").alias("sym_a"), "ts", "high", "low")
    return legs.join(range_, ["sym_a", "ts"]).withColumn("bid_ask", F.lit(SPEC["spread"] * SPEC["point"]))


#: Rows that are only watched follow from the window and the trend's span.
LEG_GRID = [(f"z{z}/a{m}", z, 3.0, m, trades.warmup(trades.SingleLeg(rows=60, trend_span=60))) for z in (1.5, 2.0, 2.5) for m in (0.5, 1.0, 3.5)]
LEG_SQL = f"WITH RECURSIVE {TICKS}, {LEGS}, {sql.recursive_mean('leg', 'a', 60, 'trend')}, {sql.leg_features(60, 60, 'f60')}, {sql.leg_trades(['f60'], [(*g, 0) for g in LEG_GRID])}"


def _leg_trades(spark, sf_dir):
    return trades.leg_trades(trades.leg_features(_leg_bars(spark, sf_dir), trades.SingleLeg(trend_span=60)), spark.createDataFrame(LEG_GRID, "config_id string, entry double, stop double, range_mult double, warmup int"))


@query(f"""{LEG_SQL} SELECT symbol, config_id, CAST(trade_no AS bigint) AS trade_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, bars, reason, CAST(sgn AS bigint) AS sgn, {r6('gross_pts', 'gross_pts')}, {r6('net_pts', 'net_pts')}, {r6('r', 'r')} FROM trades""")
def single_leg_trades(spark, sf_dir):
    return tidy(_leg_trades(spark, sf_dir))


@query(f"{LEG_SQL}, {sql.SUMMARY} SELECT {sql.summary_columns()} FROM summary")
def single_leg_summary(spark, sf_dir):
    return tidy(trades.risk_summary(_leg_trades(spark, sf_dir)))


@query(f"{LEG_SQL} SELECT symbol, config_id, CAST(sgn AS bigint) AS sgn, count(*) AS n, {r6('100 * avg(CASE WHEN r > 0 THEN 1e0 ELSE 0 END)', 'win')}, {r6('avg(r)', 'avg_r')}, {r6('sum(r)', 'sum_r')} FROM trades GROUP BY symbol, config_id, sgn")
def single_leg_by_side(spark, sf_dir):
    return tidy(trades.by_side(_leg_trades(spark, sf_dir)))


SWEEP_WINDOWS = (40, 60, 90)
SWEEP_GRID = [(f"z{z}/a{m}/w{k}", z, 3.0, m, trades.warmup(trades.SingleLeg(rows=k, trend_span=60)), k) for z in (1.5, 2.0, 2.5) for m in (2.5, 3.5, 5.0) for k in SWEEP_WINDOWS]
SWEEP_SQL = (
    f"WITH RECURSIVE {TICKS.replace('60 MINUTES', '15 MINUTES')}, {LEGS}, {sql.recursive_mean('leg', 'a', 60, 'trend')}, "
    + ", ".join(sql.leg_features(k, 60, f"f{k}") for k in SWEEP_WINDOWS)
    + f", {sql.leg_trades([f'f{k}' for k in SWEEP_WINDOWS], [(*g[:5], SWEEP_WINDOWS.index(g[5])) for g in SWEEP_GRID])}, {sql.SUMMARY}"
)


@query(f"""{SWEEP_SQL}, bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sum_r DESC, config_id) AS rank FROM summary WHERE trades >= 30) WHERE rank <= 8),
    ds AS (SELECT *, sqrt((1 - skew * sr_trade + (kurt + 2) / 4 * sr_trade * sr_trade) / (trades - 1)) AS sd FROM bs), dz AS (SELECT *, CASE WHEN rank = 1 THEN sd * {sql.quantiles(len(SWEEP_GRID))!r} END AS sr0 FROM ds)
    SELECT {sql.summary_columns()}, CAST(rank AS bigint) AS rank, {r6('sr0', 'sr0')}, {r6(sql.normal_cdf('(sr_trade - sr0) / sd'), 'dsr')} FROM dz""")
def parameter_sweep(spark, sf_dir):
    """Every entry x range multiple x window on 15-minute bars; the best configurations of each pair, the first one's Sharpe deflated."""
    features = trades.leg_features(_leg_bars(spark, sf_dir, "15 minutes"), trades.SingleLeg(trend_span=60), windows=SWEEP_WINDOWS)
    done = trades.leg_trades(features, spark.createDataFrame(SWEEP_GRID, "config_id string, entry double, stop double, range_mult double, warmup int, rows int"))
    return tidy(trades.sweep_ranking(trades.risk_summary(settled(done, "sweep")), len(SWEEP_GRID)))


RATIO = PAIRS + """, qt AS (SELECT pair, ts, a, b, a - CASE WHEN count(*) OVER w = 60 THEN avg(a / b) OVER w END * b AS spread FROM legs WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    ss AS (SELECT pair, CASE WHEN count(spread) OVER w = 60 THEN stddev_samp(spread) OVER w END AS sd FROM qt WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {RATIO} SELECT pair, {r6('median(sd)', 'sigma')}, 0.05 AS bid_ask, {r6('0.05 / median(sd)', 'cost')} FROM ss GROUP BY pair")
def friction_calibration(spark, sf_dir):
    return tidy(trades.friction_calibration(_legs(_hours(spark, sf_dir)).withColumn("bid_ask", F.lit(SPEC["spread"] * SPEC["point"]))))


@query(sql.entry_thresholds(RATIO))
def entry_thresholds(spark, sf_dir):
    legs = _legs(_hours(spark, sf_dir)).withColumn("bid_ask", F.lit(SPEC["spread"] * SPEC["point"]))
    return tidy(trades.entry_thresholds(trades.friction_calibration(legs)))


OVERLAY_GRID = [(f, s, t) for f in (16, 32) for s in (96, 192) for t in (0.008, 0.012)]


LEDGER_SQL = f"WITH RECURSIVE {PANEL}, {_ewm_sql('r', 'ret', 20, 'vol', 'sd')}, " + ", ".join(sql.recursive_mean("r", "close", s, f"m{s}") for s in (16, 32, 96, 192)) + f", {sql.share_ledger(OVERLAY_GRID)}"


def _ledger(spark, sf_dir):
    return trades.share_ledger(signals.overlay_grid(base(spark, sf_dir), OVERLAY_GRID), max_cost_ratio=0.005, configs=signals.overlay_names(OVERLAY_GRID))


@query(f"{LEDGER_SQL} SELECT symbol, config_id, CAST(date AS varchar) AS date, {r6('equity', 'equity')}, {r6('cost', 'cost')}, {r6('pos_frac', 'pos_frac')}, {r6('1e6 * strat_ret', 'strat_ret_e6')} FROM ledger")
def share_ledger(spark, sf_dir):
    return tidy(_ledger(spark, sf_dir).select("symbol", "config_id", "date", "equity", "cost", "pos_frac", e6("strat_ret")))


@query(f"""{LEDGER_SQL} SELECT symbol, config_id, count(*) FILTER (WHERE cost > 0) AS rebalances, {r6('sum(cost)', 'total_cost')}, {r6("1e4 * sum(cost) / 1e5 / (datediff('day', min(date), max(date)) / 365.25)", 'bps_per_year')},
    {r6('min(equity - pos_frac * equity)', 'min_cash')} FROM ledger GROUP BY symbol, config_id""")
def cost_diagnostics(spark, sf_dir):
    return tidy(metrics.cost_diagnostics(_ledger(spark, sf_dir)))


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS v, l_returnflag = 'R' AS sells FROM lineitem)
    SELECT sells, count(*) AS n, round(sum(v * 0.0000317 * 1.18 + CASE WHEN sells THEN v * 0.00001 + 13 * 1.18 ELSE v * 0.00015 END), 2) AS cost FROM t GROUP BY sells""")
def transaction_costs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").alias("sells"))
    return rows.groupBy("sells").agg(F.count("*").alias("n"), F.round(F.sum(trades.trade_cost(F.col("v"), F.col("sells"))), 2).alias("cost"))


# --- validation --------------------------------------------------------------------------------------------------


def _rows(spark, sf_dir):
    """row, date, label_end of the panel's dates: a label ends five dates later."""
    rows = settled(numbered(base(spark, sf_dir).select("date").distinct(), "date"), "rows")
    later = rows.select((F.col("row") - 5).alias("row"), F.col("date").alias("label_end"))
    return rows.join(later, "row", "left").withColumn("label_end", F.coalesce("label_end", "date"))


ROWS = f"""{PANEL}, ro AS (SELECT row_number() OVER (ORDER BY date) - 1 AS row, date, coalesce(lead(date, 5) OVER (ORDER BY date), date) AS label_end FROM (SELECT DISTINCT date FROM r))"""


@query(f"""WITH {ROWS}, f AS (SELECT *, ntile(5) OVER (ORDER BY row) AS fold FROM ro), b AS (SELECT fold, min(row) AS a, max(row) AS b, min(date) AS t0, max(label_end) AS t1 FROM f GROUP BY fold),
    c AS (SELECT b.*, (SELECT max(row) FROM ro WHERE ro.date <= b.t1) AS last FROM b)
    SELECT CAST(fold AS bigint) AS fold, row, CASE WHEN row BETWEEN a AND b THEN 'test' WHEN label_end < t0 OR row > last + 20 THEN 'train' ELSE 'purged' END AS role FROM ro, c""")
def purged_kfold(spark, sf_dir):
    return tidy(validation.purged_kfold(_rows(spark, sf_dir), 5, 20))


COMBOS = "co AS (SELECT row_number() OVER (ORDER BY a.g, b.g) - 1 AS split_id, a.g AS g1, b.g AS g2 FROM generate_series(1, 10) a(g) JOIN generate_series(1, 10) b(g) ON a.g < b.g)"


@query(f"""WITH {ROWS}, {COMBOS}, g AS (SELECT row, ntile(10) OVER (ORDER BY row) AS grp FROM ro), e AS (SELECT grp, max(row) AS last FROM g GROUP BY grp)
    SELECT CAST(split_id AS bigint) AS split_id, row, CASE WHEN g.grp IN (g1, g2) THEN 'test' WHEN (row > e1.last AND row <= e1.last + 25) OR (row > e2.last AND row <= e2.last + 25) THEN 'embargoed' ELSE 'train' END AS role
    FROM g CROSS JOIN co LEFT JOIN e e1 ON e1.grp = g1 LEFT JOIN e e2 ON e2.grp = g2""")
def cpcv_splits(spark, sf_dir):
    return tidy(validation.combinatorial_splits(_rows(spark, sf_dir), 10, 2, 25))


SELECTED = f"""{CONFIGS}, {COMBOS}, gr AS (SELECT *, ntile(10) OVER (PARTITION BY config_id ORDER BY date) AS grp, row_number() OVER (PARTITION BY config_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY config_id) AS t FROM cfg),
    en AS (SELECT grp, max(rn) AS last FROM gr GROUP BY grp),
    sc AS (SELECT split_id, config_id, avg(ret) / (stddev_pop(ret) + 1e-12) AS score FROM gr CROSS JOIN co JOIN en e1 ON e1.grp = g1 JOIN en e2 ON e2.grp = g2
        WHERE gr.grp NOT IN (g1, g2) AND NOT (rn > e1.last AND rn <= e1.last + floor(t * 0.01)) AND NOT (rn > e2.last AND rn <= e2.last + floor(t * 0.01)) GROUP BY 1, 2 HAVING count(*) >= 50),
    se AS (SELECT split_id, config_id AS selected, score FROM (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY score DESC, config_id) AS k FROM sc) WHERE k = 1)"""


@query(f"WITH {SELECTED} SELECT CAST(split_id AS bigint) AS split_id, selected, {r6('score', 'score')} FROM se")
def cpcv_selection(spark, sf_dir):
    return tidy(validation.selections(configs(spark, sf_dir)))


EMBARGOES = (0.01, 0.1, 0.3)


@query(f"""WITH {CONFIGS}, {COMBOS}, em(embargo) AS (VALUES {', '.join(f'({e})' for e in EMBARGOES)}), gr AS (SELECT *, ntile(10) OVER (PARTITION BY config_id ORDER BY date) AS grp, row_number() OVER (PARTITION BY config_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY config_id) AS t FROM cfg),
    en AS (SELECT grp, max(rn) AS last FROM gr GROUP BY grp),
    sc AS (SELECT embargo, split_id, config_id, count(*) AS n, avg(ret) / (stddev_pop(ret) + 1e-12) AS score FROM gr CROSS JOIN em CROSS JOIN co JOIN en e1 ON e1.grp = g1 JOIN en e2 ON e2.grp = g2
        WHERE gr.grp NOT IN (g1, g2) AND NOT (rn > e1.last AND rn <= e1.last + floor(t * embargo)) AND NOT (rn > e2.last AND rn <= e2.last + floor(t * embargo)) GROUP BY 1, 2, 3 HAVING count(*) >= 50)
    SELECT CAST(embargo AS double) AS embargo, CAST(split_id AS bigint) AS split_id, config_id AS selected, {r6('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY embargo, split_id ORDER BY score DESC, config_id) AS k FROM sc) WHERE k = 1""")
def cpcv_selection_embargoes(spark, sf_dir):
    """The selections under embargoes within a group, as long as one and longer than several."""
    rows = settled(configs(spark, sf_dir), "configs")
    parts = [validation.selections(rows, embargo=e).select(F.lit(e).alias("embargo"), "split_id", "selected", "score") for e in EMBARGOES]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


PATHS = f"""{SELECTED}, te AS (SELECT split_id, unnest([g1, g2]) AS grp FROM co), ps AS (SELECT te.grp, se.selected, row_number() OVER (PARTITION BY te.grp ORDER BY te.split_id) AS path FROM te JOIN se USING (split_id)),
    pr AS (SELECT ps.path, gr.date, gr.ret FROM ps JOIN gr ON gr.grp = ps.grp AND gr.config_id = ps.selected WHERE ps.path <= 9)"""


@query(f"WITH {PATHS} SELECT path, count(*) AS n, {r6('avg(ret) / (stddev_pop(ret) + 1e-12) * sqrt(252)', 'sharpe')} FROM pr GROUP BY path")
def cpcv_paths(spark, sf_dir):
    return tidy(validation.path_sharpes(configs(spark, sf_dir)))


@query(f"""WITH {PATHS}, s AS (SELECT path, avg(ret) / (stddev_pop(ret) + 1e-12) * sqrt(252) AS sharpe FROM pr GROUP BY path)
    SELECT count(*) AS n, {r6('min(sharpe)', 'low')}, {r6('median(sharpe)', 'median')}, {r6('max(sharpe)', 'high')}, {r6('quantile_cont(sharpe, 0.05)', 'p5')}, {r6('avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0 END)', 'positive')} FROM s""")
def path_distribution(spark, sf_dir):
    return tidy(metrics.distribution(validation.path_sharpes(configs(spark, sf_dir)), "sharpe"))


def _benchmark(spark, sf_dir):
    return base(spark, sf_dir).groupBy("date").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("bench"))


_CUM = "OVER (PARTITION BY path ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"""WITH {PATHS}, be AS (SELECT date, coalesce(avg(ret), 0) AS bench FROM r GROUP BY date), j AS (SELECT pr.*, be.bench FROM pr JOIN be USING (date)),
    e AS (SELECT *, product(1 + ret) {_CUM} AS es, product(1 + bench) {_CUM} AS eb FROM j), d AS (SELECT *, 1 - es / max(es) {_CUM} AS ds, 1 - eb / max(eb) {_CUM} AS db FROM e)
    SELECT path, {r6('avg(ret) / stddev_pop(ret) * sqrt(252)', 'sharpe_s')}, {r6('max(ds)', 'maxdd_s')}, {r6('(pow(product(1 + ret), 252.0 / count(*)) - 1) / max(ds)', 'calmar_s')},
    {r6('avg(bench) / stddev_pop(bench) * sqrt(252)', 'sharpe_b')}, {r6('max(db)', 'maxdd_b')}, {r6('(pow(product(1 + bench), 252.0 / count(*)) - 1) / max(db)', 'calmar_b')}, {r6('max(db) - max(ds)', 'd_maxdd')} FROM d GROUP BY path""")
def cpcv_paired_paths(spark, sf_dir):
    return tidy(validation.paired_paths(configs(spark, sf_dir), _benchmark(spark, sf_dir)))


@query(f"""WITH {CONFIGS}, gr AS (SELECT *, ntile(10) OVER (PARTITION BY config_id ORDER BY date) AS grp FROM cfg),
    su AS (SELECT config_id, grp, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM gr GROUP BY 1, 2),
    ma AS (SELECT m FROM generate_series(0, 1023) t(m) WHERE bit_count(m) = 5),
    hf AS (SELECT m, config_id, (m >> (grp - 1)) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM su, ma GROUP BY 1, 2, 3),
    sc AS (SELECT m, config_id, inside, s / n / (sqrt(greatest(q / n - pow(s / n, 2), 0)) + 1e-12) AS sr FROM hf),
    pv AS (SELECT m, config_id, max(CASE WHEN inside = 1 THEN sr END) AS a, max(CASE WHEN inside = 0 THEN sr END) AS b FROM sc GROUP BY 1, 2),
    be AS (SELECT *, first_value(b) OVER (PARTITION BY m ORDER BY a DESC, config_id) AS bb FROM pv),
    rk AS (SELECT m, least(greatest(count(*) FILTER (WHERE b <= bb) * 1.0 / count(*), 1.0 / (count(*) + 1)), count(*) * 1.0 / (count(*) + 1)) AS rank FROM be GROUP BY m)
    SELECT {r6('avg(CASE WHEN ln(rank / (1 - rank)) < 0 THEN 1.0 ELSE 0 END)', 'pbo')}, count(*) AS splits FROM rk""")
def overfitting_probability(spark, sf_dir):
    return tidy(validation.overfitting_probability(configs(spark, sf_dir)))


@query(sql.study_verdict(GRID_SQL))
def study_verdict(spark, sf_dir):
    """The verdict on the trend study's grid, every vol target x sizing x signal set, as the ledger row of its dataset: it is
    recorded twice and counted once."""
    rows, path = settled(base(spark, sf_dir), "panel"), scratch(spark, "ledger")
    verdict = validation.study_verdict(settled(portfolio.trend_grid(rows), "configs")).withColumnRenamed("config_id", "config")
    verdict = settled(verdict.crossJoin(ledger.fingerprint(rows)).withColumn("trial_id", F.lit("T1")).withColumn("run_ts", F.current_timestamp()), "verdict")
    for _ in range(2):
        ledger.record_trials(verdict, path)
    kept = ledger.read_trials(spark, path).withColumnRenamed("config", "config_id").withColumn("worst_day_e6", 1e6 * F.col("worst_day"))
    return tidy(kept.withColumn("recorded", F.count("*").over(Window.partitionBy("dataset_hash"))).drop("trial_id", "run_ts", "worst_day"))


@query(sql.overlay_gate(LEDGER_SQL, len(OVERLAY_GRID)))
def overlay_gate(spark, sf_dir):
    """The share ledger's configurations of each symbol against holding it."""
    rows = settled(_ledger(spark, sf_dir), "ledger")
    returns = rows.select("symbol", "config_id", "date", F.col("strat_ret").alias("ret"))
    held = base(spark, sf_dir).select("symbol", "date", F.coalesce("ret", F.lit(0.0)).alias("bench"))
    return tidy(validation.overlay_verdict(returns, held, len(OVERLAY_GRID)))


# --- provenance --------------------------------------------------------------------------------------------------

HASHED = f"""{BARS}, rh AS (SELECT date_trunc('month', date) AS month, sha256(concat_ws('|', CAST(date AS varchar), symbol, CAST(CAST(round(close * 1e6) AS bigint) AS varchar))) AS h FROM bars),
    bh AS (SELECT month, substring(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM rh GROUP BY 1, 2), mh AS (SELECT month, sha256(string_agg(h, '' ORDER BY p)) AS h FROM bh GROUP BY month), dh AS (SELECT sha256(concat_ws('|', '2', '', string_agg(h, '' ORDER BY month))) AS dataset_hash FROM mh)"""


@query(f"WITH {HASHED} SELECT dataset_hash FROM dh")
def dataset_fingerprint(spark, sf_dir):
    return ledger.fingerprint(daily_bars(spark, sf_dir))


#: The bars and a series that fails its checks: AF's, with every price at -5.
BUILT = f"""{BARS}, raw AS (SELECT symbol, date, close FROM bars UNION ALL SELECT 'ZZ', date, -5e0 FROM bars WHERE symbol = 'AF'), bad AS (SELECT symbol FROM raw GROUP BY 1 HAVING count(*) FILTER (WHERE close <= 0 OR close IS NULL) > 0 OR count(*) > count(DISTINCT date)),
    ok AS (SELECT * FROM raw WHERE symbol NOT IN (SELECT symbol FROM bad)), un AS (SELECT d.date, s.symbol, ok.close FROM (SELECT DISTINCT date FROM ok) d CROSS JOIN (SELECT DISTINCT symbol FROM ok) s LEFT JOIN ok ON ok.date = d.date AND ok.symbol = s.symbol),
    rh AS (SELECT date_trunc('month', date) AS month, sha256(concat_ws('|', CAST(date AS varchar), symbol, coalesce(CAST(CAST(round(close * 1e6) AS bigint) AS varchar), ''))) AS h FROM un),
    bh AS (SELECT month, substring(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM rh GROUP BY 1, 2), mh AS (SELECT month, sha256(string_agg(h, '' ORDER BY p)) AS h FROM bh GROUP BY month), dh AS (SELECT sha256(concat_ws('|', '2', '', string_agg(h, '' ORDER BY month))) AS dataset_hash FROM mh)"""


def _built(spark, sf_dir):
    rows = daily_bars(spark, sf_dir)
    bad = rows.filter("symbol = 'AF'").select(F.lit("ZZ").alias("symbol"), "date", *[F.lit(-5.0).alias(c) for c in ("close", "high", "low")], "volume")
    return build.build_panel(rows.unionByName(bad))


@query(f"""WITH {BUILT}, pr AS (SELECT count(*) AS n FROM (SELECT date FROM ok GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM ok)))
    SELECT (SELECT string_agg(symbol, ',' ORDER BY symbol) FROM (SELECT DISTINCT symbol FROM ok)) AS symbols, (SELECT string_agg(symbol, ',' ORDER BY symbol) FROM bad) AS failed, count(DISTINCT date) AS rows,
    CAST(min(date) AS varchar) AS first, CAST(max(date) AS varchar) AS last, (SELECT n FROM pr) AS all_present_rows, (SELECT count(*) FROM bad) = 0 AS passed, (SELECT dataset_hash FROM dh) AS dataset_hash FROM ok""")
def build_panel(spark, sf_dir):
    """The whole build over the bars and a bad series: its manifest."""
    return tidy(_built(spark, sf_dir)[2].withColumns({"symbols": F.array_join("symbols", ","), "failed": F.array_join("failed", ",")}))


@query(f"""WITH {BUILT} SELECT symbol, CAST(date AS varchar) AS date, {r6('close', 'close')}, {r6('1e6 * (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1)', 'ret_e6')}, (SELECT dataset_hash FROM dh) AS dataset_hash
    FROM un WHERE symbol <> 'RF' AND date IN (SELECT date FROM un WHERE close IS NOT NULL AND symbol <> 'RF' GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) - 1 FROM un))""")
def stored_panel(spark, sf_dir):
    """The built panel written by symbol and read again without one of them, on the dates that all others have, with the
    hash that was stored beside it."""
    path = scratch(spark, "stored-panel")
    bars.write_panel(_built(spark, sf_dir)[0], path)
    return tidy(bars.read_panel(spark, path, drop=("RF",)).select("symbol", "date", "close", e6("ret")).crossJoin(F.broadcast(bars.stored_hash(spark, path))))


@query(f"""WITH {BUILT} SELECT symbol, CAST(date AS varchar) AS date, {r6('close', 'close')} FROM un""")
def wide_panel(spark, sf_dir):
    """The built panel's closes as a wide CSV, a column a symbol, and read back."""
    path = scratch(spark, "wide-panel")
    built = settled(_built(spark, sf_dir)[0], "panel")
    bars.write_panel(built, path, wide=sorted(r["symbol"] for r in built.select("symbol").distinct().collect()))
    return tidy(bars.read_wide(spark, path))


def _files(spark, sf_dir) -> DataFrame:
    rows = daily_bars(spark, sf_dir)
    return rows.select("symbol", F.col("date").cast("timestamp").alias("ts"), F.col("close").alias("open"), "high", "low", "close", "volume")


@query(f"WITH {BARS} SELECT symbol, strftime(date, '%Y-%m-%d 00:00:00') AS ts, {r6('close', 'open')}, {r6('high', 'high')}, {r6('low', 'low')}, {r6('close', 'close')}, volume AS tickvol, CAST(0 AS bigint) AS vol, CAST(0 AS bigint) AS spread FROM bars")
def bar_files(spark, sf_dir):
    """The bars as canonical bar files, one folder a symbol, and read back."""
    path = scratch(spark, "bar-files")
    bars.write_bar_files(_files(spark, sf_dir), path)
    return tidy(bars.read_bar_files(spark, f"{path}/*", symbol=_folder()))


@query(f"WITH {BARS} SELECT symbol, strftime(date, '%Y-%m-%d 00:00:00') AS ts, {r6('high', 'high')}, {r6('low', 'low')}, {r6('close', 'close')}, {r6('volume', 'volume')} FROM bars")
def vendor_files(spark, sf_dir):
    """The bars as vendor files of both delimiters and two header shapes, and read back: dates that can't be read go."""
    path = _vendor_files(spark, sf_dir)
    out = bars.read_vendor_files(spark, f"{path}/*/*", symbol=_folder())
    return tidy(out.select("symbol", "ts", "high", "low", "close", "volume"))


def _folder():
    """A file's symbol where files lie in a folder a symbol."""
    return F.element_at(F.split(F.element_at(F.split("_metadata.file_path", "/"), -2), "="), -1)


def _vendor_files(spark, sf_dir) -> str:
    path, rows = scratch(spark, "vendor-files"), settled(_files(spark, sf_dir), "bars")
    day = F.date_format("ts", "yyyy-MM-dd")
    comma = rows.filter("symbol < 'B'").select("symbol", day.alias("Date"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Adj Close"), F.col("volume").alias("Volume"))
    tab = rows.filter("symbol >= 'B'").select("symbol", F.date_format("ts", "yyyy.MM.dd").alias("<DATE>"), F.lit("00:00:00").alias("<TIME>"), F.col("high").alias("<HIGH>"), F.col("low").alias("<LOW>"), F.col("close").alias("<CLOSE>"), F.col("volume").alias("<VOL>"))
    odd = comma.filter("symbol = 'AF'").withColumn("Date", F.lit("1999-02-31"))
    bad = comma.filter("symbol = 'AF'").withColumn("symbol", F.lit("XX")).drop("Adj Close")
    for name, df, sep in (("comma", comma.unionByName(odd), ","), ("tab", tab, "\t"), ("bad", bad, ",")):
        df.repartition("symbol").write.option("header", True).option("sep", sep).partitionBy("symbol").csv(f"{path}/{name}")
    return path


@query(f"""WITH {BUILT}, q AS ({ORACLE_SQL["qc_report"]}) SELECT (SELECT string_agg(symbol, ',' ORDER BY symbol) FROM (SELECT DISTINCT symbol FROM ok)) AS symbols, 'XX' AS failed,
    (SELECT string_agg(concat(symbol, ':', status), ',' ORDER BY symbol) FROM (SELECT symbol, status FROM q UNION ALL SELECT 'XX', 'FAIL')) AS qc, (SELECT count(DISTINCT symbol) + 1 FROM ok) AS n_files, count(DISTINCT date) AS rows, false AS passed, (SELECT dataset_hash FROM dh) AS dataset_hash FROM ok""")
def build_from_files(spark, sf_dir):
    """The build from vendor files, one of them without a close: its manifest."""
    out = build.build_from_files(spark, f"{_vendor_files(spark, sf_dir)}/*/*", _folder())[2]
    qc_list = F.array_join(F.transform("qc", lambda x: F.concat(x["symbol"], F.lit(":"), x["status"])), ",")
    return tidy(out.select(F.array_join("symbols", ",").alias("symbols"), F.array_join("failed", ",").alias("failed"), qc_list.alias("qc"), F.size("files").alias("n_files"), "rows", "passed", "dataset_hash"))


@query(f"WITH {BARS} SELECT CAST(date AS varchar) AS date, symbol, 'EQ' AS series, {r6('high', 'high')}, {r6('close', 'close')}, {r6('volume', 'volume')} FROM bars WHERE symbol = 'NO'")
def daily_files(spark, sf_dir):
    """Exchange daily files, one a year in each dialect by turns, and one instrument's series read from them."""
    path, rows = scratch(spark, "daily-files"), _files(spark, sf_dir).withColumn("series", F.lit("EQ")).withColumn("y", F.year("ts"))
    for d, odd, text in ((bars.MODERN, 0, F.date_format("ts", "yyyy-MM-dd")), (bars.LEGACY, 1, F.upper(F.date_format("ts", "dd-MMM-yyyy")))):
        part = rows.filter(F.col("y") % 2 == odd)
        part = part.select(text.alias(d["date"]), *[F.col(c).alias(d[c]) for c in ("symbol", "series", *bars.PRICES, "volume")], "y")
        part.repartition("y").write.option("header", True).partitionBy("y").csv(f"{path}/{odd}")
    return tidy(bars.one_series(bars.read_daily_files(spark, f"{path}/*/*/*.csv"), "NO").select("date", "symbol", "series", "high", "close", "volume"))


@query(f"""WITH {TICKS}, q AS (SELECT *, CAST(1 + n % 7 AS double) AS spread FROM hour), z AS (SELECT symbol, time_bucket(INTERVAL 1 DAY, ts) AS ts, arg_max(close, ts) AS close, max(high) AS high, min(low) AS low, avg(spread) AS spread, 1e6 * avg(spread * 1e-2 / close) AS rel_spread_e6 FROM q GROUP BY 1, 2)
    SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r6('close', 'close')}, {r6('high', 'high')}, {r6('low', 'low')}, {r6('spread', 'spread')}, {r6('rel_spread_e6', 'rel_spread_e6')} FROM z""")
def resample_daily(spark, sf_dir):
    """Hourly bars to days: the coarser bars with their mean spread, and the daily closes' mean relative spread beside them."""
    rows = settled(hourly(spark, sf_dir).withColumn("spread", (1 + F.col("n") % 7).cast("double")), "hourly")
    days = panel.daily(rows, F.try_divide(F.col("spread") * F.lit(0.01), F.col("close"))).select("symbol", F.col("date").cast("timestamp").alias("ts"), F.col("close").alias("day_close"), (1e6 * F.col("rel_spread")).alias("rel_spread_e6"))
    return tidy(panel.resample_bars(rows, "1 day").join(days, ["symbol", "ts"]).filter("close = day_close").drop("day_close"))


@query(f"""WITH {TICKS} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r6('close', 'close')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS date) ORDER BY ts DESC) AS k FROM hour) WHERE k = 1""")
def last_bar_per_date(spark, sf_dir):
    return tidy(panel.last_per_date(hourly(spark, sf_dir).withColumn("date", F.to_date("ts"))).select("symbol", "ts", "close"))


@query()
def dataset_manifest(spark, sf_dir):
    """The bars' manifest with the digests of the raw files that they come from, of any size."""
    rows = settled(daily_bars(spark, sf_dir), "bars")
    digests = bars.file_digests(spark, f"{sf_dir}/lineitem.parquet").withColumn("path", F.element_at(F.split("path", "/"), -1))
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("_metadata.file_name").alias("path")).agg(F.count("*").alias("n_rows"))
    out = ledger.manifest(rows, qc.qc_report(rows), digests.join(counts, "path", "left"), ledger.fingerprint(rows))
    return out.select("rows", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), F.to_json("symbols").alias("symbols"), "all_present_rows", F.to_json("files").alias("files"), F.to_json("file_rows").alias("file_rows"), F.to_json("qc").alias("qc"), "passed", "dataset_hash")


@query(f"""WITH {BARS}, {ACTIONS_SQL}, rh AS (SELECT date_trunc('month', date) AS month, sha256(concat_ws('|', CAST(date AS varchar), symbol, CAST(CAST(round(close * 1e6) AS bigint) AS varchar))) AS h FROM bars),
    bh AS (SELECT month, substring(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM rh GROUP BY 1, 2), mh AS (SELECT month, sha256(string_agg(h, '' ORDER BY p)) AS h FROM bh GROUP BY month),
    ac AS (SELECT sha256(concat('[', string_agg(concat('{{"ex_date":"', CAST(ex_date AS varchar), '","price_div":', CAST(price_div AS double), ',"symbol":"', symbol, '","vol_mult":', CAST(vol_mult AS double), '}}'), ',' ORDER BY ex_date, price_div, symbol), ']')) AS acts FROM acts)
    SELECT sha256(concat_ws('|', '2', max(acts), string_agg(h, '' ORDER BY month))) AS dataset_hash FROM mh, ac""")
def adjusted_fingerprint(spark, sf_dir):
    """The fingerprint with the corporate actions' digest in it."""
    return ledger.fingerprint(daily_bars(spark, sf_dir), _actions(spark))


TRIALS = [("T1", "2024-01-01", "A", 12, "PASS"), ("T2", "2024-01-02", "A", 12, "REJECT"), ("T3", "2024-01-03", "B", 0, "REJECT"), ("T4", "2024-01-04", "C", 0, "STALE"), ("T5", "2024-01-05", "C", 64, "PASS")]
TRIALS_SQL = "tl(trial_id, run_ts, config, keep, status) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {k}, '{s}')" for a, b, c, k, s in TRIALS) + ")"


def _trials(spark, current):
    """Trials whose stored hash is the start of the current one, or (keep 0) of another dataset's."""
    rows = spark.createDataFrame(TRIALS, "trial_id string, run_ts string, config string, keep int, status string").crossJoin(current)
    return rows.select("trial_id", "run_ts", "config", F.when(F.col("keep") > 0, F.expr("substring(dataset_hash, 1, keep)")).otherwise("none").alias("dataset_hash"), "status")


_STORED = f"{HASHED}, {TRIALS_SQL}, st AS (SELECT tl.*, CASE WHEN keep > 0 THEN substring(dataset_hash, 1, keep) ELSE 'none' END AS stored, dataset_hash FROM tl, dh)"


_FIRST = f"{_STORED}, fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, stored ORDER BY run_ts, trial_id) AS k FROM st) WHERE k = 1)"


def _recorded(spark, sf_dir):
    """The trials as the ledger has them after two runs of the same job, and the current fingerprint."""
    path, current = scratch(spark, "ledger"), settled(ledger.fingerprint(daily_bars(spark, sf_dir)), "current")
    for _ in range(2):
        ledger.record_trials(_trials(spark, current), path)
    return ledger.read_trials(spark, path), current


@query(f"""WITH {_FIRST}, ac AS (SELECT * FROM fs WHERE status <> 'STALE') SELECT trial_id, config, CASE WHEN starts_with(dataset_hash, stored) THEN '' ELSE 'hash mismatch' END AS problem,
    (SELECT count(*) FROM ac) AS slots, (SELECT count(*) FROM ac) > 20 AS over_budget FROM ac""")
def ledger_check(spark, sf_dir):
    return ledger.ledger_check(*_recorded(spark, sf_dir))


@query(f"WITH {_FIRST} SELECT trial_id, config, stored AS dataset_hash, status FROM fs")
def distinct_trials(spark, sf_dir):
    return _recorded(spark, sf_dir)[0].select("trial_id", "config", "dataset_hash", "status")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A momentum portfolio on the three-symbol panel, sized by lagged trailing deviation, and its metrics."""
    rows = panel.with_returns(panel.common_history(settled(walked(daily_bars(spark, sf_dir, symbol=("l_returnflag",))), "walked")))
    w = series("symbol")
    rows = rows.withColumn("_s", roll.momentum("close", w, (21, 63))).withColumn("_v", rolling(F.stddev_samp, "ret", w, 20))
    rows = rows.withColumn("pos", F.coalesce(F.try_divide(F.lag("_s").over(w), F.lag("_v").over(w)), F.lit(0.0)) * 0.001).withColumn("config_id", F.lit("trend"))
    return metrics.performance(portfolio.portfolio_returns(rows, ("config_id",)))
