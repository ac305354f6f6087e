"""DuckDB SQL of the registered queries that follow a state from row to row, or judge configurations.

Each function gives common table expressions, to be put behind those that they read. Numbers with an exponent are doubles
in DuckDB; plain ones are decimals.
"""

from __future__ import annotations

from panelspark.functions.normal import EULER_GAMMA


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def quantiles(trials: int) -> float:
    """What the best of `trials` standard normal values is expected to be."""
    import math
    from statistics import NormalDist

    return (1 - EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / trials) + EULER_GAMMA * NormalDist().inv_cdf(1 - 1 / (trials * math.e))


def normal_cdf(x: str) -> str:
    """Simpson's rule for the normal density from 0 to x on 2,000 intervals."""
    return f"(0.5 + ({x}) / 2000 / 3 * (SELECT sum(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(({x}) * k / 2000.0, 2) / 2)) FROM generate_series(0, 2000) t(k)) / sqrt(2 * pi()))"


def recursive_mean(source: str, column: str, span: int, name: str) -> str:
    """symbol, i, v: the recursive average, written out as a weighted sum over all rows so far."""
    a = 2 / (span + 1)
    return f"{name} AS (SELECT t.symbol, t.i, sum(pow({1 - a!r}, t.i - s.i) * CASE WHEN s.i = 0 THEN 1e0 ELSE {a!r} END * s.{column}) AS v FROM {source} t JOIN {source} s ON s.symbol = t.symbol AND s.i <= t.i GROUP BY 1, 2)"


def leg_features(rows: int, span: int, name: str, source: str = "leg") -> str:
    """symbol, i, ts, a, high, low, z, trend, width of leg (symbol, i, ts, a, b, high, low)."""
    w = f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"""{name}_s AS (SELECT *, a - CASE WHEN count(*) OVER w = {rows} THEN avg(a / b) OVER w END * b AS spread FROM {source} WINDOW w AS {w}),
    {name} AS MATERIALIZED (SELECT x.symbol, x.i, x.ts, x.a, x.high, x.low, t.v AS trend,
        CASE WHEN count(spread) OVER w = {rows} THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS z,
        CASE WHEN count(*) OVER r = 14 THEN avg(high - low) OVER r END AS width
        FROM {name}_s x JOIN trend t ON t.symbol = x.symbol AND t.i = x.i WINDOW w AS (PARTITION BY x.symbol ORDER BY x.i ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW), r AS (PARTITION BY x.symbol ORDER BY x.i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""


def leg_trades(features: list[str], grid: list[tuple], bid_ask: str = "5e-2") -> str:
    """trades (symbol, config_id, trade_no, ts, bars, reason, sgn, gross_pts, net_pts, r): every row that may open a trade
    finds the row that would close it and the next one that may open; a trade then leads to the next. The last item of a
    configuration tells which features it uses."""
    configs = ", ".join(f"('{c}', {e:e}, {s:e}, {m:e}, {w}, {k})" for c, e, s, m, w, k in grid)
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM {f}" for k, f in enumerate(features))
    return f"""cf(config_id, entry, stop, mult, warmup, k) AS (VALUES {configs}), fe AS MATERIALIZED (SELECT * FROM ({every}) WHERE z IS NOT NULL AND width > 0),
    en AS MATERIALIZED (SELECT *, a - side * far AS level FROM (SELECT fe.*, cf.config_id, cf.stop, cf.warmup, width * mult AS far,
        CASE WHEN z < -entry AND a > trend THEN 1 WHEN z > entry AND a < trend THEN -1 ELSE 0 END AS side FROM fe JOIN cf USING (k) WHERE i > warmup) WHERE side <> 0),
    ot AS (SELECT e.config_id, e.symbol, e.i, min(x.i) AS exit_i FROM en e JOIN fe x ON x.k = e.k AND x.symbol = e.symbol AND x.i > e.i
        AND ((side = 1 AND x.low <= level) OR (side = -1 AND x.high >= level) OR abs(x.z) >= e.stop OR side * x.z >= 0) GROUP BY 1, 2, 3),
    nx AS MATERIALIZED (SELECT o.config_id, o.symbol, o.i, o.exit_i, min(n.i) AS next_i FROM ot o LEFT JOIN en n ON n.config_id = o.config_id AND n.symbol = o.symbol AND n.i > o.exit_i GROUP BY 1, 2, 3, 4),
    ch AS (SELECT nx.*, 1 AS trade_no FROM nx JOIN (SELECT config_id, symbol, min(i) AS i FROM en GROUP BY 1, 2) f USING (config_id, symbol, i)
        UNION ALL SELECT nx.*, ch.trade_no + 1 FROM ch JOIN nx ON nx.config_id = ch.config_id AND nx.symbol = ch.symbol AND nx.i = ch.next_i),
    ca AS (SELECT ch.*, en.a AS opened, en.side, en.far, en.level, en.stop, x.ts, x.a AS price, x.z, CASE WHEN (side = 1 AND x.low <= level) OR (side = -1 AND x.high >= level) THEN 'SL' WHEN abs(x.z) >= en.stop THEN 'ALGO' ELSE 'TGT' END AS reason
        FROM ch JOIN en ON en.config_id = ch.config_id AND en.symbol = ch.symbol AND en.i = ch.i JOIN fe x ON x.k = en.k AND x.symbol = ch.symbol AND x.i = ch.exit_i),
    trades AS MATERIALIZED (SELECT symbol, config_id, trade_no, ts, exit_i - i AS bars, reason, side AS sgn, g AS gross_pts, g - {bid_ask} AS net_pts, (g - {bid_ask}) / far AS r FROM (SELECT *, side * (CASE WHEN reason = 'SL' THEN level ELSE price END - opened) AS g FROM ca))"""


#: summary: the statistics of trades in risk units.
SUMMARY = """dr AS (SELECT *, max(eq) OVER (PARTITION BY symbol, config_id ORDER BY trade_no) - eq AS dd FROM (SELECT *, sum(r) OVER (PARTITION BY symbol, config_id ORDER BY trade_no) AS eq FROM trades)),
    rm AS (SELECT symbol, config_id, avg(r) AS m, var_pop(r) AS v FROM trades GROUP BY 1, 2),
    rs AS (SELECT symbol, config_id, CASE WHEN max(v) > 0 THEN avg(pow(r - m, 3)) / pow(max(v), 1.5) ELSE 0 END AS skew, CASE WHEN max(v) > 0 THEN avg(pow(r - m, 4)) / pow(max(v), 2) - 3 ELSE -3 END AS kurt FROM trades JOIN rm USING (symbol, config_id) GROUP BY 1, 2),
    rk AS (SELECT symbol, config_id, count(*) AS trades, 100 * avg(CASE WHEN r > 0 THEN 1e0 ELSE 0 END) AS win, avg(r) AS avg_r, median(r) AS med_r, sum(r) AS sum_r, sum(r) * 1.5e-2 * 100 AS ret_pct, greatest(max(dd), 0) * 1.5e-2 * 100 AS maxdd_pct,
        coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) AS sr_trade, greatest(floor((epoch(max(ts)) - epoch(min(ts))) / 86400), 1) AS days, 100 * avg(CASE WHEN reason = 'SL' THEN 1e0 ELSE 0 END) AS sl_pct,
        100 * avg(CASE WHEN reason = 'TGT' THEN 1e0 ELSE 0 END) AS tgt_pct, 100 * avg(CASE WHEN reason = 'ALGO' THEN 1e0 ELSE 0 END) AS algo_pct, 100 * avg(CASE WHEN sgn = 1 THEN 1e0 ELSE 0 END) AS long_pct FROM dr GROUP BY 1, 2),
    summary AS (SELECT *, sr_trade * sqrt(trades / (days / 365.0)) AS sr_ann, trades / days AS tpd FROM rk JOIN rs USING (symbol, config_id))"""
SUMMARY_COLUMNS = ("win", "avg_r", "med_r", "sum_r", "ret_pct", "maxdd_pct", "skew", "kurt", "sr_trade", "sr_ann", "tpd", "sl_pct", "tgt_pct", "algo_pct", "long_pct")


def summary_columns() -> str:
    return "symbol, config_id, trades, " + ", ".join(r6(c, c) for c in SUMMARY_COLUMNS)


def share_ledger(grid: list[tuple[int, int, float]], capital: float = 1e5, max_cost_ratio: float = 5e-3) -> str:
    """expo and ledger (symbol, config_id, i, date, equity, cost, pos_frac, strat_ret) from r (symbol, i, date, close, ret),
    vol (symbol, i, v) and a recursive mean mN for each span N: whole shares, row after row."""
    spans = sorted({s for f, s, _ in grid} | {f for f, _, _ in grid})
    sides = " UNION ALL ".join(
        f"SELECT symbol, i, date, close, '{f:03d}/{s:03d}/{t}' AS config_id, greatest(least(coalesce(greatest(tanh((m{f} - m{s}) / nullif(sd, 0)), 0) * ({t:e} / nullif(vol, 0)), 0), 1), 0) AS want, sd FROM fx" for f, s, t in grid
    )
    buy, sell = "{v} * 3.17e-5 * 1.18e0 + {v} * 1.5e-4", "{v} * 3.17e-5 * 1.18e0 + ({v} * 1e-5 + 13e0 * 1.18e0)"
    fits = lambda k: f"(cash - ({k}) * p - ({buy.format(v=f'(({k}) * p)')}) >= 0)"
    return f"""fx AS (SELECT r.symbol, r.i, r.date, r.close, vol.v AS vol, {", ".join(f"m{s}.v AS m{s}" for s in spans)}, CASE WHEN count(r.close) OVER w = 63 THEN stddev_samp(r.close) OVER w END AS sd
        FROM r LEFT JOIN vol USING (symbol, i) {" ".join(f"JOIN m{s} USING (symbol, i)" for s in spans)} WINDOW w AS (PARTITION BY r.symbol ORDER BY r.i ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
    expo AS MATERIALIZED (SELECT symbol, i, date, close, config_id, CASE WHEN sd IS NULL THEN 0 ELSE want END AS want FROM ({sides})),
    st AS (SELECT symbol, config_id, CAST(-1 AS bigint) AS i, CAST(NULL AS date) AS date, 0e0 AS shares, {capital:e} AS cash, CAST(NULL AS double) AS equity, 0e0 AS cost, CAST(NULL AS double) AS before FROM expo WHERE i = 0
        UNION ALL
        SELECT symbol, config_id, i, date, shares + move, cash - (move * p + cost), cash - (move * p + cost) + (shares + move) * p, cost, equity FROM (
            SELECT * REPLACE (CASE WHEN move <> 0 AND NOT cost > {max_cost_ratio:e} * (abs(move) * p) THEN move ELSE 0 END AS move, CASE WHEN move <> 0 AND NOT cost > {max_cost_ratio:e} * (abs(move) * p) THEN cost ELSE 0 END AS cost) FROM (
                SELECT *, CASE WHEN move < 0 THEN {sell.format(v='(abs(move) * p)')} ELSE {buy.format(v='(abs(move) * p)')} END AS cost FROM (
                    SELECT * EXCLUDE (n), CASE WHEN wanted > 0 THEN least(wanted, CASE WHEN {fits('n + 1')} THEN n + 1 WHEN n = 0 OR {fits('n')} THEN n ELSE n - 1 END) ELSE wanted END AS move FROM (
                        SELECT x.symbol, x.config_id, x.i, x.date, x.close AS p, st.shares, st.cash, st.equity, floor(x.want * (st.cash + st.shares * x.close) / x.close) - st.shares AS wanted, greatest(0, floor(st.cash / ({buy.format(v='x.close')} + x.close))) AS n
                        FROM st JOIN expo x ON x.symbol = st.symbol AND x.config_id = st.config_id AND x.i = st.i + 1))))),
    ledger AS MATERIALIZED (SELECT symbol, config_id, i, date, equity, cost, (equity - cash) / equity AS pos_frac, CASE WHEN before IS NULL THEN 0 ELSE equity / before - 1 END AS strat_ret FROM st WHERE i >= 0)"""


COMBOS = "co AS (SELECT row_number() OVER (ORDER BY a.g, b.g) - 1 AS split_id, a.g AS g1, b.g AS g2 FROM generate_series(1, 10) a(g) JOIN generate_series(1, 10) b(g) ON a.g < b.g)"


def out_of_sample(source: str) -> str:
    """se (key, split_id, selected, score), ps and pr (key, path, date, ret) of source (key, config_id, date, ret)."""
    late = "NOT (rn > {e}.last AND rn <= {e}.last + floor(t * 0.01))"
    return f"""{COMBOS}, gr AS (SELECT *, ntile(10) OVER w AS grp, row_number() OVER w AS rn, count(*) OVER (PARTITION BY key, config_id) AS t FROM {source} WINDOW w AS (PARTITION BY key, config_id ORDER BY date)),
    lg AS (SELECT key, grp, max(rn) AS last FROM gr GROUP BY 1, 2),
    sc AS (SELECT gr.key, split_id, config_id, avg(ret) / (stddev_pop(ret) + 1e-12) AS score FROM gr CROSS JOIN co JOIN lg e1 ON e1.key = gr.key AND e1.grp = g1 JOIN lg e2 ON e2.key = gr.key AND e2.grp = g2
        WHERE gr.grp NOT IN (g1, g2) AND {late.format(e='e1')} AND {late.format(e='e2')} GROUP BY 1, 2, 3 HAVING count(*) >= 50),
    se AS (SELECT key, split_id, config_id AS selected, score FROM (SELECT *, row_number() OVER (PARTITION BY key, split_id ORDER BY score DESC, config_id) AS k FROM sc) WHERE k = 1),
    te AS (SELECT split_id, unnest([g1, g2]) AS grp FROM co), ps AS (SELECT se.key, te.grp, se.selected, row_number() OVER (PARTITION BY se.key, te.grp ORDER BY te.split_id) AS path FROM te JOIN se USING (split_id)),
    pr AS (SELECT ps.key, ps.path, gr.date, gr.ret FROM ps JOIN gr ON gr.key = ps.key AND gr.grp = ps.grp AND gr.config_id = ps.selected WHERE ps.path <= 9)"""


def deflated(source: str, trials: int, name: str = "dsr") -> str:
    """dsr (key, config_id, sr, sr0, sd) of source (key, config_id, ret)."""
    return f"""{name}_m AS (SELECT key, config_id, count(*) AS n, avg(ret) AS m, var_pop(ret) AS v FROM {source} GROUP BY 1, 2),
    {name}_s AS (SELECT s.key, s.config_id, avg(pow(ret - m, 3)) / pow(max(v), 1.5) AS g3, avg(pow(ret - m, 4)) / pow(max(v), 2) AS g4, max(m) / sqrt(max(v)) AS sr, max(n) AS n FROM {source} s JOIN {name}_m USING (key, config_id) GROUP BY 1, 2),
    {name} AS (SELECT *, sd * {quantiles(trials)!r} AS sr0 FROM (SELECT *, sqrt((1 - g3 * sr + (g4 - 1) / 4 * sr * sr) / (n - 1)) AS sd FROM {name}_s))"""


_CUM = "OVER (PARTITION BY key, path ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def overlay_gate(ledger_sql: str, trials: int) -> str:
    return f"""{ledger_sql}, lr AS MATERIALIZED (SELECT symbol AS key, config_id, date, strat_ret AS ret FROM ledger), {out_of_sample('lr')},
    jb AS (SELECT pr.*, coalesce(r.ret, 0) AS bench FROM pr JOIN r ON r.symbol = pr.key AND r.date = pr.date),
    je AS (SELECT *, product(1 + ret) {_CUM} AS es, product(1 + bench) {_CUM} AS eb FROM jb), jd AS (SELECT *, 1 - es / max(es) {_CUM} AS ds, 1 - eb / max(eb) {_CUM} AS db FROM je),
    sv AS (SELECT key, path, max(db) - max(ds) AS saved FROM jd GROUP BY 1, 2),
    sm AS (SELECT key, count(*) AS paths, median(saved) AS saved_median, quantile_cont(saved, 0.05) AS saved_p5, avg(CASE WHEN saved > 0 THEN 1e0 ELSE 0 END) AS saved_share FROM sv GROUP BY 1),
    be AS (SELECT key, config_id FROM (SELECT key, config_id, row_number() OVER (PARTITION BY key ORDER BY coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) DESC, config_id) AS k FROM lr GROUP BY 1, 2) WHERE k = 1),
    bs AS (SELECT lr.* FROM lr JOIN be USING (key, config_id)), {deflated('bs', trials)}
    SELECT key AS symbol, config_id, {r6('sr', 'sr')}, {r6('sr0', 'sr0')}, {r6(normal_cdf('(sr - sr0) / sd'), 'dsr')}, paths, {r6('saved_median', 'saved_median')}, {r6('saved_p5', 'saved_p5')}, {r6('saved_share', 'saved_share')},
    CASE WHEN saved_p5 > 0 THEN 'PASS' ELSE 'FAIL' END AS mandate FROM dsr JOIN sm USING (key)"""


def shrunk_windows(rows: int, every: int) -> str:
    """wr and cov (window_id, i, j, cov, delta) of each rebalance window over the returns of r (symbol, i, date, ret)."""
    return f"""wd AS (SELECT k * {every} + {rows} AS window_id, r.symbol, r.date, r.ret FROM r JOIN (SELECT unnest(range(0, (SELECT (max(i) - {rows}) // {every} FROM r) + 1)) AS k) ON r.i >= k * {every} AND r.i < k * {every} + {rows} WHERE r.ret IS NOT NULL),
    wn AS (SELECT window_id FROM wd GROUP BY 1 HAVING count(DISTINCT date) >= {rows // 2}),
    wr AS MATERIALIZED (SELECT window_id, symbol, date, ret - avg(ret) OVER (PARTITION BY window_id, symbol) AS x FROM wd WHERE window_id IN (SELECT window_id FROM wn)),
    mm AS MATERIALIZED (SELECT a.window_id, a.symbol AS i, b.symbol AS j, count(*) AS t, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS s22, avg(a.x * a.x * a.x * b.x) AS s31, avg(a.x * b.x * b.x * b.x) AS s13 FROM wr a JOIN wr b USING (window_id, date) GROUP BY 1, 2, 3),
    mv AS (SELECT window_id, i AS k, s AS v FROM mm WHERE i = j),
    mn AS (SELECT mm.*, vi.v AS vi, vj.v AS vj, mm.s / sqrt(vi.v * vj.v) AS corr, s22 - s * s AS pi, CASE WHEN i <> j THEN sqrt(vj.v / vi.v) * (s31 - vi.v * s) + sqrt(vi.v / vj.v) * (s13 - vj.v * s) ELSE 0 END AS rho
        FROM mm JOIN mv vi ON vi.window_id = mm.window_id AND vi.k = mm.i JOIN mv vj ON vj.window_id = mm.window_id AND vj.k = mm.j),
    mg AS (SELECT window_id, avg(corr) FILTER (WHERE i <> j) AS rbar, sum(pi) AS pi_sum, sum(pi) FILTER (WHERE i = j) AS pi_diag, sum(rho) AS rho_sum, max(t) AS rows FROM mn GROUP BY 1),
    mf AS (SELECT mn.*, mg.* EXCLUDE (window_id), CASE WHEN i <> j THEN rbar * sqrt(vi * vj) ELSE s END AS target FROM mn JOIN mg USING (window_id)),
    md AS (SELECT window_id, greatest(least((max(pi_sum) - max(pi_diag) - max(rbar) / 2 * max(rho_sum)) / sum(pow(target - s, 2)) / max(rows), 1), 0) AS delta FROM mf GROUP BY 1),
    cov AS MATERIALIZED (SELECT window_id, i, j, delta * target + (1 - delta) * s AS cov, delta FROM mf JOIN md USING (window_id))"""


#: wt (symbol, i, date, weight): equal-risk weights of each window, one weight a step, until a whole round moves none by
#: 1e-8; carried forward and known a row later. Reads cov and r.
EQUAL_RISK = """cl AS (SELECT window_id, list(row ORDER BY i) AS c, list(i ORDER BY i) AS names FROM (SELECT window_id, i, list(cov ORDER BY j) AS row FROM cov GROUP BY 1, 2) GROUP BY 1),
    er AS (SELECT window_id, 0 AS step, len(names) AS n, list_transform(names, lambda q: 1e0 / len(names)) AS x, list_transform(names, lambda q: 1e9) AS before FROM cl
        UNION ALL
        SELECT window_id, step + 1, n, list_transform(range(1, n + 1), lambda j: CASE WHEN j = k THEN (sqrt(rest * rest + 4 * c[k][k] * (1e0 / n)) - rest) / (2 * c[k][k]) ELSE x[j] END), CASE WHEN k = 1 THEN x ELSE before END FROM (
            SELECT er.*, cl.c, step % er.n + 1 AS k, list_sum(list_transform(range(1, er.n + 1), lambda j: CASE WHEN j = step % er.n + 1 THEN 0e0 ELSE cl.c[step % er.n + 1][j] * er.x[j] END)) AS rest FROM er JOIN cl USING (window_id)
            WHERE step < 200 * er.n AND NOT (step > 0 AND step % er.n = 0 AND list_max(list_transform(range(1, er.n + 1), lambda j: abs(er.x[j] - er.before[j]))) < 1e-8))),
    ex AS (SELECT window_id, arg_max(x, step) AS x FROM er GROUP BY 1), ew AS (SELECT window_id, unnest(names) AS symbol, unnest(list_transform(x, lambda v: v / list_sum(x))) AS weight FROM ex JOIN cl USING (window_id)),
    wl AS (SELECT r.symbol, r.i, r.date, last_value(ew.weight IGNORE NULLS) OVER (PARTITION BY r.symbol ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight FROM r LEFT JOIN ew ON ew.window_id = r.i AND ew.symbol = r.symbol),
    wt AS (SELECT symbol, i, date, lag(weight) OVER (PARTITION BY symbol ORDER BY i) AS weight FROM wl)"""


def trend_grid(signals: str, sets: dict[str, tuple[str, ...]], targets: dict[str, float]) -> str:
    """grid (config_id, date, ret) from sg (symbol, date, i, ret, tsmom, ewma, bo), vol (symbol, i, v) and wt."""
    w = "OVER (PARTITION BY symbol ORDER BY i)"
    one = lambda chosen: f"lag(greatest(least(({' + '.join(chosen)}) / {len(chosen)}, 1), -1) + 0 * ({' + '.join(chosen)})) {w}"
    parts = " UNION ALL ".join(
        f"SELECT '{size}/{name}' AS c, symbol, date, ret, coalesce({one(chosen)} * {factor} / nullif(lag(vol) {w}, 0), 0) AS expo FROM sv0" for size, factor in (("invvol", "1e0"), ("lw_rp", "weight")) for name, chosen in sets.items()
    )
    values = ", ".join(f"('{k}', {v:e})" for k, v in targets.items())
    return f"""{signals}, sv0 AS MATERIALIZED (SELECT sg.*, vol.v AS vol, wt.weight FROM sg LEFT JOIN vol USING (symbol, i) JOIN wt USING (symbol, i)), xp AS MATERIALIZED ({parts}),
    rw AS (SELECT c, date, coalesce(sum(expo * ret), 0) AS raw FROM xp GROUP BY 1, 2), rd AS (SELECT c, date, CASE WHEN count(raw) OVER w = 30 THEN stddev_samp(raw) OVER w END AS sd FROM rw WINDOW w AS (PARTITION BY c ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    rl AS (SELECT c, date, lag(sd) OVER (PARTITION BY c ORDER BY date) AS sd FROM rd), tg(target_id, target) AS (VALUES {values}),
    grid AS MATERIALIZED (SELECT concat_ws('/', target_id, c) AS config_id, date, coalesce(sum(greatest(least(expo * coalesce(least(target / nullif(sd, 0), 50), 0), 1), -1) * ret), 0) AS ret FROM xp JOIN rl USING (c, date) CROSS JOIN tg GROUP BY 1, 2)"""


def fingerprint(source: str, p: str = "", version: str = "2") -> str:
    """{p}dh (dataset_hash) of source (symbol, date, close)."""
    return f"""{p}rh AS (SELECT date_trunc('month', date) AS month, sha256(concat_ws('|', CAST(date AS varchar), symbol, coalesce(CAST(CAST(round(close * 1e6) AS bigint) AS varchar), ''))) AS h FROM {source}),
    {p}bh AS (SELECT month, substring(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM {p}rh GROUP BY 1, 2), {p}mh AS (SELECT month, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {p}bh GROUP BY month),
    {p}dh AS (SELECT sha256(concat_ws('|', '{version}', '', string_agg(h, '' ORDER BY month))) AS dataset_hash FROM {p}mh)"""


def study_verdict(grid_sql: str, trials: int = 20) -> str:
    return f"""{grid_sql}, {fingerprint('r', 'f_')}, lr AS MATERIALIZED (SELECT 1 AS key, config_id, date, ret FROM grid), {out_of_sample('lr')},
    tp AS (SELECT selected AS config_id, count(*) AS times FROM se GROUP BY 1 ORDER BY 2 DESC, min(split_id) LIMIT 1), bs AS (SELECT lr.* FROM lr JOIN tp USING (config_id)), {deflated('bs', trials)},
    eq AS (SELECT config_id, ret, product(1 + ret) OVER w AS e, max(1e0) OVER w AS one, date FROM bs WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    dw AS (SELECT min(ret) AS worst_day, max(dd) AS maxdd FROM (SELECT ret, 1 - e / max(e) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dd FROM eq)),
    sh AS (SELECT count(*) AS paths, min(s) AS low, median(s) AS mid, max(s) AS high FROM (SELECT avg(ret) / (stddev_pop(ret) + 1e-12) * sqrt(252) AS s FROM pr GROUP BY path)),
    su AS (SELECT config_id, grp, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM gr GROUP BY 1, 2), ma AS (SELECT m FROM generate_series(0, 1023) t(m) WHERE bit_count(m) = 5),
    hf AS (SELECT m, config_id, (m >> (grp - 1)) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM su, ma GROUP BY 1, 2, 3), hs AS (SELECT m, config_id, inside, s / n / (sqrt(greatest(q / n - pow(s / n, 2), 0)) + 1e-12) AS sr FROM hf),
    pv AS (SELECT m, config_id, max(CASE WHEN inside = 1 THEN sr END) AS a, max(CASE WHEN inside = 0 THEN sr END) AS b FROM hs GROUP BY 1, 2), pb AS (SELECT *, first_value(b) OVER (PARTITION BY m ORDER BY a DESC, config_id) AS bb FROM pv),
    pk AS (SELECT m, least(greatest(count(*) FILTER (WHERE b <= bb) * 1.0 / count(*), 1.0 / (count(*) + 1)), count(*) * 1.0 / (count(*) + 1)) AS rank FROM pb GROUP BY m), po AS (SELECT avg(CASE WHEN ln(rank / (1 - rank)) < 0 THEN 1.0 ELSE 0 END) AS pbo FROM pk),
    ve AS (SELECT config_id, times, sr, sr0, {normal_cdf('(sr - sr0) / sd')} AS dsr, worst_day, maxdd, paths, low, mid, high, pbo FROM tp JOIN dsr USING (config_id), dw, sh, po)
    SELECT config_id, times, {r6('sr', 'sr')}, {r6('sr0', 'sr0')}, {r6('dsr', 'dsr')}, {r6('1e6 * worst_day', 'worst_day_e6')}, {r6('maxdd', 'maxdd')}, paths, {r6('low', 'sharpe_low')}, {r6('mid', 'sharpe_median')}, {r6('high', 'sharpe_high')}, {r6('pbo', 'pbo')},
    CASE WHEN dsr > 0.95 AND pbo < 0.05 THEN 'PASS' ELSE 'REJECT' END AS status, dataset_hash, CAST(1 AS bigint) AS recorded FROM ve, f_dh"""


def entry_thresholds(ratio_sql: str) -> str:
    """The best entry on a grid of 400 points and then on 400 around it; erfi by 120 terms of its series."""
    den = "4 / sqrt(pi()) * sum(exp((2 * q + 1) * ln(-a / sqrt(2e0)) - lgamma(q + 1e0)) / (2 * q + 1))"
    best = "arg_min(a, {{'v': CASE WHEN den > 0 THEN -(-2 * a - cost) / den ELSE 1e9 END, 'k': k}}) AS a, min(CASE WHEN den > 0 THEN -(-2 * a - cost) / den ELSE 1e9 END) AS v"
    best = best.replace("{{", "{").replace("}}", "}")
    return f"""WITH {ratio_sql}, fc AS (SELECT pair, median(sd) AS sigma FROM ss GROUP BY 1), cs AS MATERIALIZED (SELECT pair, m AS multiple, 5e-2 / sigma * m AS cost FROM fc, (VALUES (0e0), (1e0), (2e0), (5e0)) t(m)), qs AS (SELECT unnest(range(120)) AS q),
    g0 AS (SELECT k, -4e0 + (-5e-2 - -4e0) * k / 399 AS a FROM (SELECT unnest(range(400)) AS k)), d0 AS MATERIALIZED (SELECT k, a, {den} AS den FROM g0, qs GROUP BY 1, 2), b0 AS MATERIALIZED (SELECT pair, multiple, cost, {best} FROM cs, d0 GROUP BY 1, 2, 3),
    g1 AS (SELECT DISTINCT a AS a0, k, a - 3.95e0 / 400 + (a + 3.95e0 / 400 - (a - 3.95e0 / 400)) * k / 399 AS a FROM b0, (SELECT unnest(range(400)) AS k)), d1 AS MATERIALIZED (SELECT a0, k, a, {den} AS den FROM g1, qs GROUP BY 1, 2, 3),
    b1 AS (SELECT pair, multiple, cost, a0, v0, {best} FROM (SELECT pair, multiple, cost, b0.a AS a0, b0.v AS v0, d1.k, d1.a, d1.den FROM b0 JOIN d1 ON d1.a0 = b0.a) GROUP BY 1, 2, 3, 4, 5)
    SELECT pair, multiple, {r6('cost', 'cost')}, {r6('-(CASE WHEN v < v0 THEN a ELSE a0 END)', 'entry')} FROM b1"""
