import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from panelspark.operators import trades
from panelspark.plans import registry

START = dt.datetime(2024, 1, 1)


def backtest(d, entry, mult, rows, span, warmup):
    """Net over risk of each trade, in pandas."""
    ratio = (d.a / d.b).rolling(rows).mean()
    spread = d.a - ratio * d.b
    z = ((spread - spread.rolling(rows).mean()) / spread.rolling(rows).std()).to_numpy()
    trend, width = d.a.ewm(span=span, adjust=False).mean().to_numpy(), (d.high - d.low).rolling(14).mean().to_numpy()
    out, held = [], None
    for i in range(warmup + 1, len(d)):
        if not (np.isfinite(z[i]) and width[i] > 0):
            continue
        p = d.a[i]
        if held is None:
            side = 1 if z[i] < -entry and p > trend[i] else -1 if z[i] > entry and p < trend[i] else 0
            held = (side, p, width[i] * mult) if side else None
            continue
        side, at, far = held
        level = at - side * far
        if (side == 1 and d.low[i] <= level) or (side == -1 and d.high[i] >= level):
            leave = level
        elif abs(z[i]) >= 3 or side * z[i] >= 0:
            leave = p
        else:
            continue
        out.append((side * (leave - at) - 0.01) / far)
        held = None
    return np.array(out)


def test_sweep_over_windows_against_pandas(spark):
    assert len({x[0] for x in registry.SWEEP_GRID}) == 27 and {(x[1], x[3], x[5]) for x in registry.SWEEP_GRID} == {(z, m, k) for z in (1.5, 2.0, 2.5) for m in (2.5, 3.5, 5.0) for k in (40, 60, 90)}
    rng, n, data = np.random.default_rng(8), 3000, {}
    for s in ("P", "Q"):
        b = 100 + rng.standard_normal(n).cumsum() * 0.3
        a = b + rng.standard_normal(n) * 0.3
        data[s] = pd.DataFrame({"a": a, "b": b, "high": a + rng.random(n), "low": a - rng.random(n)})
    rows = [(s, START + dt.timedelta(minutes=15 * i), *map(float, r), 0.01) for s, d in data.items() for i, r in enumerate(d.to_numpy())]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, a double, b double, high double, low double, bid_ask double")
    grid = [(f"z{z}/w{k}", z, 3.0, 2.5, 120, k) for z in (1.5, 2.0, 2.8) for k in (40, 90)]
    configs = spark.createDataFrame(grid, "config_id string, entry double, stop double, range_mult double, warmup int, rows int")
    done = trades.leg_trades(trades.leg_features(bars, trades.SingleLeg(trend_span=60), windows=(40, 90)), configs)
    got = trades.sweep_ranking(trades.risk_summary(done), 27, top=3).orderBy("symbol", "rank").toPandas()
    nd, euler, few = NormalDist(), 0.5772156649, 0
    for s, d in data.items():
        r = {c: backtest(d, z, m, k, 60, w) for c, z, _, m, w, k in grid}
        few += sum(len(x) < 30 for x in r.values())
        want = sorted((c for c in r if len(r[c]) >= 30), key=lambda c: (-r[c].sum(), c))[:3]
        mine = got[got.symbol == s].reset_index(drop=True)
        assert mine.config_id.tolist() == want and mine.trades.tolist() == [len(r[c]) for c in want]
        np.testing.assert_allclose(mine.sum_r, [r[c].sum() for c in want], rtol=1e-6)
        x = r[want[0]]
        z, sr = (x - x.mean()) / x.std(), x.mean() / x.std()
        sd = np.sqrt((1 - (z**3).mean() * sr + ((z**4).mean() - 1) / 4 * sr * sr) / (len(x) - 1))
        sr0 = sd * ((1 - euler) * nd.inv_cdf(1 - 1 / 27) + euler * nd.inv_cdf(1 - 1 / (27 * np.e)))
        assert (mine.sr0[0], mine.dsr[0]) == pytest.approx((sr0, nd.cdf((sr - sr0) / sd)), abs=1e-6)
        assert mine.dsr[1:].isna().all()
    assert few
