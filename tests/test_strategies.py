import datetime as dt
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from panelspark.functions.normal import erfi, inverse_normal, normal_cdf
from panelspark.operators import metrics, portfolio, trades, validation
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)


def long(spark, matrix):
    rows = [(f"c{j}", DAY + dt.timedelta(i), float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "config_id string, date date, ret double")


def test_normal_functions(spark):
    df = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999)], "p double")
    for r in df.select("p", normal_cdf(inverse_normal(F.col("p"))).alias("q"), erfi(F.lit(0.5) + F.col("p") * 0).alias("e")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=1e-8)
        assert r["e"] == pytest.approx(0.6149520946965110, abs=1e-6)


def test_shrinkage_and_equal_risk(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 4))
    rows = [(0, DAY + dt.timedelta(i), f"s{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    got = portfolio.shrunk_covariance(spark.createDataFrame(rows, "window_id long, date date, symbol string, ret double")).toPandas()
    z = x - x.mean(0)
    s = z.T @ z / len(z)
    sd = np.sqrt(np.diag(s))
    n = len(s)
    rbar = ((s / np.outer(sd, sd)).sum() - n) / (n * (n - 1))
    target = rbar * np.outer(sd, sd)
    np.fill_diagonal(target, np.diag(s))
    products = z[:, :, None] * z[:, None, :] - s
    pi = (products**2).mean(0)
    theta = (products[:, range(n), range(n)][:, :, None] * products).mean(0)
    ratio = sd[None, :] / sd[:, None]
    off = ~np.eye(n, dtype=bool)
    rho = np.trace(pi) + rbar / 2 * (ratio * theta + ratio.T * theta.T)[off].sum()
    delta = np.clip((pi.sum() - rho) / ((target - s) ** 2).sum() / len(z), 0, 1)
    assert got["delta"].iloc[0] == pytest.approx(delta, abs=1e-9)
    cov = got.pivot(index="i", columns="j", values="cov").to_numpy()
    np.testing.assert_allclose(cov, delta * target + (1 - delta) * s, atol=1e-9)
    w = portfolio.equal_risk_weights(cov)
    assert w.sum() == pytest.approx(1)
    np.testing.assert_allclose(w * (cov @ w), (w @ cov @ w) / n, rtol=1e-4)


def test_pair_trades_against_pandas(spark):
    rng = np.random.default_rng(4)
    n, k = 400, 20
    b = 100 + rng.standard_normal(n).cumsum() * 0.1
    a = b * 0.5 + rng.standard_normal(n) * 0.2 + 50
    rows = [("P", "A", "B", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), float(a[i]), float(b[i]), 2.0, 3.0) for i in range(n)]
    legs = spark.createDataFrame(rows, "pair string, sym_a string, sym_b string, ts timestamp, a double, b double, spread_a double, spread_b double")
    specs = spark.createDataFrame([("A", 0.01, 2.0, 1.0), ("B", 0.1, 1.0, 0.0)], "symbol string, point double, mult double, comm_rt double")
    got = trades.pair_trades(legs, specs, rows=k).orderBy("trade_no").toPandas()
    la, lb = pd.Series(np.log(a)), pd.Series(np.log(b))
    beta = la.rolling(k).cov(lb, ddof=0) / lb.rolling(k).var(ddof=0)
    rest = la - beta * lb
    z = (rest - rest.rolling(k).mean()) / rest.rolling(k).std()
    want, at = [], None
    for i in range(k + 1, n):
        if np.isnan(z[i]):
            continue
        if at is None:
            at = i if abs(z[i]) > 2 and beta[i] > 0 else None
        elif abs(z[i]) < 0.4 or abs(z[i]) > 3.2:
            qa, qb = 25000 / (2 * a[at]), beta[at] * 25000 / b[at]
            gross = -np.sign(z[at]) * (qa * 2 * (a[i] - a[at]) - qb * (b[i] - b[at]))
            want.append((i - at, gross, qa * (2 * 0.01 * 2 + 1) + qb * 3 * 0.1))
            at = None
    assert len(want) > 5 and len(got) == len(want)
    np.testing.assert_allclose(got[["bars", "gross", "fric"]].to_numpy(float), np.array(want), rtol=1e-6)
    summary = trades.pair_summary(trades.pair_trades(legs, specs, rows=k)).first()
    assert summary["trades"] == len(want) and summary["net_total"] == pytest.approx(sum(g - f for _, g, f in want))


def test_share_ledger_invariants(spark):
    rng = np.random.default_rng(2)
    price = 100 * np.exp(rng.standard_normal(400).cumsum() * 0.01)
    want = np.clip(rng.random(400), 0, 1)
    rows = [("S", c, DAY + dt.timedelta(i), float(p), float(e)) for c in ("x", "y") for i, (p, e) in enumerate(zip(price, want, strict=True))]
    got = trades.share_ledger(spark.createDataFrame(rows, "symbol string, config_id string, date date, close double, exposure double"), capital=5000).orderBy("config_id", "date").toPandas()
    one = got[got.config_id == "x"].reset_index(drop=True)
    assert len(got) == 800 and (one.equity * (1 - one.pos_frac) >= -1e-6).all() and (one.cost >= 0).all()
    shares = (one.equity * one.pos_frac / price).to_numpy()
    np.testing.assert_allclose(shares, np.round(shares), atol=1e-6)
    assert one.strat_ret[1:].to_numpy() == pytest.approx((one.equity / one.equity.shift() - 1)[1:].to_numpy())
    assert all(trades.affordable(c, p) == max(k for k in range(200) if c - k * p - (trades.trade_cost(k * p, False) if k else 0) >= 0) for c, p in [(1000, 33.3), (50, 60), (999.99, 9.99)])


def test_state_survives_batches(spark):
    price = [100.0 + i for i in range(50)]
    df = spark.createDataFrame([("S", "c", DAY + dt.timedelta(i), p, 0.5) for i, p in enumerate(price)], "symbol string, config_id string, date date, close double, exposure double")
    whole = trades.share_ledger(df).orderBy("date").toPandas()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pd.testing.assert_frame_equal(whole, trades.share_ledger(df).orderBy("date").toPandas())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_splits(spark):
    rows = spark.createDataFrame([(i, DAY + dt.timedelta(i), DAY + dt.timedelta(i + 3)) for i in range(100)], "row long, date date, label_end date")
    got = validation.combinatorial_splits(rows, 6, 2, 3).toPandas()
    assert got.split_id.nunique() == 15 and validation.n_paths(6, 2) == 5
    per = got[got.role == "test"].groupby("split_id").row.apply(set)
    train = got[got.role == "train"].groupby("split_id").row.apply(set)
    assert all(not (per[s] & train[s]) for s in per.index)
    assert got[got.role == "test"].groupby("row").size().eq(5).all()
    fold = validation.purged_kfold(rows, 5, 4).toPandas()
    first = fold[fold.fold == 2]
    assert first[first.role == "test"].row.tolist() == list(range(20, 40)) and set(first[first.role == "purged"].row) == {17, 18, 19, *range(40, 47)}


def test_selection_and_overfitting_against_numpy(spark):
    r = np.random.default_rng(5).standard_normal((203, 4)) * 0.01
    groups = np.array_split(np.arange(len(r)), 10)
    emb = int(len(r) * 0.02)
    ratio = lambda x: x.mean(0) / (x.std(0) + 1e-12)
    want = {}
    for s, c in enumerate(combinations(range(10), 2)):
        bad = set(np.concatenate([groups[g] for g in c])) | {groups[g][-1] + 1 + e for g in c for e in range(emb)}
        want[s] = f"c{int(np.argmax(ratio(r[[i for i in range(len(r)) if i not in bad]])))}"
    df = long(spark, r)
    assert {x["split_id"]: x["selected"] for x in validation.selections(df, embargo=0.02).collect()} == want
    low = []
    for c in combinations(range(10), 5):
        ins, outs = (np.concatenate([groups[g] for g in range(10) if (g in c) == side]) for side in (True, False))
        o = ratio(r[outs])
        rank = min(max((o <= o[np.argmax(ratio(r[ins]))]).sum() / 4, 1 / 5), 4 / 5)
        low.append(np.log(rank / (1 - rank)) < 0)
    assert validation.overfitting_probability(df).first()["pbo"] == pytest.approx(np.mean(low))


def test_deflated_sharpe_falls_with_trials(spark):
    df = long(spark, np.random.default_rng(6).standard_normal((300, 1)) * 0.01 + 0.001)
    got = [metrics.deflated_sharpe(df, k).first()["dsr"] for k in (1, 10, 100)]
    assert got[0] > got[1] > got[2]


def test_entry_threshold_grows_with_cost(spark):
    got = trades.entry_thresholds(spark.createDataFrame([("P", 0.1)], "pair string, cost double")).orderBy("multiple").collect()
    entries = [r["entry"] for r in got]
    assert entries == sorted(entries) and 0.03 <= entries[0] and entries[-1] < 4
