"""Row numbers, as-of positions and decayed sums over ranges, against loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import positions
from panelspark.operators import validation
from panelspark.operators.rolling import ewm


@pytest.fixture()
def series_(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i * 3 + k, None if rng.random() < 0.1 else float(rng.standard_normal())) for k, n in ((0, 3000), (1, 40), (2, 1)) for i in range(n)]
    rows += [(3, i, None) for i in range(5)]
    return rows, spark.createDataFrame(rows, "symbol long, date long, x double").repartition(5)


def test_row_numbers(spark, series_):
    rows, df = series_
    got = {(r["symbol"], r["date"]): r["row"] for r in positions.numbered(df, "date", keys=("symbol",)).collect()}
    assert got == {(k, t): i for k in range(4) for i, t in enumerate(sorted(t for s, t, _ in rows if s == k))}
    one = positions.numbered(df.filter("symbol = 0"), "date")
    assert [r["row"] for r in one.orderBy("date").collect()] == list(range(3000))
    assert positions.numbered(df.limit(0), "date").count() == 0
    plan = one._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_as_of_positions(spark):
    points = spark.createDataFrame([(10 * i, i) for i in range(200)], "t long, row long").repartition(4)
    bounds = spark.createDataFrame([(k, t) for k, t in enumerate([-1, 0, 5, 10, 999, 1990, 5000])], "fold int, at long")
    got = {r["fold"]: r["last"] for r in positions.as_of(points, "t", "row", bounds, "at", "last").collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 1, 4: 99, 5: 199, 6: 199}
    assert positions.as_of(points.limit(0), "t", "row", bounds.limit(1), "at", "last").collect()[0]["last"] is None


@pytest.mark.parametrize("block,bits", [(256, 8), (4, 2), (1, 1)])
def test_ewm_over_blocks_groups_and_groups_of_groups(spark, series_, monkeypatch, block, bits):
    """Small blocks and groups make every level of the scan do its work; a missing row ages the weights."""
    from panelspark.operators import rolling

    monkeypatch.setattr(positions, "BITS", bits)
    monkeypatch.setattr(rolling, "EWM_BLOCK", block)
    rows, df = series_
    got = ewm(df, "x", {"m": ("mean", 10), "v": ("sd", 30), "r": ("rec", 5)}).toPandas().sort_values(["symbol", "date"])
    for k, part in got.groupby("symbol"):
        x = part.x.astype(float).reset_index(drop=True)
        assert np.allclose(part.m.astype(float), x.ewm(span=10).mean(), atol=1e-9, equal_nan=True)
        assert np.allclose(part.v.astype(float), x.ewm(span=30).std(), atol=1e-9, equal_nan=True)
        if x.notna().all():
            assert np.allclose(part.r, x.ewm(span=5, adjust=False).mean(), atol=1e-9)


def test_a_long_key(spark):
    """Two million rows of one key: blocks, groups and groups of groups, in tasks that hold a range at most."""
    df = spark.range(2_000_000).select(F.lit("a").alias("symbol"), F.col("id").alias("date"), F.sin(F.col("id") * 0.7).alias("x"))
    got = ewm(df, "x", {"m": ("mean", 64.0)}).filter("date % 50000 = 49999").orderBy("date").toPandas()
    want = pd.Series(np.sin(np.arange(2_000_000) * 0.7)).ewm(span=64).mean()
    assert np.allclose(got.m, want[got.date], atol=1e-9)


@pytest.mark.parametrize("embargo", [0.0, 0.01, 0.1, 0.3])
def test_selections_under_any_embargo(spark, embargo):
    """Against rows that are dropped one by one."""
    rng = np.random.default_rng(9)
    t, n, k = 203, 10, 2
    returns = {c: rng.standard_normal(t) * 0.01 for c in ("a", "b", "c", "d")}
    df = spark.createDataFrame([(c, i, float(r)) for c, x in returns.items() for i, r in enumerate(x)], "config_id string, date long, ret double")
    got = {r["split_id"]: (r["selected"], r["score"]) for r in validation.selections(df, n, k, embargo).collect()}
    groups = np.array_split(np.arange(t), n)
    emb, want = int(t * embargo), {}
    from itertools import combinations

    for s, test in enumerate(combinations(range(n), k)):
        train = np.ones(t, bool)
        for g in test:
            train[groups[g]] = False
            train[groups[g][-1] + 1 : groups[g][-1] + 1 + emb] = False
        if train.sum() >= validation.LEAST_TRAIN:
            score = {c: x[train].mean() / (x[train].std() + 1e-12) for c, x in returns.items()}
            best = max(score, key=score.get)
            want[s] = (best, score[best])
    assert {s: c for s, (c, _) in got.items()} == {s: c for s, (c, _) in want.items()}
    assert all(got[s][1] == pytest.approx(want[s][1]) for s in want)


def test_normal_and_erfi_columns(spark):
    """Without a Python worker, against the standard library and a fine Simpson rule."""
    import math
    from statistics import NormalDist

    from panelspark.functions.normal import erfi, normal_cdf

    xs = [-40.0, -9.5, -6.0, -5.999, -3.3, -1e-9, 0.0, 0.5, 2.0, 4.7, 5.9999, 6.1, 12.0]
    df = spark.createDataFrame([(x,) for x in [*xs, None, float("nan")]], "x double").select("x", normal_cdf(F.col("x")).alias("p"), erfi(F.col("x") / 5).alias("e"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert [r["p"] for r in rows[-2:]] == [None, None] and [r["e"] for r in rows[-2:]] == [None, None]
    for r in rows[:-2]:
        x = r["x"]
        want = 0.5 * math.erfc(-x / math.sqrt(2))
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-300) and abs(r["p"] - NormalDist().cdf(x)) < 1e-9
        v, n = x / 5, 20_000
        t = np.linspace(0, v, n + 1)
        w = np.where(np.arange(n + 1) % 2, 4.0, 2.0)
        w[[0, -1]] = 1
        assert r["e"] == pytest.approx(2 / math.sqrt(math.pi) * v / n / 3 * float((w * np.exp(t * t)).sum()), rel=1e-9, abs=1e-15)


def test_moments_from_slabs_and_symbol_blocks(spark, monkeypatch):
    """More symbols than a block, returns missing here and there, rows in any order: as from whole windows."""
    from panelspark.operators import portfolio

    monkeypatch.setattr(portfolio, "BLOCK_SYMBOLS", 3)
    rng = np.random.default_rng(7)
    rows = [(f"s{k}", i, None if i == 0 or rng.random() < 0.05 else float(rng.standard_normal() * 0.01 + 0.5 * k)) for k in range(8) for i in range(130)]
    panel = spark.createDataFrame(rows, "symbol string, date long, ret double").repartition(5)
    keys = ["window_id", "i", "j"]
    got = portfolio.rebalance_moments(panel, 60, 20).toPandas().sort_values(keys).reset_index(drop=True)
    want = portfolio.moments(portfolio.rebalance_windows(panel, 60, 20)).toPandas().sort_values(keys).reset_index(drop=True)
    assert got[[*keys, "t"]].equals(want[[*keys, "t"]]) and set(got.window_id) == {60, 80, 100, 120}
    for c in ("s", "s22", "s31", "s13"):
        np.testing.assert_allclose(got[c], want[c], rtol=1e-8, atol=1e-16)
    assert portfolio.rebalance_moments(panel.limit(0), 60, 20).count() == 0


@pytest.mark.parametrize("rows,chunk", [(20, 1000), (20, 64), (20, 7), (5, 1), (1, 3)])
def test_rolling_windows_in_chunks(spark, monkeypatch, rows, chunk):
    """Chunks longer and shorter than what windows look back to, missing values, a missing key, keys of one row: as whole keys give it."""
    from panelspark.operators import rolling

    rng = np.random.default_rng(5)
    data = [(k, i * 2, None if rng.random() < 0.01 else float(rng.uniform(1, 2)), float(rng.uniform(1, 2)), i) for k, n in (("x", 700), ("y", 90), ("z", 1), (None, 150)) for i in range(n)]
    df = spark.createDataFrame(data, "pair string, ts long, a double, b double, extra long").repartition(5)
    seen = []
    plain = positions.chunked
    for f in (rolling.spread_zscore, rolling.ratio_zscore):
        monkeypatch.setattr(positions, "CHUNK", 1 << 20)
        want = f(df, rows).toPandas()
        monkeypatch.setattr(positions, "CHUNK", chunk)

        def watched(d, keys, order, halo, build, rows=None):
            def counted(part, by):
                seen.append((part.groupBy(*by).count().agg(F.max("count")).first()[0], halo))
                return build(part, by)

            return plain(d, keys, order, halo, counted, rows)

        monkeypatch.setattr(rolling, "chunked", watched)
        got = f(df, rows).toPandas()
        monkeypatch.setattr(rolling, "chunked", plain)
        assert list(got.columns) == list(want.columns)
        a, b = (x.fillna({"pair": ""}).sort_values(["pair", "ts"]).reset_index(drop=True) for x in (got, want))
        assert len(a) == len(data) and a.pair.equals(b.pair) and a.extra.equals(b.extra)
        for c in ("z", "beta" if "beta" in a else "spread"):
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, equal_nan=True) and (rows == 1 or a[c].notna().sum() > 100)
    assert all(n <= (chunk + halo if chunk < 700 else 700) for n, halo in seen)
    monkeypatch.setattr(positions, "CHUNK", chunk)
    assert rolling.spread_zscore(df.limit(0), rows).count() == 0
