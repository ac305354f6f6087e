import datetime as dt
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from panelspark.operators import validation

DAY = dt.date(2020, 1, 1)


def drawdown(ret):
    equity = (1 + pd.Series(ret)).cumprod()
    return float((1 - equity / equity.cummax()).max())


def verdict(r, bench, trials):
    """The verdict of one symbol in pandas. r: rows x configurations."""
    groups, emb = np.array_split(np.arange(len(r)), 10), int(len(r) * 0.01)
    ratio = lambda x: x.mean(0) / (x.std(0) + 1e-12)
    chosen, seen = {}, {g: [] for g in range(10)}
    for c in combinations(range(10), 2):
        bad = set(np.concatenate([groups[g] for g in c])) | {groups[g][-1] + 1 + e for g in c for e in range(emb)}
        chosen[c] = int(np.argmax(ratio(r[[i for i in range(len(r)) if i not in bad]])))
        for g in c:
            seen[g].append(chosen[c])
    saved = [drawdown(bench) - drawdown(np.concatenate([r[groups[g], seen[g][p]] for g in range(10)])) for p in range(9)]
    best = int(np.argmax(r.mean(0) / r.std(0, ddof=1)))
    x = pd.Series(r[:, best])
    z = (x - x.mean()) / x.std(ddof=0)
    sr, n, nd = x.mean() / x.std(ddof=0), len(x), NormalDist()
    sd = np.sqrt((1 - (z**3).mean() * sr + ((z**4).mean() - 1) / 4 * sr * sr) / (n - 1))
    euler = 0.5772156649
    sr0 = sd * ((1 - euler) * nd.inv_cdf(1 - 1 / trials) + euler * nd.inv_cdf(1 - 1 / (trials * np.e)))
    return f"c{best}", sr, sr0, nd.cdf((sr - sr0) / sd), len(saved), np.median(saved), np.percentile(saved, 5), np.mean(np.array(saved) > 0), "PASS" if np.percentile(saved, 5) > 0 else "FAIL"


def test_a_verdict_for_each_symbol_against_pandas(spark):
    rng = np.random.default_rng(12)
    bench = {"A": rng.standard_normal(260) * 0.02, "B": rng.standard_normal(307) * 0.01}
    r = {"A": rng.standard_normal((260, 4)) * 0.006 + 0.0005, "B": rng.standard_normal((307, 4)) * 0.02}
    rows = [(s, f"c{j}", DAY + dt.timedelta(i), float(v)) for s, x in r.items() for i, row in enumerate(x) for j, v in enumerate(row)]
    held = [(s, DAY + dt.timedelta(i), float(v)) for s, x in bench.items() for i, v in enumerate(x)]
    returns = spark.createDataFrame(rows, "symbol string, config_id string, date date, ret double")
    out = validation.overlay_verdict(returns, spark.createDataFrame(held, "symbol string, date date, bench double"), 8)
    got = {x["symbol"]: tuple(x)[1:] for x in out.collect()}
    assert sorted(got) == ["A", "B"] and {x[-1] for x in got.values()} == {"PASS", "FAIL"}
    for s in r:
        want = verdict(r[s], bench[s], 8)
        assert (got[s][0], got[s][4], got[s][-1]) == (want[0], want[4], want[-1])
        assert got[s][1:8] == pytest.approx(want[1:8], abs=1e-6)
