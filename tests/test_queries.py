import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pandas.api.types import is_float_dtype

import __spark_entry__ as entry
from panelspark.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["daily_bars_view", "resample_hourly", "qc_report", "calendar_gaps", "corporate_action_adjust", "transaction_costs", "dataset_fingerprint"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.register(t, pq.read_table(f"{SF}/{t}.parquet"))
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_matches_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


#: Path-dependent trades and ledgers, validation, scans, files and records: those with a state or a rule of their own.
STATEFUL = [
    "pair_trades", "single_leg_trades", "share_ledger", "parameter_sweep", "purged_kfold", "cpcv_splits", "cpcv_selection", "cpcv_selection_embargoes", "cpcv_paths", "cpcv_paired_paths", "overfitting_probability",
    "ewm_vol", "ewma_crossover", "vendor_files", "build_from_files", "stored_panel", "wide_panel", "ledger_check", "distinct_trials", "quick_report", "missing_files", "rolling_beta_zscore", "deflated_sharpe",
]


@pytest.mark.parametrize("name", STATEFUL)
def test_stateful_query_matches_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols and len(got) == len(want)
    numbers = [c for c in cols if is_float_dtype(got[c]) or is_float_dtype(want[c])]
    texts = [c for c in cols if c not in numbers]
    a, b = (x.assign(**{c: x[c].astype(str) for c in texts}).sort_values([*texts, *numbers]).reset_index(drop=True) for x in (got, want))
    assert a[texts].equals(b[texts])
    for c in numbers:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=2e-6)


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
