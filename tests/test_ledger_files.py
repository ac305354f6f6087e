"""Trials recorded once, whatever runs again; files that can't be read; runs of missing files that halt a job."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException

from panelspark.operators import build, ledger, qc
from panelspark.sources import bars

DAY = dt.date(2024, 1, 1)
TRIALS = "trial_id string, run_ts string, config string, dataset_hash string, status string, dsr double"


def test_trials_are_recorded_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([("T1", "2024-01-01", "A", "h1", "PASS", 0.97), ("T0", "2024-01-02", "A", "h1", "REJECT", 0.1)], TRIALS)
    ledger.record_trials(one, path)
    ledger.record_trials(one, path)
    later = spark.createDataFrame([("T2", "2025-01-01", "A", "h1", "REJECT", 0.2), ("T3", "2025-01-01", "A", "h2", "REJECT", 0.3), ("T4", "2025-01-02", None, None, "STALE", None)], TRIALS)
    ledger.record_trials(later, path)
    (tmp_path / "ledger" / "_staging-broken" / "slot=x").mkdir(parents=True)  # what a job that broke off leaves
    got = {r["trial_id"]: r for r in ledger.read_trials(spark, path).collect()}
    assert set(got) == {"T1", "T3", "T4"} and got["T1"]["dsr"] == 0.97 and got["T4"]["config"] is None
    assert ledger.ledger_check(ledger.read_trials(spark, path), spark.createDataFrame([("h2",)], "dataset_hash string")).count() == 2


def test_two_jobs_record_the_same_trial_at_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [spark.createDataFrame([(f"T{k}", "2024-01-01", "A", "h", "PASS", float(k))], TRIALS) for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda df: ledger.record_trials(df, path), rows))
    assert ledger.read_trials(spark, path).count() == 1


def test_files_that_cannot_be_read(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "aaa_D1.csv").write_text("Date,Close\n" + "".join(f"{DAY + dt.timedelta(k)},{100 + k}\n" for k in range(20)))
    (folder / "bbb_D1.csv").write_text('<DATE>\t<TIME>\t<CLOSE>\t<VOL>\n' + "".join(f"{DAY + dt.timedelta(k):%Y.%m.%d}\t00:00:00\t{50 + k}\t7\n" for k in range(20)))
    (folder / "ccc_D1.csv").write_text('Datetime,Open,Close,Adj Close\n2024-01-02 10:30:00,1,2,"3"\n\n2024-13-45,1,1,1\n')
    (folder / "ddd_D1.csv").write_text("Date,Open\n2024-01-02,1\n")
    (folder / "eee_D1.csv").write_text("Close,Open\n1,1\n")
    (folder / "fff_D1.csv").write_text("")
    (folder / "ggg_D1.csv").write_text(",".join(["Date", "Close", *[f"c{k}" for k in range(70)]]) + "\n2024-01-02,1\n")
    issues = {r["symbol"]: r["issue"] for r in bars.load_errors(spark, str(folder)).collect()}
    assert issues == {"DDD": "no CLOSE column", "EEE": "no DATE or DATETIME column", "FFF": "empty file", "GGG": "more than 64 columns"}
    rows = {(r["symbol"], r["ts"]): r for r in bars.read_vendor_files(spark, str(folder)).collect()}
    assert len(rows) == 41 and rows["CCC", dt.datetime(2024, 1, 2, 10, 30)]["close"] == 3 and rows["BBB", dt.datetime(2024, 1, 3)]["volume"] == 7
    plan = bars.read_vendor_files(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 2  # the lines and, of the same files, the headers, whatever their number
    panel, report, manifest = build.build_from_files(spark, str(folder))
    m = manifest.first()
    assert m["symbols"] == ["AAA", "BBB", "CCC"] and m["failed"] == ["DDD", "EEE", "FFF", "GGG"] and not m["passed"] and len(m["files"]) == 7
    assert {r["symbol"]: r["status"] for r in report.collect()}["DDD"] == "FAIL" and {q["symbol"] for q in m["qc"]} == set("AAA BBB CCC DDD EEE FFF GGG".split())
    again = build.build_from_files(spark, str(folder))[2].first()
    assert again["dataset_hash"] == m["dataset_hash"]


def test_a_run_of_missing_files_halts(spark):
    files = lambda *days: spark.createDataFrame([(DAY + dt.timedelta(d),) for d in days], "date date")
    rows = spark.createDataFrame([("A", DAY, 1.0)], "symbol string, date date, close double")
    # 1 January 2024 is a Monday; four weekdays may be missing, over a weekend too, five may not
    assert qc.halting(rows, "2024-01-01", "2024-01-12", files(0, 1, 2, 7, 8, 9, 10, 11)).count() == 1
    assert qc.halting(rows, "2024-01-01", "2024-01-12", files(0, 1, 2, 9, 10, 11)).count() == 1
    with pytest.raises(PySparkException, match="5 weekdays without a file from 2024-01-04"):
        qc.halting(rows, "2024-01-01", "2024-01-12", files(0, 1, 2, 10, 11)).collect()
    with pytest.raises(PySparkException, match="8 weekdays"):
        qc.halting(rows, "2024-01-01", "2024-01-12", files(10, 11)).collect()


def test_small_report(spark):
    rows = [("A", DAY + dt.timedelta(k), p) for k, p in enumerate([1.0, 1.0, 3.0, None, 2.0, 2.0])] + [("A", DAY, 1.0)]
    r = qc.quick_report(spark.createDataFrame(rows, "symbol string, date date, close double")).first()
    assert (r["n_rows"], r["dup"], r["missing"], r["nonpos"], r["largest_move"]) == (7, 1, 1, 0, 2.0) and r["zero_returns"] == 3
