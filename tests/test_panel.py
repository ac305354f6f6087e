import datetime as dt
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.windows import series
from panelspark.operators import adjust, ledger, panel, qc
from panelspark.operators.rolling import breakout, drawdowns, ewm, momentum
from panelspark.sources import bars
from panelspark.streaming.bars import streaming_resample

DAY = dt.date(2024, 1, 1)


def frame(spark, closes, symbol="A", start=DAY):
    rows = [(symbol, start + dt.timedelta(i), None if c is None else float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


def test_ewm_equals_pandas_over_blocks_and_gaps(spark):
    rng = np.random.default_rng(0)
    x = 5000 + rng.standard_normal(700).cumsum()
    x[:3], x[50], x[300:303] = np.nan, np.nan, np.nan
    s = pd.Series(x)
    df = frame(spark, [None if np.isnan(v) else v for v in x])
    got = ewm(df, "close", {"m": ("mean", 8), "r": ("rec", 20), "d": ("sd", 30)}).orderBy("date").toPandas()
    pd.testing.assert_series_equal(got["m"], s.ewm(span=8).mean(), check_names=False, rtol=1e-9)
    pd.testing.assert_series_equal(got["d"], s.ewm(span=30).std(), check_names=False, rtol=1e-6)
    whole = pd.Series(x).dropna().reset_index(drop=True)
    rec = ewm(frame(spark, list(whole)), "close", {"r": ("rec", 20)}).orderBy("date").toPandas()["r"]
    pd.testing.assert_series_equal(rec, whole.ewm(span=20, adjust=False).mean(), check_names=False, rtol=1e-9)


def test_no_lookahead(spark):
    x = list(100 + np.random.default_rng(1).standard_normal(120).cumsum())
    w = series("symbol")
    signal = lambda df: column(df.withColumn("s", momentum("close", w, (5, 20))).withColumn("b", breakout("close", w, (10,))).select("symbol", "date", F.struct("s", "b").alias("v")), "v")
    assert signal(frame(spark, x))[:80] == signal(frame(spark, x[:80]))


def test_common_history_and_forward_fill(spark):
    df = frame(spark, [1, 2, 3, 4], "A").unionByName(frame(spark, [5, 6], "B", DAY + dt.timedelta(1)))
    assert panel.common_history(df).select("date").distinct().count() == 2
    filled = panel.forward_filled(df)
    assert column(filled.filter("symbol = 'B'"), "close") == [5, 6, 6]


def test_resample_and_stream_agree(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, 0, m), float(m)) for m in range(0, 60, 7)] + [("A", dt.datetime(2024, 1, 2), 1.0)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double")
    batch = panel.resample(ticks, "15 minutes").orderBy("ts").collect()
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    stream = streaming_resample(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")), "15 minutes")
    q = stream.writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("bars").orderBy("ts").collect() == batch[: spark.table("bars").count()] and spark.table("bars").count() >= 4


def test_qc_statuses(spark):
    good = frame(spark, [100 + i for i in range(10)], "GOOD")
    bad = frame(spark, [1, -5, 2], "BAD")
    stale = frame(spark, [7.0] * 8, "STALE")
    twice = frame(spark, [1, 2], "TWICE").unionByName(frame(spark, [1], "TWICE"))
    got = {r["symbol"]: r for r in qc.qc_report(good.unionByName(bad).unionByName(stale).unionByName(twice)).collect()}
    assert (got["GOOD"]["status"], got["BAD"]["status"], got["STALE"]["status"], got["TWICE"]["status"]) == ("OK", "FAIL", "WARN", "FAIL")
    assert got["STALE"]["stale"] == 5 and got["TWICE"]["dup"] == 1
    kept = qc.passing(good.unionByName(bad), qc.qc_report(good.unionByName(bad)))
    assert {r["symbol"] for r in kept.select("symbol").distinct().collect()} == {"GOOD"}


def test_split_adjustment(spark):
    rows = [("2019-12-17", 1210.0, 100000.0), ("2019-12-18", 1220.0, 110000.0), ("2019-12-19", 122.0, 1000000.0), ("2019-12-20", 122.5, 1050000.0)]
    df = spark.createDataFrame([("X", *r) for r in rows], "symbol string, date string, close double, volume double").withColumn("date", F.to_date("date"))
    acts = spark.createDataFrame([("X", dt.date(2019, 12, 19), 10.0, 10.0), ("X", dt.date(2019, 12, 18), 2.0, 2.0)], adjust.ACTIONS)
    got = adjust.adjusted(df, acts).orderBy("date").collect()
    assert [r["close"] for r in got] == [60.5, 122.0, 122.0, 122.5]
    assert got[0]["volume"] == 2_000_000
    assert adjust.residual_jumps(df, acts, "2019-01-01", "2020-01-01").count() == 1


def test_missing_weekdays(spark):
    days = [DAY + dt.timedelta(i) for i in (0, 1, 10, 11)]
    df = spark.createDataFrame([("A", d, 1.0) for d in days], "symbol string, date date, close double")
    assert [r["days"] for r in qc.missing_runs(df).collect()] == [6]
    files = spark.createDataFrame([(d,) for d in days], "date date")
    got = qc.skipped_days("2024-01-01", "2024-01-12", files, df.filter(F.col("date") < "2024-01-10").select("date", "symbol")).groupBy("reason").count().collect()
    assert dict(got) == {"weekday-404": 6, "not-listed": 2}


def test_bar_files_round_trip(spark, tmp_path):
    head = "<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "((now))aaa.x_D1.csv").write_text(head + "2024.01.05\t00:00:00\t1\t2\t0.5\t1.5\t100\t0\t1\n2024.01.59\t00:00:00\t1\t1\t1\t1\t1\t0\t1\n")
    got = bars.read_bar_files(spark, str(tmp_path / "in")).collect()
    assert [(r["symbol"], r["close"], r["spread"]) for r in got] == [("AAA", 1.5, 1)]
    out = spark.createDataFrame([("AAA", dt.datetime(2024, 1, 5), 1.0, 2.0, 0.5, 1.5, 3.7)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    bars.write_bar_files(out, str(tmp_path / "out"))
    text = next((tmp_path / "out" / "symbol=AAA").glob("*.csv")).read_text().splitlines()
    assert text[0].split("\t")[0] == "<DATE>" and text[1].split("\t")[:2] == ["2024.01.05", "00:00:00"] and text[1].split("\t")[6:] == ["3", "0", "0"]


def test_vendor_and_exchange_files(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "bbb_D1.csv").write_text("Date,Adj Close,Volume\n2024-01-02,10,5\nbad,1,1\n")
    (tmp_path / "v" / "ccc_D1.csv").write_text("DATE\tTIME\tOPEN\tHIGH\tLOW\tCLOSE\n2024.01.02\t01:00:00\t1\t2\t1\t2\n")
    got = {r["symbol"]: r for r in bars.read_vendor_files(spark, str(tmp_path / "v")).collect()}
    assert got["BBB"]["close"] == 10 and got["BBB"]["open"] is None and got["CCC"]["ts"] == dt.datetime(2024, 1, 2, 1)
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "a.zip", "w") as z:
        z.writestr("a.csv", "SYMBOL, SERIES,OPEN,HIGH,LOW,CLOSE,TOTTRDQTY,TIMESTAMP\nINFY ,EQ,1,2,1,2,9,19-DEC-2019\n")
    (tmp_path / "z" / "b.csv").write_text("TradDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol\n2024-07-09,INFY,EQ,3,4,3,4,8\n")
    daily = bars.read_daily_files(spark, str(tmp_path / "z"))
    assert [(str(r["date"]), r["close"]) for r in bars.one_series(daily, "INFY").orderBy("date").collect()] == [("2019-12-19", 2.0), ("2024-07-09", 4.0)]
    with pytest.raises(ValueError):
        bars.one_dialect(spark.createDataFrame([(1,)], "x int"))


def test_fingerprint_changes_with_data_only(spark):
    a, b = frame(spark, range(1, 60), "A"), frame(spark, range(50, 109), "B")
    of = lambda df, **k: ledger.fingerprint(df, **k).first()[0]
    first = of(a.unionByName(b))
    assert first == of(b.unionByName(a).repartition(7))
    assert first != of(a.unionByName(b).unionByName(frame(spark, [999], "A", dt.date(2024, 3, 1))))
    assert first != of(a.unionByName(b), version=ledger.SCHEMA_VERSION + "b")


def test_drawdown(spark):
    df = spark.createDataFrame([("c", DAY + dt.timedelta(i), r) for i, r in enumerate([0.1, -0.5, 0.2])], "config_id string, date date, ret double")
    assert max(r["dd"] for r in drawdowns(df).collect()) == pytest.approx(0.5)
