"""The whole build: same hash twice, another one for changed input, a bad series rejected but reported."""

import datetime as dt

from panelspark.operators.build import build_panel

START = dt.date(2024, 1, 1)


def bars(spark, prices):
    rows = [(s, START + dt.timedelta(days=k), float(p)) for s, series in prices.items() for k, p in enumerate(series)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def test_build(spark):
    good = {"AAA": [100 * 1.001**k for k in range(31)], "BBB": [50 * 1.001**k for k in range(29)]}
    panel, report, manifest = build_panel(bars(spark, good))
    m = manifest.first()
    assert (m["symbols"], m["failed"], m["passed"], m["rows"], m["all_present_rows"]) == (["AAA", "BBB"], [], True, 31, 29)
    assert panel.count() == 62 and panel.filter("close is null").count() == 2
    again = build_panel(bars(spark, good).orderBy("close"))[2].first()
    assert again["dataset_hash"] == m["dataset_hash"]
    changed = build_panel(bars(spark, {**good, "AAA": [*good["AAA"], 999.0]}))[2].first()
    assert changed["dataset_hash"] != m["dataset_hash"]
    _, report, manifest = build_panel(bars(spark, {**good, "BAD": [-5.0]}))
    m2 = manifest.first()
    assert (m2["failed"], m2["passed"], m2["symbols"]) == (["BAD"], False, ["AAA", "BBB"]) and m2["dataset_hash"] == m["dataset_hash"]
    assert {r["symbol"]: r["status"] for r in report.collect()}["BAD"] == "FAIL"
    empty = build_panel(bars(spark, {"AAA": [1.0]}).limit(0))[2].first()
    assert (empty["symbols"], empty["rows"], empty["passed"]) == ([], 0, True)
