"""Queries answer for their whole tables: every symbol, date and dialect."""

import duckdb
import pyarrow.parquet as pq
import pytest

from panelspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.register(t, pq.read_table(f"{SF}/{t}.parquet"))
    return con


def held_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)
    return got


def test_both_dialects_of_every_symbol(spark, duck):
    got = held_against_sql(spark, duck, "exchange_dialects_all")
    assert got.groupby("series").symbol.unique().map(sorted).to_dict() == {"EQ": ["AF", "AO"], "BE": ["NF", "NO", "RF", "RO"]}
    part = held_against_sql(spark, duck, "exchange_dialects")
    assert len(part) == len(got)  # both names give every symbol
