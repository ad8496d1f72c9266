"""Every query of the library equals its DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from marketlake.fixtures import BASE_TABLES
from marketlake.registered import ORACLES, QUERIES

from helpers import assert_frames_match

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(ORACLES))
    assert missing == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert_frames_match(got, want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "date" in df.columns and "realized_vol_30d" in df.columns
