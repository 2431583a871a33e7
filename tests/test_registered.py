"""Every query with SQL beside it must agree with DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from tools import check  # noqa: E402

LOCATION = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(LOCATION).exists(), reason="given tables are absent")
TOO_SMALL = {"order_statistic_rows"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"create view {t} as select * from '{LOCATION}/{t}.parquet'")
    return con


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    state, text, _ = check.compare(spark, con, name, LOCATION)
    assert state == "ok" or (state == "EMPTY" and name in TOO_SMALL), text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
