"""Every query runs; those with SQL agree with it."""

import duckdb
import pytest

import __spark_entry__ as driver
from verification.check import canonical
from verification.views import TABLES

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    mine = QUERIES[name](spark, sf).toArrow()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).to_arrow_table()
        assert sorted(mine.column_names) == sorted(want.column_names)
        assert canonical(zip(*[c.to_pylist() for c in mine.columns]), mine.column_names) == \
            canonical(zip(*[c.to_pylist() for c in want.columns]), want.column_names)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
