"""Every query of the catalog against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quarry import catalog

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    return con


def test_time_groups_hold_every_event(spark):
    data = "/root/testdata/sf0.01"
    got = QUERIES["group_time"](spark, data).agg({"rows": "sum"}).first()[0]
    assert got == spark.read.parquet(f"{data}/events.parquet").count()


def plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    assert columns == sorted(got.columns)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    expected = sorted(repr([plain(row[i]) for i in at]) for row in want.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in got.collect()) == expected
