"""Every registered report against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from eventloom.catalog import ORACLES, QUERIES

SF = os.environ.get("REPORTS_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    order = lambda rows: sorted(map(repr, rows))
    want = order(tuple(r) for r in cur.fetchall())
    assert want
    assert order(tuple(r) for r in got.select(*columns).collect()) == want
