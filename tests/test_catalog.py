"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from graphweir.catalog import ORACLES, QUERIES
from graphweir.plans.session import TABLES

DATA = os.environ.get("GRAPHWEIR_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    mine = canonical(out.columns, [tuple(r) for r in out.collect()])
    if name not in ORACLES:
        return
    there = duck.sql(ORACLES[name])
    assert mine == canonical(there.columns, there.fetchall())


def test_entry_point_offers_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
