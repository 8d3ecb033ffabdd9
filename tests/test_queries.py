"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fusionweft.plans import queries as profile_queries

NAMES = list(profile_queries.QUERIES)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in profile_queries.TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def shape(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(shape(r[c]) for c in columns) for r in df.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(shape(dict(zip(want.columns, row))[c]) for c in columns) for row in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
