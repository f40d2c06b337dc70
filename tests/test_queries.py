"""Every registered query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from shopstead.plans import accounts, catalogue, commerce, site, writing
from shopstead.plans import rows as smaller

QUERIES, SQL = ({k: v for m in (commerce, catalogue, accounts, site, writing, smaller) for k, v in getattr(m, kind).items()} for kind in ("QUERIES", "SQL"))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(v[i]) for i in at) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    values = got.collect()
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, values) == rows(want.columns, want.fetchall())
    else:
        assert values
