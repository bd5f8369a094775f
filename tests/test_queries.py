"""Every query against its SQL in DuckDB, and what SQL does not express against plain Python."""

import math

import duckdb
import pytest

from tidemark.catalog import ORACLE_SQL, QUERIES
from tidemark.plans.views import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    got = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_has_the_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
