"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from calibrant.plans import index_queries, more_queries, scoring_queries  # noqa: F401
from calibrant.plans import queries as q

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = q.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = duck.sql(q.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(x[c]) for c in columns]) for x in df.collect()) == sorted(repr([plain(r[i]) for i in place]) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
