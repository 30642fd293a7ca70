"""Each query with SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemill.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    result = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in result.fetchall())


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["metric", "repetition", "split", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())
