"""Every query with SQL against DuckDB on the smallest tables, and the others for their schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spindrift.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


CORE = sorted(set(entry.oracle_sql()) & set(registry.QUERIES))


@pytest.mark.parametrize("name", CORE)
def test_same_rows_as_sql(spark, con, name):
    mine = entry.queries()[name](spark, DATA)
    theirs = con.sql(entry.oracle_sql()[name])
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in cols]
    a = sorted([plain(r[c]) for c in cols] for r in mine.collect())
    b = sorted([plain(r[i]) for i in at] for r in theirs.fetchall())
    assert a == b


def test_flagship_query(spark):
    out = entry.entry(spark)
    assert out.columns == ["id", "score"] and out.count() > 0


@pytest.mark.parametrize("name", ["html_to_text", "model_boundary"])
def test_queries_without_sql(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0
