import glob
import os

import duckdb
import pytest

from spindrift.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {"p1_found": ["origin", "rec_id", "kind"], "p2_found": ["action_id", "source"], "p4_found": ["load_id", "spec_name"], "p5_found": ["session_id", "reason"], "p7_found": ["doc_id", "case_id"], "p8_found": ["doc_id", "lang"]}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    mine, theirs = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE[name])
    cols = sorted(mine.columns)
    at = [theirs.columns.index(c) for c in cols]
    assert sorted([str(r[c]) for c in cols] for r in mine.collect()) == sorted([str(r[i]) for i in at] for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    assert out.columns == COLUMNS[name]
    rows = out.collect()
    assert rows and len(rows) == len(set(rows))
