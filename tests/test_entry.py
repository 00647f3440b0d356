import glob
import os

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def test_contract():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "p2_found" in q


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["position", "score", "similarity"]


def close(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_agrees(spark, con, name):
    df = entry.queries()[name](spark, D)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(str([close(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(str([close(r[c]) for c in cols]) for r in df.collect()) == want
