"""Every query of the entry file with SQL against DuckDB on the smallest tables, and the others for rows."""

import collections
import glob
import importlib
import os

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")


def plain(v):
    return None if v is None or v != v else round(v, 9) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    r = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == columns
    assert got == collections.Counter(tuple(plain(x[at.index(c)]) for c in columns) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows(spark, data, name):
    if name.startswith("p") and name[1].isdigit() and name != "p1_found":
        pytest.skip("tested with its operator")
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["user_id", "value", "source", "agreed", "had_conflict", "score"]
