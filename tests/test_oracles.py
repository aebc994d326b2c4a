"""Every query with SQL gives the rows that DuckDB gives."""

import glob

import duckdb
import pytest

from waymark.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {path.rsplit('/', 1)[1][:-8]} as select * from '{path}'")
    return con


def rows(found):
    clean = [tuple(float(x) + 0.0 if isinstance(x, float) else x for x in r) for r in found]
    return sorted(clean, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})")
    assert sorted(want.columns) == columns
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
