"""Every query with SQL equals it; every query without gives rows."""

from pathlib import Path

import duckdb
import pytest

from millrace.plans.catalogue import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def cell(x):
    return repr(x + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    truth = con.execute(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall()
    assert sorted(tuple(map(cell, r)) for r in df.collect()) == sorted(tuple(map(cell, r)) for r in truth)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["o_orderkey", "revenue"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
