"""Queries against their SQL, and what the contract asks of them."""

import duckdb
import pytest

from millrace.llm.oracle import ORACLE
from millrace.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def against_sql(spark, rows, name):
    con = duckdb.connect()
    for table in ("nb", "cat_targets"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    truth = con.execute(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall()
    assert rows(df) == sorted(truth, key=repr)
    assert truth


@pytest.mark.parametrize("name", [n for n in ORACLE if n[:2] != "p1"])
def test_query_equals_sql(spark, rows, name):
    against_sql(spark, rows, name)


def test_result_columns():
    from millrace.session import build_session

    spark = build_session(8)
    wanted = {"p1_found": ["term", "mark"], "p2_found": ["cat"], "p3_found": ["docno", "term"], "p4_found": ["query_id", "key_id"], "p5_found": ["query_id", "key_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "subject"]}
    for name, columns in wanted.items():
        assert QUERIES[name](spark, FOLDER).columns == columns
