import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.messages import from_message, pack, to_message, unpack


@given(st.integers(-(2**63), 2**63 - 1), st.lists(st.tuples(st.text(max_size=5), st.none() | st.text(max_size=300)), max_size=4))
def test_round_trip(id, fields):
    assert unpack(pack(id, fields)) == (id, fields)


def test_known_bytes():
    assert pack(150, [("a", "xy")]) == bytes.fromhex("089601") + bytes.fromhex("1207") + bytes.fromhex("0a0161") + bytes.fromhex("12027879")
    assert unpack(b"") == (None, []) and unpack(bytes.fromhex("0896011a0161")) == (150, [])


@pytest.mark.parametrize("data", ["08", "1207", "12ff", "0d01", "12030a01ff"])
def test_what_is_no_record(data):
    assert unpack(bytes.fromhex(data)) is None


def test_columns(spark):
    made = [(1, [("a", "x"), ("b", None)]), (-5, []), (None, [("a", "x")]), (2, None)]
    df = spark.createDataFrame(made, "id long, fields array<struct<name:string,value:string>>")
    back = df.select(from_message(to_message(F.col("id"), F.col("fields"))).alias("m")).select("m.*")
    assert [(r.id, r.fields and [tuple(f) for f in r.fields]) for r in back.collect()] == [(1, [("a", "x"), ("b", None)]), (-5, []), (None, None), (None, None)]
