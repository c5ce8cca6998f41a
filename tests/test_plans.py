import json

from pyspark.sql import functions as F

from millrace.functions.text import ordinary_width
from millrace.functions.typed_bytes import TYPES, from_bytes, to_bytes
from millrace.plans.explain import plan_tree, sql_plan
from millrace.sources.tables import register
from millrace.streaming import streams


def test_plan_as_json(spark):
    register(spark, "/root/testdata/sf0.001", "customer", "orders", "lineitem")
    plan = json.loads(sql_plan(spark, "SELECT c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE c.c_custkey < 20000"))
    ops = [r["op"] for r in plan["rels"]]
    assert ops.count("Join") == 2 and ops.count("LogicalRelation") == 3
    assert all(i < r["id"] for r in plan["rels"] for i in r["inputs"])
    join = next(r for r in plan["rels"] if r["op"] == "Join")
    assert any(plan["rels"][i]["op"] in ("Filter", "Project") for i in join["inputs"])  # the filter went below the join
    assert plan_tree(spark.range(3).filter("id > 1"), "parsed")["op"] == "Filter"


def test_typed_bytes(spark):
    values = {"boolean": True, "int": -5, "bigint": 2**40, "float": 1.5, "double": -0.1, "string": "é", "binary": b"\x00\xff"}
    for kind, v in values.items():
        df = spark.createDataFrame([(v,), (None,)], f"v {kind}")
        assert [r[0] for r in df.select(from_bytes(to_bytes(F.col("v"), kind), kind)).collect()] == [v, None]
    assert set(values) == set(TYPES)
    assert spark.createDataFrame([(1,)], "v int").select(to_bytes(F.col("v"), "int")).first()[0] == b"\x00\x00\x00\x01"


def test_width(spark):
    df = spark.createDataFrame([("Ａｂｃ １",), ("ｶﾞ",), (None,)], "t string")
    assert [r[0] for r in df.select(ordinary_width(F.col("t"))).collect()] == ["Abc 1", "ガ", None]


def test_bounded_production(spark, tmp_path):
    streams.produce(spark, 500, 600, str(tmp_path / "out"), str(tmp_path / "at"))
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 600
