import pytest

from millrace.functions.predicates import KeyRange, Predicate, conjunction, parse_range


@pytest.mark.parametrize(
    ("text", "bounds"),
    [
        ("<(p_retailprice:double,1000)", KeyRange("p_retailprice", "double", None, True, 1000.0, False)),
        ("<=(a:int,5)", KeyRange("a", "int", None, True, 5, True)),
        (">( a : bigint , 5 )", KeyRange("a", "bigint", 5, False, None, True)),
        (">=(a:integer,5)", KeyRange("a", "int", 5, True, None, True)),
        ("=(a:string,x y)", KeyRange("a", "string", "x y", True, "x y", True)),
    ],
)
def test_bounds(text, bounds):
    got = parse_range(text)
    assert (got.column, got.type, got.low, got.high) == (bounds.column, bounds.type, bounds.low, bounds.high)
    assert got.low is None or got.low_included == bounds.low_included
    assert got.high is None or got.high_included == bounds.high_included


@pytest.mark.parametrize("text", ["", "<(a,5)", "!(a:int,5)", "<(a:blob,5)", "<(a:int,five)"])
def test_malformed(text):
    with pytest.raises(ValueError):
        parse_range(text)


@pytest.mark.parametrize(("text", "kept"), [("=(v:int,2)", [2]), ("<(v:int,2)", [1]), ("<=(v:int,2)", [1, 2]), (">(v:int,2)", [3]), (">=(v:int,2)", [2, 3]), ("<(v:int,99)", [1, 2, 3]), (">(v:int,0)", [1, 2, 3])])
def test_filters(spark, text, kept):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")
    assert sorted(r.v for r in df.filter(parse_range(text).expression()).collect()) == kept


def test_doubles_less_than_one_apart_differ(spark):
    df = spark.createDataFrame([(1.2,), (1.4,), (2**40 + 0.0,)], "v double")
    assert df.filter(Predicate("v", "GT", 1.3, "double").expression()).count() == 2
    assert df.filter(Predicate("v", "EQ", 1.2, "double").expression()).count() == 1
    assert df.filter(Predicate("v", "EQ", "NULL").expression()).count() == 3


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter(conjunction(Predicate("l_quantity", "GE", 10, "double"), Predicate("l_linenumber", "LT", 4, "int"))).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "LessThan(l_linenumber,4)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
