"""Query strings: their trees, their hits against brute force, and what is refused."""

import math
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators.query_string import All, Any, Leaf, parse, search

DOCS = [
    (1, "Hash tables", "A hash table is a table; the HASH table again."),
    (2, "Index", "An index and a query planner."),
    (3, None, "table hash, query"),
    (4, "Die Größe", None),
    (5, "index index", "query query"),
    (6, "", ""),
]


def word(text, w):
    return re.findall(r"[^\W_]+", (text or "").lower()).count(w)


def found(spark, text, k=10, **options):
    df = spark.createDataFrame(DOCS, "doc_id long, title string, text string").withColumn("score", F.lit("x"))
    return [(r.doc_id, r.score) for r in search(df.drop("score"), "doc_id", {"title": F.col("title"), "text": F.col("text")}, text, "text", k, **options).collect()]


def test_trees():
    a, b, c = (Leaf("t", (w,)) for w in "abc")
    assert parse("a", "t") == a and parse('"a b"', "t") == Leaf("t", ("a", "b")) and parse("x:A.b", "t") == Leaf("x", ("a", "b"))
    assert parse("a b OR c", "t") == parse("(a AND b) OR c", "t") == Any((All((a, b), ()), c))
    assert parse("a NOT (b OR c)", "t") == All((a,), (Any((b, c)),))
    assert parse("x:(a OR y:b)", "t") == Any((Leaf("x", ("a",)), Leaf("y", ("b",))))


@pytest.mark.parametrize("text", ["", "NOT a", "(a", "a)", "a OR", "x:", '"', "...", "a NOT", "()"])
def test_refused(text):
    with pytest.raises(ValueError):
        parse(text, "t")


def test_unknown_field(spark):
    with pytest.raises(ValueError):
        found(spark, "nowhere:a")


def test_hits(spark):
    idf = lambda n: math.log(6 / n)
    assert found(spark, "query") == [(5, round(2 * idf(3), 6)), (2, round(idf(3), 6)), (3, round(idf(3), 6))]
    assert found(spark, "query", k=2) == [(5, round(2 * idf(3), 6)), (2, round(idf(3), 6))]
    assert found(spark, '"hash table"') == [(1, round(2 * idf(1), 6))]
    assert found(spark, "title:index NOT planner") == [(5, round(2 * idf(2), 6))]
    assert found(spark, "title:größe") == [(4, round(idf(1), 6))]
    assert found(spark, "nothing") == [] == found(spark, "query NOT query")
    both = found(spark, "table OR title:index")
    assert both == sorted([(i, round(word(x, "table") * idf(2) + word(t, "index") * idf(2), 6)) for i, t, x in DOCS if word(x, "table") or word(t, "index")], key=lambda r: (-r[1], r[0]))


def test_stored_fields_and_empty_table(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    fields = {"text": F.col("text")}
    assert [tuple(r) for r in search(df, "doc_id", fields, "planner", "text", stored=("title",)).collect()] == [(2, round(math.log(6), 6), "Index")]
    assert search(df.limit(0), "doc_id", fields, "planner", "text").collect() == []


def test_counting_needs_no_shuffle_of_words(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    plan = search(df, "doc_id", {"text": F.col("text")}, "a b OR c", "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
