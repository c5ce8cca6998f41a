from pyspark.sql import functions as F

from millrace.functions.predicates import Predicate
from millrace.operators import joins, keyrange, mutate, ranking, scan
from millrace.operators.skew import profile_key


def test_positions_are_the_ordinals(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "k int, x int")
    got = {r.k: r.pos for r in scan.with_positions(df, F.floor(F.col("k") / 100), ["k"]).collect()}
    assert got == {k: k for k in range(1000)}
    nulls = spark.createDataFrame([(None,), (5,), (1,)], "k int")
    assert sorted(r.pos for r in scan.with_positions(nulls, F.floor(F.col("k") / 2), ["k"]).collect()) == [0, 1, 2]


def test_early_and_late_agree(spark, rows):
    df = spark.range(500).select(F.col("id").alias("pos"), (F.col("id") * 37 % 101).alias("a"), (F.col("id") % 7).alias("b"))
    tests = [Predicate("a", "LT", 50, "bigint"), Predicate("b", "NE", 3, "bigint")]
    assert rows(scan.scan(df, tests, ["pos", "b"])) == rows(scan.late_scan(df, "pos", tests, ["pos", "b"]))


def test_position_lists_keep_the_last_pair(spark, rows):
    a, b = spark.createDataFrame([(1,), (3,), (5,)], "pos long"), spark.createDataFrame([(3,), (5,)], "pos long")
    assert rows(scan.intersect_positions(a, b)) == [(3,), (5,)]


def test_semi_and_inner_multiplicity(spark):
    build, probe = spark.createDataFrame([(1,), (1,), (2,)], "b int"), spark.createDataFrame([(1,), (2,), (2,), (3,)], "p int")
    assert joins.semi_chain([build, probe], [("b", "p")]).count() == 3
    for how in (None, "broadcast", "merge", "shuffle_hash"):
        assert joins.inner_chain([build, probe], [("b", "p")], how).count() == 4


def test_join_index_keeps_unmatched(spark, rows):
    left = spark.createDataFrame([(10, 0), (20, 1)], "k int, lp int")
    right = spark.createDataFrame([(20, 0), (20, 1), (99, 2)], "k int, rp int")
    assert rows(joins.join_index(left, right, "k", "k", "lp", "rp")) == sorted([(1, 0), (1, 1), (None, 2)], key=repr)


def test_lookup_reports_missing(spark, rows):
    table, keys = spark.createDataFrame([(1, 10)], "k int, v int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(joins.lookup(table, keys, "k", "v")) == [(1, 10), (2, -1)]


def test_zone_map(spark, rows):
    from millrace.functions.predicates import parse_range

    zones = keyrange.zone_map(spark.createDataFrame([(0, 1), (0, 5), (1, 6), (1, 9)], "block int, key int"), "block", "key")
    assert [r.block for r in keyrange.prune(zones, parse_range("<(key:int,6)")).collect()] == [0]
    assert sorted(r.block for r in keyrange.prune(zones, parse_range("=(key:int,5)")).collect()) == [0]
    lines = spark.createDataFrame([("a|10|5",), ("bad",), ("b|x|5",)], "value string")
    assert [(r.key, tuple(r.range)) for r in keyrange.parse_ranges(lines).collect()] == [("a", (10, 5))]


def test_names_order(spark):
    for given, wanted in [("x-3 x-5 x-11 x-1", "x-1 x-3 x-5 x-11"), ("r-3 r-2 r-1 w-2 w-1", "r-1 w-1 r-2 w-2 r-3")]:
        df = ranking.by_number_in_name(spark.createDataFrame([(n,) for n in given.split()], "name string"), "name")
        assert [r.name for r in df.orderBy("rank").collect()] == wanted.split()


def test_scored_set_and_latest(spark, rows):
    df = spark.createDataFrame([("s", f"m{i}", float(i)) for i in range(5)], "k string, m string, v double")
    assert rows(ranking.set_extremes(df, "k", "m", "v")) == [("s", 5, "m4", "m0")]
    assert rows(ranking.latest_per_key(df, "k", ["v"], ["m"])) == [("s", "m4")]


def test_merge_is_sorted(spark):
    parts = [spark.range(i, 100, 3).toDF("v") for i in range(3)]
    assert [r.v for r in ranking.merge_sorted(parts, "v").collect()] == list(range(100))


def test_patch_and_replace(spark, rows):
    base = spark.createDataFrame([("x", 900, 1, ("a", "b")), ("y", 1, 1, None)], "id string, balance int, createdAt int, address struct<city:string,street:string>")
    patch = spark.createDataFrame([("x", 100000, (None, "c")), ("z", 5, None)], "id string, balance int, address struct<city:string,street:string>")
    got = {r.id: r for r in mutate.merge_patch(base, patch, "id").collect()}
    assert (got["x"].balance, got["x"].createdAt, tuple(got["x"].address)) == (100000, 1, ("a", "c"))
    assert got["y"].balance == 1 and got["z"].balance == 5 and got["z"].createdAt is None
    replaced = {r.id: r for r in mutate.upsert(base.drop("address"), patch.drop("address"), "id").collect()}
    assert replaced["x"].createdAt is None and replaced["x"].balance == 100000 and len(replaced) == 3


def test_mutations(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert rows(mutate.insert_new(base, new, "id")) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(mutate.replace_existing(base, new, "id")) == [(1, "a"), (2, "B")]
    assert rows(mutate.delete(base, new, "id")) == [(1, "a")]
    assert rows(mutate.update_where(base, "id = 1", "v", "upper(v)")) == [(1, "A"), (2, "b")]
    feed = spark.createDataFrame([(1, "x", "ALTERATION", 1), (1, "y", "DELETE", 2), (4, "n", "ADD", 1), (4, "m", "ALTERATION", 2)], "id int, v string, op string, seq int")
    assert rows(mutate.apply_feed(base, feed, "id", "seq")) == [(2, "b"), (4, "m")]


def test_hot_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("k"))
    p = profile_key(df, "k")
    assert (p.rows, p.keys, p.hot) == (1000, 401, (1,))
    assert profile_key(df.limit(0), "k").keys == 0 and profile_key(df.filter("k > 1"), "k").hot == ()


def test_positions_need_no_single_task(spark):
    import contextlib
    import io

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("same"))
    numbered = scan.with_positions(df, F.col("same"), ["k"])  # one bucket has all rows
    assert {r.k: r.pos for r in numbered.collect()} == {k: k for k in range(5000)}
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        numbered.explain()
    assert "SinglePartition" not in out.getvalue() and "Window" not in out.getvalue()
    assert scan.with_positions(df.limit(0), F.col("k"), ["k"]).collect() == []


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from millrace.session import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf), conf=conf))
