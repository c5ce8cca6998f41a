import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import runs, timeseries
from millrace.streaming import streams


def ordered(spark, values, kind="int"):
    return spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], f"k string, t int, v {kind}")


def test_runs(spark, rows):
    df = ordered(spark, [5, 5, 7, 7, 7, 5, None, None])
    encoded = runs.rle_encode(df, "k", ["t"], "v")
    assert sorted((r.start, r.val, r.length) for r in encoded.collect()) == [(0, 5, 2), (2, 7, 3), (5, 5, 1), (6, None, 2)]
    assert [r.val for r in runs.rle_decode(encoded, "k").orderBy("pos").collect()] == [5, 5, 7, 7, 7, 5, None, None]


def test_overlap_and_points(spark, rows):
    a, b = (spark.createDataFrame([("k", 1, s, 4)], "k string, val int, start long, length long") for s in (0, 2))
    assert rows(runs.overlap(a, b, "k")) == [("k", 1, 1, 2, 2)]
    points = spark.createDataFrame([("k", 3), ("k", 4)], "k string, pos long")
    assert rows(runs.at_points(a, points, "k")) == [("k", 3, 1)]


def test_fill_forward(spark):
    df = timeseries.fill_forward(ordered(spark, [None, 3, None, None, 4, None]), "k", ["t"], "v")
    assert [r.v for r in df.orderBy("t").collect()] == [None, 3, 3, 3, 4, 4]


def fold(trigger, back, ahead):
    """The search one row after another."""
    out, i = [], 0
    while i < len(trigger):
        if not trigger[i]:
            i += 1
            continue
        start, end = i, i
        while start > 0 and back[start - 1]:
            start -= 1
        while end < len(ahead) and (end == i or ahead[end]):
            end += 1
        out.append((start, i, end))
        i = end + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pattern_ranges_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    n = 200
    ahead = [rng.random() < 0.6 for _ in range(n)]
    trigger = [a and rng.random() < 0.3 for a in ahead]
    back = [rng.random() < 0.5 for _ in range(n)]
    df = spark.createDataFrame([("k", i, *x) for i, x in enumerate(zip(trigger, back, ahead))], "k string, t int, a boolean, b boolean, c boolean")
    got = timeseries.pattern_ranges(df, "k", ["t"], F.col("a"), F.col("b"), F.col("c"))
    assert sorted((r.start, r.trigger_pos, r.end) for r in got.collect()) == sorted(fold(trigger, back, ahead))


def test_look_ahead(spark, rows):
    df = spark.createDataFrame([("u", 1, "2024-01-01 00:00:00", "a"), ("u", 2, "2024-01-01 00:00:15", "b"), ("u", 3, "2024-01-01 00:00:18", "b"), ("u", 4, "2024-01-01 00:01:00", "a"), ("u", 5, "2024-01-01 00:01:21", "b")], "k string, id int, s string, e string")
    df = df.withColumn("ts", F.col("s").cast("timestamp_ntz"))
    assert rows(timeseries.look_ahead(df, "k", ["ts", "id"], "ts", F.col("e") == "a", F.col("e") == "b", 20, "id")) == [("u", 1, 2)]


def test_gaps_round_trip(spark):
    df = spark.createDataFrame([("k", v) for v in (9, 3, 3, 20)], "k string, v long")
    g = timeseries.gaps(df, "k", "v")
    assert [r.gap for r in g.orderBy("v").collect()] == [3, 6, 11]
    assert sorted(r.value for r in timeseries.ungap(g, "k", "v").collect()) == [3, 9, 20]


def test_order_check(spark):
    sent = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 1, 12)], "k string, at int, v int")
    swapped = spark.createDataFrame([("a", 1, 11), ("a", 2, 10), ("b", 1, 12)], "k string, at int, v int")
    assert {r.k: r.same for r in streams.order_check(sent, swapped, "k", "at", "v").collect()} == {"a": False, "b": True}
    assert {r.k: r.same for r in streams.order_check(sent, sent.filter("v <> 11"), "k", "at", "v").collect()} == {"a": False, "b": True}


def test_key_shared_and_failover_cover_all(spark):
    df = spark.range(200).select((F.col("id") % 10).cast("string").alias("k"), "id")
    owners = streams.key_shared(df, "k", ["id"], 4).select("k", F.spark_partition_id().alias("p")).distinct().groupBy("k").count().collect()
    assert len(owners) == 10 and all(r["count"] == 1 for r in owners)
    halves = [streams.failover_range(df, "k", 8, lo, hi).count() for lo, hi in ((0, 3), (4, 7))]
    assert sum(halves) == 200


def test_register(spark):
    rows = [("a", 1, "write", 1, None), ("a", 2, "read", 1, None), ("a", 3, "cas", 2, 1), ("a", 4, "read", 2, None), ("b", 1, "write", 1, None), ("b", 2, "cas", 3, 2), ("c", 1, "read", None, None), ("d", 1, "write", 1, None), ("d", 2, "read", 9, None)]
    df = spark.createDataFrame(rows, "k string, at int, op string, value int, expected int")
    assert {r.k: r.valid for r in streams.sequential_register(df, "k", "at").collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_compaction_is_a_binary_counter(spark, tmp_path):
    from millrace.operators.search import merge_segments

    path = str(tmp_path / "index")
    for i in range(7):
        streams.add_segment(spark.createDataFrame([("t", i, 1, [0])], "term string, doc int, tf long, positions array<long>"), path)
        streams.compact(path, spark, lambda s: merge_segments([s], "doc"))
    levels = sorted(p.name for p in (tmp_path / "index").iterdir() if any(p.iterdir()))
    assert levels == ["level=0", "level=1", "level=2"]
    assert sorted(r.doc for r in streams.read_segments(spark, path).collect()) == list(range(7))


def test_stream_by_batches(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.parquet(str(tmp_path / "in" / str(i)))
    seen = []
    stream = streams.read_log(spark, str(tmp_path / "in" / "*"), "id long", 1)
    streams.run_available(stream, str(tmp_path / "at"), lambda df, n: seen.append((n, df.count())))
    assert sum(n for _, n in seen) == 30 and len(seen) > 1
    streams.run_available(stream, str(tmp_path / "at"), lambda df, n: seen.append((n, df.count())))
    assert sum(n for _, n in seen) == 30  # committed batches aren't read again


def test_overlaps_and_points_against_brute_force(spark, rows, monkeypatch):
    import random

    monkeypatch.setattr(runs, "CHUNK", 16)  # many runs cross the borders of chunks
    rng = random.Random(6)

    def made(gaps):
        out, at = [], 0
        for _ in range(40):
            at += rng.randint(0, 3) if gaps else 0
            length = rng.choice([1, 2, 5, 50])
            out.append((rng.choice("kl"), rng.choice([1, 2, None]), at, length))
            at += length
        return out

    a, b = made(True), made(True)
    schema = "k string, val int, start long, length long"
    truth = [(k, v, w, max(s, t), min(s + n, t + m) - max(s, t)) for k, v, s, n in a for j, w, t, m in b if k == j and s < t + m and t < s + n]
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert rows(runs.overlap(left, right, "k")) == sorted(truth, key=repr)
    points = [(rng.choice("kl"), rng.randrange(700)) for _ in range(300)]
    inside = [(k, p, v) for k, p in points for j, v, s, n in a if k == j and s <= p < s + n]
    assert rows(runs.at_points(left, spark.createDataFrame(points, "k string, pos long"), "k")) == sorted(inside, key=repr)
    empty = spark.createDataFrame([], schema)
    assert rows(runs.overlap(left, empty, "k")) == [] == rows(runs.at_points(empty, spark.createDataFrame(points, "k string, pos long"), "k"))


def test_concurrent_register(spark):
    history = {
        "both orders": ([("write", 1, None, 0, 10), ("read", None, None, 1, 2), ("read", 1, None, 3, 4)], True),
        "read too late": ([("write", 1, None, 0, 1), ("read", None, None, 2, 3)], False),
        "cas of either": ([("write", 1, None, 0, 5), ("write", 2, None, 0, 5), ("cas", 3, 1, 1, 6), ("read", 3, None, 7, 8)], True),
        "two cas of one": ([("write", 1, None, 0, 1), ("cas", 2, 1, 2, 5), ("cas", 3, 1, 2, 5)], False),
        "unknown outcome seen": ([("write", 1, None, 0, None), ("read", None, None, 1, 2), ("read", 1, None, 3, 4)], True),
        "unknown outcome never": ([("write", 1, None, 0, None), ("read", None, None, 3, 4)], True),
        "seen and gone": ([("write", 1, None, 0, None), ("read", 1, None, 1, 2), ("read", None, None, 3, 4)], False),
    }
    made = [(k, *op) for k, (ops, _) in history.items() for op in ops]
    df = spark.createDataFrame(made, "k string, op string, value int, expected int, start int, end int")
    assert {r.k: r.valid for r in streams.linearizable_register(df, "k").collect()} == {k: v for k, (_, v) in history.items()}


def test_a_closed_log_gives_every_interval(spark, rows, tmp_path):
    from datetime import datetime

    from pyspark.sql import functions as F

    made = spark.createDataFrame([(datetime(2024, 1, 1, h, m), float(h)) for h in range(3) for m in (1, 59)], "ts timestamp, value double")
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    made.write.parquet(path)
    streams.close_log(spark, path, "ts", 3600, "10 minutes")
    streams.rates_to_folder(streams.read_log(spark, path, made.schema), "ts", "value", 3600, "10 minutes", out, str(tmp_path / "at"))
    assert rows(spark.read.parquet(out).select(F.hour("window_start"), "n", "mean_value")) == [(0, 2, 0.0), (1, 2, 1.0), (2, 2, 2.0)]
    empty = str(tmp_path / "empty")
    made.limit(0).write.parquet(empty)
    streams.close_log(spark, empty, "ts", 3600, "10 minutes")
    assert spark.read.parquet(empty).count() == 0


def test_keyed_sink_acknowledges_what_it_wrote(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.parquet(str(tmp_path / "in" / str(i)))
    stream = streams.read_log(spark, str(tmp_path / "in" / "*"), "id long", 1)
    sent = []
    streams.keyed_sink(stream, "id", 4, str(tmp_path / "out"), str(tmp_path / "at"), lambda n, rows: sent.append(rows))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sum(sent) == 30 == got.count() and got.select("id").distinct().count() == 30
    assert got.groupBy("id").agg({"partition": "count"}).count() == 30


def test_production_ends_by_time(spark, tmp_path):
    import time

    began = time.monotonic()
    streams.produce(spark, 10, 10**9, str(tmp_path / "made"), str(tmp_path / "at"), seconds=4)
    assert 4 <= time.monotonic() - began < 30


def test_segments_by_size_merge_by_several_and_survive_a_failure(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from millrace.operators.search import merge_segments

    path = str(tmp_path / "index")
    df = spark.range(100).select(F.col("id").alias("doc"), F.lit("t").alias("term"), F.lit(1).cast("long").alias("tf"), F.array(F.lit(0).cast("long")).alias("positions"))
    segment, n = streams.segments_by_size(df, "doc", F.lit(10), 100)
    assert n == 10
    streams.add_segments(df.withColumn("segment", segment), path, n)

    def fails(s):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        streams.compact(path, spark, fails, 4)
    assert streams.read_segments(spark, path).count() == 100
    # files that no list names are no segments, such as those of a merge that ended before its list
    spark.range(1).select(F.lit("x").alias("term"), F.lit(1).cast("long").alias("doc"), F.lit(1).cast("long").alias("tf"), F.array(F.lit(0).cast("long")).alias("positions")).write.parquet(f"{path}/level=1/segment=9")
    assert streams.read_segments(spark, path).count() == 100
    streams.compact(path, spark, lambda s: merge_segments([s], "doc", ("segment",)), 4)
    assert [s[0] for s in streams._listed(spark, path)] == [0, 0, 1, 1]
    assert sorted(r.doc for r in streams.read_segments(spark, path).collect()) == list(range(100))
