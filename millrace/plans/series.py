"""Queries over the event stream: runs, filling, patterns, sets, rates, keyed order, recommendation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.functions.codecs import decode, encode, vbyte_size
from millrace.operators import ranking, recsys, runs, timeseries
from millrace.plans.registry import query, scratch
from millrace.sources.tables import load
from millrace.streaming import streams

_RUNS = """numbered AS (SELECT user_id, event_type, row_number() OVER w - 1 AS pos, lag(event_type) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
marked AS (SELECT *, sum(CASE WHEN last IS NOT DISTINCT FROM event_type AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM numbered),
runs AS (SELECT user_id, min(event_type) AS val, min(pos) AS start, count(*) AS length FROM marked GROUP BY user_id, run)"""
_DEAR = """dnumbered AS (SELECT user_id, CASE WHEN value > 250 THEN 'dear' ELSE 'cheap' END AS v, row_number() OVER w - 1 AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
dmarked AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY user_id ORDER BY pos) IS NOT DISTINCT FROM v AND pos > 0 THEN 0 ELSE 1 END AS ch FROM dnumbered)),
druns AS (SELECT user_id, min(v) AS val, min(pos) AS start, count(*) AS length FROM dmarked GROUP BY user_id, run)"""


def _runs(spark, d):
    return runs.rle_encode(load(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


def _price_runs(spark, d):
    events = load(spark, d, "events").withColumn("v", F.when(F.col("value") > 250, "dear").otherwise("cheap"))
    return runs.rle_encode(events, "user_id", ["ts", "event_id"], "v")


@query(f"WITH {_RUNS} SELECT user_id, val, start, length FROM runs")
def rle_encode(spark, d):
    return _runs(spark, d)


@query(f"WITH {_RUNS} SELECT user_id, pos, event_type AS val FROM numbered")
def rle_decode(spark, d):
    return runs.rle_decode(_runs(spark, d), "user_id")


@query(f"""WITH {_RUNS}, {_DEAR} SELECT a.user_id, a.val AS left_val, b.val AS right_val, greatest(a.start, b.start) AS start,
least(a.start + a.length, b.start + b.length) - greatest(a.start, b.start) AS length
FROM runs a JOIN druns b ON a.user_id = b.user_id AND a.start < b.start + b.length AND b.start < a.start + a.length""")
def rle_overlap(spark, d):
    return runs.overlap(_runs(spark, d), _price_runs(spark, d), "user_id")


@query(f"WITH {_RUNS} SELECT user_id, pos, event_type AS val FROM numbered WHERE pos % 10 = 3")
def rle_point(spark, d):
    sizes = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    points = sizes.filter("n > 3").select("user_id", F.explode(F.sequence(F.lit(3).cast("bigint"), F.col("n") - 1, F.lit(10).cast("bigint"))).alias("pos"))
    return runs.at_points(_runs(spark, d), points, "user_id")


@query(f"WITH {_RUNS} SELECT val, count(*) AS n_runs, CAST(sum(length) AS BIGINT) AS covered FROM runs GROUP BY val")
def run_totals(spark, d):
    return _runs(spark, d).groupBy("val").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("length").alias("covered"))


@query("""SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events""")
def locf(spark, d):
    events = load(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return timeseries.fill_forward(events, "user_id", ["ts", "event_id"], "value").select("event_id", "value")


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value > 100 AS t, value > 30 AS b, value > 20 AS a FROM events),
n AS (SELECT user_id, count(*) AS n FROM r GROUP BY user_id),
x AS (SELECT user_id, pos, t, max(CASE WHEN NOT b THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop,
min(CASE WHEN NOT a THEN pos END) OVER (PARTITION BY user_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nxt FROM r),
y AS (SELECT user_id, pos, coalesce(stop + 1, 0) AS start, coalesce(nxt, n) AS e FROM x JOIN n USING (user_id) WHERE t)
SELECT user_id, arg_min(start, pos) AS start, min(pos) AS trigger_pos, e AS "end" FROM y GROUP BY user_id, e""")
def pattern_range(spark, d):
    v = F.col("value")
    return timeseries.pattern_ranges(load(spark, d, "events"), "user_id", ["ts", "event_id"], v > 100, v > 30, v > 20)


@query("""WITH t AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view' AND value > 100), p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT t.user_id, t.event_id, arg_min(p.event_id, p.ts) AS target_id FROM t JOIN p ON p.user_id = t.user_id AND p.ts > t.ts AND p.ts <= t.ts + INTERVAL 36000 SECONDS GROUP BY t.user_id, t.event_id""")
def pattern_lookahead(spark, d):
    trigger = (F.col("event_type") == "view") & (F.col("value") > 100)
    return timeseries.look_ahead(load(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", trigger, F.col("event_type") == "purchase", 36000, "event_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return ranking.latest_per_key(load(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("SELECT user_id, count(*) AS n, arg_max(event_id, (value, event_id)) AS best, arg_min(event_id, (value, event_id)) AS worst FROM events GROUP BY user_id")
def zset_rev_top1(spark, d):
    return ranking.set_extremes(load(spark, d, "events"), "user_id", "event_id", "value")


@query("""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, value FROM events),
b AS (SELECT user_id, k, min(value) AS score FROM e GROUP BY ALL), a AS (SELECT user_id, k, max(value) + 1000 AS score FROM e WHERE event_type = 'purchase' GROUP BY ALL),
s AS (SELECT * FROM b WHERE (user_id, k) NOT IN (SELECT user_id, k FROM a) UNION ALL SELECT * FROM a)
SELECT user_id, count(*) AS n, arg_max(k, (score, k)) AS best, arg_min(k, (score, k)) AS worst FROM s GROUP BY user_id""")
def zset_add(spark, d):
    """Each user's items scored by their least value; items that were bought get another score."""
    items = load(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type", "value")
    base = items.groupBy("user_id", "k").agg(F.min("value").alias("score"))
    bought = items.filter("event_type = 'purchase'").select("user_id", "k", (F.col("value") + 1000).alias("score"))
    return ranking.set_extremes(ranking.set_add(base, bought, "user_id", "k", "score"), "user_id", "k", "score")


@query("SELECT l_partkey, l_orderkey AS value, l_orderkey - lag(l_orderkey, 1, 0) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS gap FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)")
def gap_encode(spark, d):
    return timeseries.gaps(load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "value"), "l_partkey", "value")


@query("""WITH g AS (SELECT l_partkey, l_orderkey - lag(l_orderkey, 1, 0) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS gap FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem))
SELECT l_partkey, count(*) AS n, CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS bytes FROM g GROUP BY l_partkey""", "vbyte_size")
def vbyte_size_of_lists(spark, d):
    gaps = timeseries.gaps(load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "value"), "l_partkey", "value")
    return gaps.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum(vbyte_size(F.col("gap"))).cast("bigint").alias("bytes"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS n, true AS vbyte, true AS vbyte_more, true AS rice, true AS frame, true AS simple9, true AS simple16 FROM lineitem GROUP BY l_partkey")
def codec_roundtrip(spark, d):
    """Gap lists through every codec and back: whether they come out as they went in."""
    gaps = timeseries.gaps(load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "value"), "l_partkey", "value")
    lists = gaps.groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct("value", "gap"))).alias("v")).select("l_partkey", F.col("v.gap").alias("gaps"))
    names = ["vbyte", "vbyte_more", "rice", "frame", "simple9", "simple16"]
    return lists.select("l_partkey", F.size("gaps").cast("bigint").alias("n"), *[(decode(encode(F.col("gaps"), c), c) == F.col("gaps")).alias(c) for c in names])


def _vbyte_hex(shape) -> str:
    """SQL: the bytes of gap in hexadecimal, seven bits each; shape(bits, is it the last) writes one byte."""
    sizes = [(128, 0), (16384, 1), (2097152, 2), (268435456, 3), (None, 4)]
    whole = lambda more: " || ".join(shape(7 * g, g == 0) for g in range(more, -1, -1))
    return "CASE " + " ".join(f"WHEN gap < {limit} THEN {whole(more)}" for limit, more in sizes if limit) + f" ELSE {whole(4)} END"


_LAST = _vbyte_hex(lambda shift, last: f"printf('%02x', ((gap >> {shift}) & 127) + {128 if last else 0})")
_MORE = _vbyte_hex(lambda shift, last: f"printf('%02x', ((gap >> {shift}) & 127) * 2 + {0 if last else 1})")


@query(f"""WITH g AS (SELECT l_partkey, l_orderkey, l_orderkey - lag(l_orderkey, 1, 0) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS gap FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem))
SELECT l_partkey, string_agg({_LAST}, '' ORDER BY l_orderkey) AS vbyte, string_agg({_MORE}, '' ORDER BY l_orderkey) AS vbyte_more FROM g GROUP BY l_partkey""")
def vbyte_bytes(spark, d):
    """Gap lists in both variable-byte layouts, byte by byte."""
    gaps = timeseries.gaps(load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "value"), "l_partkey", "value")
    lists = gaps.groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct("value", "gap"))).alias("v")).select("l_partkey", F.col("v.gap").alias("gaps"))
    return lists.select("l_partkey", *[F.lower(F.hex(encode(F.col("gaps"), c))).alias(c) for c in ("vbyte", "vbyte_more")])


_RATE = "SELECT time_bucket(INTERVAL 3600 SECONDS, ts) AS window_start, count(*) AS n, round(count(*) / 3600.0, 6) AS per_second, round(avg(value), 4) AS mean_value FROM events GROUP BY 1"


@query(_RATE)
def tumbling_rate(spark, d):
    return timeseries.tumbling_rate(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", 3600).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(_RATE)
def stream_tumbling_rate(spark, d):
    """The rates as a stream in append mode; the log's end lets the last intervals close."""
    path, out, at = scratch(spark, "log"), scratch(spark, "rates"), scratch(spark, "checkpoint")
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    streams.close_log(spark, path, "ts", 3600, "10 minutes")
    streams.rates_to_folder(streams.read_log(spark, path, events.schema), "ts", "value", 3600, "10 minutes", out, at)
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, true AS same FROM events GROUP BY user_id")
def keyed_order_check(spark, d):
    """Events sent through a key-shared subscription of 20 consumers arrive in order per key."""
    events = load(spark, d, "events").select("user_id", "event_id", "ts")
    received = streams.key_shared(events, "user_id", ["ts", "event_id"], 20).withColumn("arrival", F.monotonically_increasing_id())
    return streams.order_check(events.withColumn("arrival", F.struct("ts", "event_id")), received, "user_id", "arrival", "event_id")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sent, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS got FROM events)
SELECT user_id, bool_and(sent = got) AS same FROM n GROUP BY user_id""")
def keyed_order_check_disorder(spark, d):
    """Events that arrive in the order of their value: keys with more than one event have been disordered, unless values rose with time."""
    events = load(spark, d, "events").select("user_id", "event_id", "ts", "value")
    sent = events.withColumn("arrival", F.struct(F.col("ts").cast("string").alias("a"), "event_id"))
    received = events.withColumn("arrival", F.struct("value", "event_id"))
    return streams.order_check(sent, received, "user_id", "arrival", "event_id")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS messages, 1 AS ranges FROM events GROUP BY user_id")
def partition_ranges(spark, d):
    """Four subscriptions on a quarter of the partitions each: together they get every message once, and a key's messages go to one of them."""
    events = load(spark, d, "events").select("user_id", "event_id")
    got = [streams.failover_range(events, "user_id", 16, low, low + 3).withColumn("range", F.lit(low)) for low in (0, 4, 8, 12)]
    every = reduce(lambda a, b: a.unionByName(b), got)
    return every.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("messages"), F.countDistinct("range").cast("int").alias("ranges"))


@query("SELECT user_id, count(*) AS n, 1 AS partitions, max(event_id) AS latest FROM events GROUP BY user_id")
def stream_keyed_sink(spark, d):
    """The log sent on with its keys: every message arrives once, a key's messages in one partition."""
    out = scratch(spark, "sent")
    streams.keyed_sink(_log(spark, d, 6).select("user_id", "event_id"), "user_id", 16, out, scratch(spark, "checkpoint"))
    sent = spark.read.parquet(out)
    return sent.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("partition").cast("int").alias("partitions"), F.max("event_id").alias("latest"))


@query("SELECT true AS enough, true AS numbered, true AS keyed")
def stream_produce(spark, d):
    """Messages at a rate until there are as many as customers, or for twenty seconds: numbered without a gap, with their keys."""
    path, wanted = scratch(spark, "produced"), load(spark, d, "customer").count()
    streams.produce(spark, max(100, wanted), wanted, path, scratch(spark, "checkpoint"), seconds=20)
    made = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("values"), F.max("value").alias("last"), F.min((F.col("value") % 1000).cast("string") == F.col("key")).alias("keyed"))
    return made.select((F.col("n") >= wanted).alias("enough"), ((F.col("n") == F.col("values")) & (F.col("last") == F.col("n") - 1)).alias("numbered"), "keyed")


@query()
def partition_range(spark, d):
    return streams.failover_range(load(spark, d, "events").select("user_id", "event_id"), "user_id", 16, 4, 7)


@query("""WITH h AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, true AS valid FROM h GROUP BY user_id""")
def register_check(spark, d):
    """A register per user that is written with each event's value, then read: the history is sequentially valid."""
    events = load(spark, d, "events").select("user_id", "ts", "event_id", "value")
    history = events.withColumn("op", F.explode(F.array(F.lit("write"), F.lit("read")))).withColumn("at", F.struct("ts", "event_id", F.when(F.col("op") == "write", 0).otherwise(1)))
    return streams.sequential_register(history.withColumn("expected", F.lit(None).cast("double")), "user_id", "at")


@query("""WITH r AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item, value, floor(epoch(ts))::BIGINT AS t FROM events)
SELECT CASE WHEN t % 10 < 6 THEN 'train' WHEN t % 10 < 8 THEN 'validation' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item) AS items FROM r GROUP BY 1""")
def als_split(spark, d):
    parts = recsys.split_by_digit(_ratings(spark, d))
    named = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("train", "validation", "test"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"))


_CAS = """h AS (SELECT event_id // 3 AS register, event_id % 3 AS step, CASE event_id % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'cas' ELSE 'read' END AS op,
CASE event_id % 3 WHEN 0 THEN user_id % 2 ELSE user_id // 2 % 2 END AS value, CASE event_id % 3 WHEN 1 THEN user_id % 2 END AS expected FROM events)"""


def _registers(spark, d):
    step, user = F.col("event_id") % 3, F.col("user_id")
    op = F.when(step == 0, "write").when(step == 1, "cas").otherwise("read")
    half = F.floor(user / 2) % 2
    return load(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("register"), step.alias("at"), op.alias("op"), F.when(step == 0, user % 2).otherwise(half).alias("value"), F.when(step == 1, user % 2).alias("expected"))


@query(f"""WITH {_CAS}, b AS (SELECT *, last_value(CASE WHEN op <> 'read' THEN value END IGNORE NULLS) OVER (PARTITION BY register ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT register, bool_and(CASE op WHEN 'read' THEN value IS NOT DISTINCT FROM before WHEN 'cas' THEN expected IS NOT DISTINCT FROM before ELSE true END) AS valid FROM b GROUP BY register""")
def register_check_cas(spark, d):
    """Registers that are written, compared and set, and read, with values of which about a quarter agree."""
    return streams.sequential_register(_registers(spark, d), "register", "at")


@query(f"""WITH {_CAS}, r AS (SELECT register, max(value) FILTER (WHERE op = 'write') AS w, max(expected) AS e, max(value) FILTER (WHERE op = 'cas') AS c, max(value) FILTER (WHERE op = 'read') AS r,
count(*) FILTER (WHERE op = 'write') AS nw, count(*) FILTER (WHERE op = 'cas') AS nc, count(*) FILTER (WHERE op = 'read') AS nr FROM h GROUP BY register)
SELECT register, (nc = 0 OR (nw = 1 AND e = w)) AND (nr = 0 OR (nw = 1 AND r = w) OR (nc = 1 AND nw = 1 AND r = c)) AS valid FROM r""")
def register_check_concurrent(spark, d):
    """The same operations all at once: any order may explain them."""
    history = _registers(spark, d).withColumns({"start": F.lit(0), "end": F.lit(1)})
    return streams.linearizable_register(history, "register")


def _ratings(spark, d):
    events = load(spark, d, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    lines = events.select(F.concat_ws("::", "user_id", F.get_json_object("props", "$.k"), "value", seconds).alias("value"))
    return recsys.parse_ratings(lines)


@query("""WITH r AS (SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS INTEGER) AS item, value, floor(epoch(ts))::BIGINT % 10 AS digit FROM events),
g AS (SELECT "user", item, avg(value) AS rating, min(digit) AS digit FROM r GROUP BY ALL), p AS (SELECT "user", avg(rating) AS prediction FROM g WHERE digit < 8 GROUP BY "user")
SELECT count(*) AS n, round(sqrt(avg(power(rating - prediction, 2))), 4) AS rmse FROM g JOIN p USING ("user") WHERE digit >= 8""")
def rmse_join(spark, d):
    """Predictions, each user's mean rating, joined with the held-out ratings by user and item."""
    ratings = _ratings(spark, d).groupBy("user", "item").agg(F.avg("rating").alias("rating"), F.min(F.col("ts") % 10).alias("digit"))
    train, validation, test = recsys.split_by_digit(ratings, "digit")
    means = train.unionByName(validation).groupBy("user").agg(F.avg("rating").alias("prediction"))
    predictions = test.select("user", "item").join(means, "user").select("user", "item", "prediction")
    joined = predictions.join(test, ["user", "item"])
    return joined.agg(F.count(F.lit(1)).alias("n")).crossJoin(recsys.rmse(joined, "rating", "prediction").select(F.round("rmse", 4).alias("rmse")))


@query()
def als_scores(spark, d):
    """Implicit ALS over all events, and the ten best items of each user."""
    return recsys.top_items(recsys.fit_implicit(_ratings(spark, d).groupBy("user", "item").agg(F.sum("rating").alias("rating"))), 10)


@query("SELECT DISTINCT l_partkey, l_orderkey AS value FROM lineitem")
def gap_decode(spark, d):
    """Gap lists added up again."""
    gaps = timeseries.gaps(load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "value"), "l_partkey", "value")
    return timeseries.ungap(gaps, "l_partkey", "value")


def _log(spark, d, files):
    """The events as a log of several files, in order of time."""
    path = scratch(spark, "log")
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(files, "ts").write.parquet(path)
    return streams.read_log(spark, path, events.schema, 2)


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS messages, CAST(sum(user_id) AS BIGINT) AS sum_user FROM events")
def stream_consume(spark, d):
    """The log consumed from its earliest file in micro-batches, each committed after it was written."""
    out = scratch(spark, "consumed")
    streams.run_available(_log(spark, d, 6).select("event_id", "user_id"), scratch(spark, "checkpoint"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("messages"), F.sum("user_id").alias("sum_user"))


@query("SELECT user_id, count(*) AS n, round(max(value), 2) AS most FROM events GROUP BY user_id")
def stream_keyed_state(spark, d):
    """Running state per key over micro-batches; the last batch's whole state."""
    out = scratch(spark, "state")
    state = _log(spark, d, 4).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 2).alias("most"))
    streams.run_available(state, scratch(spark, "checkpoint"), lambda df, n: df.write.mode("overwrite").parquet(out), mode="complete")
    return spark.read.parquet(out)


@query("SELECT user_id, k, round(sum(value), 2) AS rating FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events) GROUP BY user_id, k")
def rating_table(spark, d):
    """Delimited rating lines parsed and added up per user and item."""
    return _ratings(spark, d).groupBy(F.col("user").cast("bigint").alias("user_id"), F.col("item").alias("k")).agg(F.round(F.sum("rating"), 2).alias("rating"))
