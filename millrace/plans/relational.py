"""Queries over the star schema: scans, joins, aggregates, set operations, orders, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.dates import epoch_day, yyyymmdd
from millrace.functions.hashing import TWO_FACTORS, hash37, md5_tail, shift_add, shift_xor, two_factors
from millrace.functions.predicates import COMPARATORS, Predicate, parse_range
from millrace.operators import joins, keyrange, ranking, scan
from millrace.plans import q3
from millrace.plans.registry import query, scratch
from millrace.sources import generators, readers
from millrace.sources.tables import load, register

DAY = "1998-01-01"
SHIPPED = "TIMESTAMP '1996-06-30'"
SIGN = {"EQ": "=", "NE": "<>", "GT": ">", "GE": ">=", "LT": "<", "LE": "<="}

# ---- scans and predicates


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate <= {SHIPPED} AND l_linenumber < 4 AND l_quantity >= 10")
def scan_conj(spark, d):
    tests = [Predicate("l_shipdate", "LE", F.lit("1996-06-30").cast("timestamp_ntz")), Predicate("l_linenumber", "LT", 4, "int"), Predicate("l_quantity", "GE", 10, "double"), Predicate("l_tax", "EQ", "NULL")]
    return scan.scan(load(spark, d, "lineitem"), tests, ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])


def _compare(name):
    sql = f"SELECT l_linenumber, count(*) AS n_tuples FROM lineitem WHERE l_quantity {SIGN[name]} 25 GROUP BY l_linenumber"

    @query(sql, f"scan_cmp_{name.lower()}")
    def run(spark, d):
        kept = load(spark, d, "lineitem").filter(Predicate("l_quantity", name, 25, "double").expression())
        return kept.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n_tuples"))


for _name in COMPARATORS:
    _compare(_name)


def _wide(spark, d):
    return scan.with_positions(load(spark, d, "orders"), F.col("o_orderdate").cast("date"), ["o_orderdate", "o_orderkey"])


_POS = "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, * FROM orders"


@query(f"SELECT pos, o_orderkey, o_totalprice, o_orderpriority FROM ({_POS}) WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def scan_em_vs_lm(spark, d):
    tests = [Predicate("o_totalprice", "GT", 400000, "double"), Predicate("o_orderstatus", "EQ", "F")]
    return scan.late_scan(_wide(spark, d), "pos", tests, ["pos", "o_orderkey", "o_totalprice", "o_orderpriority"])


@query(f"SELECT pos FROM ({_POS}) WHERE o_totalprice > 300000 INTERSECT SELECT pos FROM ({_POS}) WHERE o_orderstatus = 'O'")
def position_and(spark, d):
    rows = _wide(spark, d)
    return scan.intersect_positions(rows.filter("o_totalprice > 300000"), rows.filter("o_orderstatus = 'O'"))


@query(f"SELECT pos, o_orderkey FROM ({_POS}) WHERE pos % 97 = 5")
def positional_read_all(spark, d):
    """Every 97th row up to the last one."""
    rows = _wide(spark, d)
    wanted = spark.range(5, max(load(spark, d, "orders").count(), 5), 97).withColumnRenamed("id", "pos")
    return scan.at_positions(rows, wanted).select("pos", "o_orderkey")


@query(f"SELECT pos, concat_ws(',', o_orderkey, o_custkey) AS line FROM ({_POS})")
def positional_join_all(spark, d):
    """Two columns of every order put side by side again."""
    rows = _wide(spark, d)
    return joins.by_position(rows.select("pos", "o_orderkey"), rows.select("pos", "o_custkey")).select("pos", F.concat_ws(",", "o_orderkey", "o_custkey").alias("line"))


@query("SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS sum_partkey, min(l_suppkey) AS least, max(l_suppkey) AS most FROM lineitem")
def column_scan(spark, d):
    return load(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("sum_partkey"), F.min("l_suppkey").alias("least"), F.max("l_suppkey").alias("most"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 910.5 AND p_retailprice < 950")
def dsl_predicate_range(spark, d):
    part = load(spark, d, "part")
    for text in (">=(p_retailprice:double,910.5)", "<(p_retailprice:double,950)"):
        part = keyrange.range_scan(part, parse_range(text))
    return part.select("p_partkey", "p_retailprice")


@query("SELECT p_size AS block, min(p_retailprice) AS low, max(p_retailprice) AS high, count(*) AS n FROM part GROUP BY p_size HAVING min(p_retailprice) < 900.5")
def zone_map_prune(spark, d):
    zones = keyrange.zone_map(load(spark, d, "part").withColumnRenamed("p_size", "block"), "block", "p_retailprice")
    return keyrange.prune(zones, parse_range("<(p_retailprice:double,900.5)"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 150 ORDER BY o_orderkey")
def key_range_scan(spark, d):
    return load(spark, d, "orders").filter(F.col("o_orderkey").between(100, 150)).select("o_orderkey", "o_custkey").orderBy("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_size >= 13 AND p_size <= 19")
def sql_between(spark, d):
    register(spark, d, "part")
    return spark.sql("SELECT p_partkey, p_name FROM part WHERE p_size >= 13 AND p_size <= 19")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 10 AND c_acctbal > 1000")
def sql_param(spark, d):
    return spark.sql("SELECT c_custkey, c_name FROM {c} WHERE c_nationkey = :nation AND c_acctbal > :least", args={"nation": 10, "least": 1000}, c=load(spark, d, "customer"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'purchase'")
def nested_project(spark, d):
    parsed = readers.parse_json(load(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "props"), "props", "k int")
    return parsed.select("event_id", F.struct("k").alias("address")).select("event_id", "address.k")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts, event_id LIMIT 3")
def limit_ordered(spark, d):
    return load(spark, d, "events").select("event_id", "ts", "user_id").orderBy("ts", "event_id").limit(3)


# ---- joins


def _chain(spark, d):
    customer = load(spark, d, "customer").filter("c_acctbal < 500").select("c_custkey")
    orders = load(spark, d, "orders").filter("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    return customer, orders, load(spark, d, "lineitem").filter("l_quantity > 30")


_KEYS = [("c_custkey", "o_custkey"), ("o_orderkey", "l_orderkey")]


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 30 AND l_orderkey IN
(SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 500))""")
def semi_chain_3(spark, d):
    return joins.semi_chain(list(_chain(spark, d)), _KEYS).select("l_orderkey", "l_linenumber", "l_partkey")


_INNER = """SELECT c_custkey, o_orderkey, l_linenumber, l_partkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_acctbal < 500 AND o_totalprice > 100000 AND l_quantity > 30"""


@query(_INNER)
def inner_chain_3(spark, d):
    return joins.inner_chain(list(_chain(spark, d)), _KEYS).select("c_custkey", "o_orderkey", "l_linenumber", "l_partkey")


@query(_INNER)
def inner_chain_merge(spark, d):
    return joins.inner_chain(list(_chain(spark, d)), _KEYS, "merge").select("c_custkey", "o_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT c_mktsegment, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON o_orderkey = l_orderkey WHERE c_custkey < 20000 GROUP BY c_mktsegment""")
def sql_join_3(spark, d):
    register(spark, d, "customer", "orders", "lineitem")
    return spark.sql("""SELECT c_mktsegment, sum(l_linenumber) AS lines, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
        JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE c.c_custkey < 20000 GROUP BY c_mktsegment""")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 AND o_orderstatus = 'F'""")
def late_mat_join(spark, d):
    orders = load(spark, d, "orders")
    poor = load(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    keys = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").join(poor, "o_custkey", "left_semi").select("o_orderkey")
    return orders.join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


_Q3 = f"""SELECT o_orderkey, round(coalesce(sum(CASE WHEN l_shipdate > TIMESTAMP '{DAY}' THEN l_extendedprice END), 0), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderdate < TIMESTAMP '{DAY}' AND c_nationkey = 10 GROUP BY o_orderkey"""


@query(_Q3)
def q3_left_sum(spark, d):
    return q3.left_sum(load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "lineitem"), DAY, 10)


@query(_Q3)
def q3_join_index(spark, d):
    return q3.left_sum_by_index(_wide(spark, d), load(spark, d, "customer"), q3.numbered_items(load(spark, d, "lineitem")), DAY, 10)


@query(f"""WITH o AS ({_POS}) SELECT o.pos AS order_pos, count(*) AS n_items FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY o.pos""")
def join_index_build(spark, d):
    orders, items = _wide(spark, d).withColumnRenamed("pos", "order_pos"), q3.numbered_items(load(spark, d, "lineitem"))
    return joins.join_index(orders, items, "o_orderkey", "l_orderkey", "order_pos", "item_pos").groupBy("order_pos").agg(F.count(F.lit(1)).alias("n_items"))


@query("""SELECT k.key AS c_custkey, coalesce(c_nationkey, -1) AS c_nationkey
FROM (SELECT unnest(range(0, (SELECT greatest(200000, coalesce(max(c_custkey), 0) + 1) FROM customer), 37)) AS key) k LEFT JOIN customer ON c_custkey = k.key""")
def point_lookup_all(spark, d):
    """Every 37th key up to the largest, and to 200,000 at least, so that keys the table lacks are asked for too."""
    customer = load(spark, d, "customer")
    largest = customer.agg(F.max("c_custkey")).first()[0] or 0
    keys = spark.range(0, max(200000, largest + 1), 37).withColumnRenamed("id", "c_custkey")
    return joins.lookup(customer, keys, "c_custkey", "c_nationkey")


@query("SELECT n_nationkey, s.s_suppkey FROM nation CROSS JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000) s")
def cross_user_item(spark, d):
    return load(spark, d, "nation").select("n_nationkey").crossJoin(load(spark, d, "supplier").filter("s_acctbal > 9000").select("s_suppkey"))


# ---- aggregates


@query("""WITH r AS (SELECT user_id, event_id % 10 AS digit, value FROM events), m AS (SELECT avg(value) AS mean FROM r WHERE digit < 8)
SELECT round(sqrt(avg(power(value - mean, 2))), 4) AS rmse, round(min(mean), 4) AS mean FROM r, m WHERE digit >= 8""")
def rmse_mean_baseline(spark, d):
    from millrace.operators.recsys import split_by_digit

    train, validation, test = split_by_digit(load(spark, d, "events").select("event_id", "value"), "event_id")
    mean = train.unionByName(validation).agg(F.avg("value")).first()[0]
    # no rows to learn from: no mean
    guess = F.lit(mean).cast("double")
    return test.agg(F.round(F.sqrt(F.avg(F.pow(F.col("value") - guess, 2))), 4).alias("rmse"), F.round(F.first(guess), 4).alias("mean"))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
def group_count_desc(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand")


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(*) AS n, count(*) FILTER (WHERE value > 250) AS dear FROM events")
def distinct_users(spark, d):
    return load(spark, d, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 250).alias("dear"))


# ---- set operations and orders


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def setops_union(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def setops_intersect(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(load(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def setops_except(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(load(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def setops_distinct(spark, d):
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_suppkey ORDER BY l_suppkey")
def kway_merge(spark, d):
    items = load(spark, d, "lineitem")
    merged = ranking.merge_sorted([items.filter(F.col("l_linenumber") == i).select("l_suppkey") for i in (1, 2, 3)], "l_suppkey")
    return merged.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).orderBy("l_suppkey")


_NAMES = ["x-3", "x-5", "x-11", "x-1", "r-3", "r-2", "r-1", "w-2", "w-1", "plain"]


@query(f"""WITH n AS (SELECT unnest({_NAMES}) AS name), p AS (SELECT name, TRY_CAST(regexp_extract(name, '-([^-]*)$', 1) AS BIGINT) AS number, regexp_replace(name, '-[^-]*$', '') AS prefix FROM n)
SELECT name, number, prefix, row_number() OVER (ORDER BY number ASC NULLS LAST, prefix, name) AS rank FROM p""")
def zname_order(spark, d):
    return ranking.by_number_in_name(spark.createDataFrame([(n,) for n in _NAMES], "name string"), "name")


# ---- scalar functions


@query("""SELECT l_orderkey % 16 AS r, count(*) AS n, CAST(sum((17 * 37 + l_orderkey) * 37 + l_partkey) AS BIGINT) AS sum_hash FROM lineitem GROUP BY l_orderkey % 16""")
def hash37_bucket(spark, d):
    h = hash37(F.col("l_orderkey"), F.col("l_partkey"))
    return load(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 16).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("sum_hash"))




@query(f"""SELECT o_orderkey, xor(1315423911::BIGINT, 1315423911::BIGINT * 32 + o_orderkey + (1315423911::BIGINT >> 2)) AS shifted,
o_orderkey * {TWO_FACTORS} + o_custkey AS multiplied,
list_reduce([0::BIGINT, o_orderkey & 65535, (o_orderkey >> 8) & 65535, (o_orderkey >> 16) & 65535, (o_orderkey >> 24) & 65535, o_custkey & 65535, (o_custkey >> 8) & 65535, (o_custkey >> 16) & 65535, (o_custkey >> 24) & 65535],
lambda h, c: xor(xor(h << 5, h >> 27), c)) AS mixed FROM orders""")
def integer_hashes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, d, "orders").select("o_orderkey", shift_add(k).alias("shifted"), two_factors(k, c).alias("multiplied"), shift_xor(k, c).alias("mixed"))


@query("""SELECT o_orderkey, CAST(('0x' || substr(md5(unhex(lpad(to_hex(o_orderkey), 8, '0'))), 29, 4)) AS INTEGER) AS tail FROM orders""", "md5_tail")
def md5_tail_bucket(spark, d):
    return load(spark, d, "orders").select("o_orderkey", md5_tail(F.col("o_orderkey")).alias("tail"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS ymd, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day FROM orders")
def date_yyyymmdd_epoch(spark, d):
    return load(spark, d, "orders").select("o_orderkey", yyyymmdd(F.col("o_orderdate")).alias("ymd"), epoch_day(F.col("o_orderdate")).alias("day"))


@query("SELECT c_custkey, round(ln(abs(c_acctbal) + 1), 6) AS ln1, round(sqrt(abs(c_acctbal)), 6) AS root, round(tanh(c_acctbal / 1000), 6) AS tanh, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS step FROM customer")
def math_functions(spark, d):
    b = F.col("c_acctbal")
    return load(spark, d, "customer").select("c_custkey", F.round(F.log(F.abs(b) + 1), 6).alias("ln1"), F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.round(F.tanh(b / 1000), 6).alias("tanh"), F.when(b > 0, 1).otherwise(0).alias("step"))


# ---- sources and sinks


@query("SELECT n_nationkey, n_name, CAST(replace(n_name, 'NATION_', '') AS INTEGER) AS number FROM nation")
def csv_roundtrip(spark, d):
    from millrace.functions.text import nth_field

    path = scratch(spark, "csv")
    load(spark, d, "nation").select("n_nationkey", "n_name").write.csv(path, sep="|")
    back = readers.read_delimited(spark, path, "n_nationkey int, n_name string", "|")
    return back.withColumn("number", readers.column_value(nth_field(F.col("n_name"), "_", 2), "int"))


@query("SELECT n_nationkey, n_name FROM nation")
def text_lines(spark, d):
    path = scratch(spark, "lines")
    load(spark, d, "nation").select(F.concat_ws(", ", "n_name", "n_nationkey").alias("value")).write.text(path)
    return readers.read_lines(spark, path, [("n_name", "string"), ("n_nationkey", "int")]).select("n_nationkey", "n_name")


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def json_infer(spark, d):
    path = scratch(spark, "json")
    load(spark, d, "supplier").select("s_suppkey", F.struct("s_name", F.col("s_nationkey").alias("nation")).alias("address")).write.json(path)
    return spark.read.json(path).select("s_suppkey", "address.s_name", "address.nation")


@query("SELECT r_regionkey, r_name FROM region")
def parquet_roundtrip(spark, d):
    path = scratch(spark, "parquet")
    readers.write_sorted(load(spark, d, "region"), path, ["r_regionkey"])
    return readers.load_table(spark, "parquet", path=path).select("r_regionkey", "r_name")


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys FROM customer")
def record_store_scan(spark, d):
    """The folder of tables as a keyspace of the record store."""
    path, _, keyspace = d.rstrip("/").rpartition("/")
    records = readers.load_table(spark, "record_store", path=path, keyspace=keyspace, table="customer")
    return records.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("keys"))


@query("SELECT i AS user_id, md5('f' || i) AS fname, md5('l' || i) AS lname, i + 100 AS number FROM range(1000) t(i)")
def user_md5_rows(spark, d):
    return generators.users(spark, 1000)


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, n_nationkey, CAST(to_json({'k': n_nationkey, 'name': n_name}) AS VARCHAR) AS js FROM nation")
def json_serialise(spark, d):
    return load(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("region"), "n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("js"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_orders(spark, d):
    return ranking.top_per_group(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")




@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_custkey, o_totalprice, o_orderkey")
def sorted_sink(spark, d):
    """A sorted copy as delimited text, read back."""
    path = scratch(spark, "sorted")
    load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey").orderBy("o_custkey", "o_totalprice", "o_orderkey").write.csv(path)
    return readers.read_delimited(spark, path, "o_orderkey bigint, o_totalprice double, o_custkey bigint")


@query("SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment, c_acctbal > 0 AS positive FROM customer")
def typed_bytes_roundtrip(spark, d):
    """Typed columns through big-endian bytes and back."""
    from millrace.functions.typed_bytes import from_bytes, to_bytes

    kinds = {"c_custkey": "bigint", "c_acctbal": "double", "c_nationkey": "int", "c_mktsegment": "string", "positive": "boolean"}
    rows = load(spark, d, "customer").withColumn("positive", F.col("c_acctbal") > 0)
    return rows.select(*[from_bytes(to_bytes(F.col(c), t), t).alias(c) for c, t in kinds.items()])


@query("""SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950) GROUP BY 1
UNION ALL SELECT c_nationkey, count(*) FROM customer WHERE c_acctbal > 9950 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY 1""")
def setops_diff_both(spark, d):
    """What either side has and the other lacks."""
    left = load(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    right = load(spark, d, "customer").filter("c_acctbal > 9950").select(F.col("c_nationkey").alias("k"))
    return left.join(right, "k", "left_anti").unionByName(right.join(left, "k", "left_anti")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1, 2")
def composite_lookup_all(spark, d):
    """All items of every part and supplier that had an item sent back."""
    items = load(spark, d, "lineitem")
    keys = items.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return items.join(keys, ["l_partkey", "l_suppkey"], "left_semi").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey * 64 AS \"offset\", p_size AS length FROM part WHERE p_partkey * 64 >= 1000")
def file_ranges(spark, d):
    """Index lines of key, offset and length, as ranges."""
    lines = load(spark, d, "part").select(F.concat_ws("|", "p_partkey", F.col("p_partkey") * 64, "p_size").alias("value"))
    return keyrange.parse_ranges(lines).filter("range.offset >= 1000").select("key", "range.offset", "range.length")


@query("SELECT r_name AS label, count(*) AS files, CAST(sum(length(n_name)) AS BIGINT) AS characters FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def labelled_corpus(spark, d):
    """Files in folders that are their labels."""
    path = scratch(spark, "corpus")
    nation = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation.repartitionByRange(64, "n_nationkey").select(F.col("n_name").alias("value"), "r_name").write.partitionBy("r_name").option("maxRecordsPerFile", 1).text(path)
    read = readers.read_labelled(spark, path).withColumn("label", F.url_decode(F.split("label", "=")[1]))
    return read.groupBy("label").agg(F.count(F.lit(1)).alias("files"), F.sum(F.char_length(F.regexp_replace("text", "\n", ""))).alias("characters"))


@query(f"SELECT pos, o_orderkey, o_custkey FROM ({_POS}) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def secondary_index_lookup(spark, d):
    """Orders of the customers in debt: positions from an index of (value, position) that is stored in the order of the value, then the rows there."""
    rows = _wide(spark, d)
    path = scratch(spark, "index")
    readers.write_sorted(rows.select("o_custkey", "pos"), path, ["o_custkey", "pos"])
    asked = load(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    found = readers.load_table(spark, "parquet", path=path).join(asked, "o_custkey", "left_semi")
    return found.join(rows.select("pos", "o_orderkey"), "pos").select("pos", "o_orderkey", "o_custkey")
