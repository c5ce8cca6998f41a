"""Queries of record mutations: each gives the table after the change."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import mutate
from millrace.plans.registry import query
from millrace.sources.tables import load

_BASE = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"
_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
_PATCH = "SELECT c_custkey + 50 * (c_custkey % 3) AS c_custkey, c_acctbal + 1000 AS c_acctbal FROM customer WHERE c_custkey % 10 = 1"


def _base(spark, d):
    return load(spark, d, "customer").select(*_COLUMNS)


def _patch(spark, d):
    some = load(spark, d, "customer").filter("c_custkey % 10 = 1")
    moved = some.select((F.col("c_custkey") + 50 * (F.col("c_custkey") % 3)).alias("c_custkey"), (F.col("c_acctbal") + 1000).alias("c_acctbal"))
    # several rows may move to one key: the greatest balance counts
    return moved.groupBy("c_custkey").agg(F.max("c_acctbal").alias("c_acctbal"))


_P = f"p AS (SELECT c_custkey, max(c_acctbal) AS c_acctbal FROM ({_PATCH}) GROUP BY c_custkey)"


@query(f"""WITH b AS ({_BASE}), {_P} SELECT * FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM p)
UNION ALL SELECT c_custkey, NULL, NULL, c_acctbal FROM p""")
def upsert_replace(spark, d):
    return mutate.upsert(_base(spark, d), _patch(spark, d), "c_custkey")


@query(f"""WITH b AS ({_BASE}), {_P} SELECT coalesce(b.c_custkey, p.c_custkey) AS c_custkey, c_name, c_nationkey, coalesce(p.c_acctbal, b.c_acctbal) AS c_acctbal
FROM b FULL JOIN p ON b.c_custkey = p.c_custkey""")
def merge_patch(spark, d):
    return mutate.merge_patch(_base(spark, d), _patch(spark, d), "c_custkey")


@query(f"""WITH b AS ({_BASE}), {_P} SELECT * FROM b UNION ALL SELECT c_custkey, NULL, NULL, c_acctbal FROM p WHERE c_custkey NOT IN (SELECT c_custkey FROM b)""")
def insert_new(spark, d):
    return mutate.insert_new(_base(spark, d), _patch(spark, d), "c_custkey")


@query(f"""WITH b AS ({_BASE}), {_P} SELECT * FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM p)
UNION ALL SELECT c_custkey, NULL, NULL, c_acctbal FROM p WHERE c_custkey IN (SELECT c_custkey FROM b)""")
def replace_existing(spark, d):
    return mutate.replace_existing(_base(spark, d), _patch(spark, d), "c_custkey")


@query(f"SELECT * FROM ({_BASE}) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def delete_keys(spark, d):
    keys = load(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return mutate.delete(_base(spark, d), keys, "c_custkey")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_by_attribute(spark, d):
    return mutate.update_where(_base(spark, d), "c_nationkey = 3", "c_acctbal", "c_acctbal * 2")


_FEED = """feed AS (SELECT o_custkey AS c_custkey, o_orderpriority AS c_name, o_orderkey AS seq, o_totalprice AS c_acctbal,
CASE WHEN o_orderkey % 5 = 0 THEN 'DELETE' WHEN o_orderkey % 5 = 1 THEN 'ADD' ELSE 'ALTERATION' END AS op FROM orders),
last AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) = 1)"""


@query(f"""WITH {_FEED} SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM last)
UNION ALL SELECT c_custkey, c_name, c_acctbal FROM last WHERE op <> 'DELETE'""")
def change_feed(spark, d):
    kind = F.when(F.col("o_orderkey") % 5 == 0, "DELETE").when(F.col("o_orderkey") % 5 == 1, "ADD").otherwise("ALTERATION")
    feed = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), kind.alias("op"), F.col("o_orderkey").alias("seq"))
    return mutate.apply_feed(_base(spark, d).select("c_custkey", "c_name", "c_acctbal"), feed, "c_custkey", "seq")


@query("""WITH f AS (SELECT p_partkey, map_from_entries([('name', p_name), ('brand', p_brand)]) AS m FROM part)
SELECT p_partkey, upper(m['name']) AS name, 'new' AS brand, m['size'] IS NOT NULL AS has_size FROM f""")
def row_container(spark, d):
    """Dynamic rows as maps: put all with overwriting, test, read."""
    row = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    put = F.map_zip_with(row, F.create_map(F.lit("brand"), F.lit("new")), lambda k, old, new: F.coalesce(new, old))
    return load(spark, d, "part").select("p_partkey", put.alias("m")).select("p_partkey", F.upper(F.col("m")["name"]).alias("name"), F.col("m")["brand"].alias("brand"), F.map_contains_key("m", "size").alias("has_size"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN 1 ELSE 2 END AS INTEGER) AS after_remove, 0 AS after_clear, p_brand = 'Brand#11' AS same, p_name AS name FROM part""")
def row_container_changes(spark, d):
    """Dynamic rows from which names are taken, which are cleared, and compared with others."""
    row = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    sized = F.when(F.col("p_size") > 25, mutate.remove(row, "brand", "unknown")).otherwise(mutate.remove(row, "unknown"))
    other = mutate.put_all(F.create_map(F.lit("brand"), F.lit("Brand#11"), F.lit("name"), F.lit("?")), F.create_map(F.lit("name"), F.col("p_name")))
    return load(spark, d, "part").select("p_partkey", F.size(sized).alias("after_remove"), F.size(mutate.clear(row)).alias("after_clear"), mutate.same_row(row, other).alias("same"), sized["name"].alias("name"))
