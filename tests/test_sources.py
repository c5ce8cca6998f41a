from pyspark.sql import functions as F

from millrace.operators import recsys, small_ml
from millrace.session import ensure_checkpoints, shared_dir
from millrace.sources import generators, readers


def test_delimited(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("# head\n1,x,1995-01-02\n2,,bad\n")
    assert rows(readers.read_delimited(spark, str(tmp_path), "k int, v string, d date")) == sorted([(1, "x", __import__("datetime").date(1995, 1, 2)), (2, None, None)], key=repr)
    df = spark.createDataFrame([("1995-01-02",), ("",), (None,), ("x",)], "f string")
    assert [r[0] for r in df.select(readers.column_value(F.col("f"), "int")).collect()] == [19950102, -1, -1, None]


def test_lines_and_labels(spark, tmp_path, rows):
    for label, name, text in [("spam", "1", "buy\nnow"), ("ham", "2", "hello")]:
        (tmp_path / label).mkdir()
        (tmp_path / label / name).write_text(text)
    assert rows(readers.read_labelled(spark, str(tmp_path))) == [("ham", "2", "hello"), ("spam", "1", "buy\nnow")]
    (tmp_path / "p.txt").write_text("Ann, 20\nBob,x\nCid\n")
    assert rows(readers.read_lines(spark, str(tmp_path / "p.txt"), [("name", "string"), ("age", "int")])) == sorted([("Ann", 20), ("Bob", None), ("Cid", None)], key=repr)


def test_json_and_registry(spark, tmp_path):
    df = spark.createDataFrame([('{"k": 5}',), ("not json",)], "j string")
    assert [r.k for r in readers.parse_json(df, "j", "k int").collect()] == [5, None]
    spark.range(3).write.parquet(str(tmp_path / "ks/t.parquet"))
    assert readers.load_table(spark, "record_store", path=str(tmp_path), keyspace="ks", table="t").count() == 3


def test_generators_repeat(spark, rows):
    assert rows(generators.users(spark, 5)) == rows(generators.users(spark, 5))
    assert generators.lookup_list(spark, 50, 10).filter("key < 0 or key >= 10").count() == 0
    r = generators.repeated_numbers(spark, 10, 4, 1000)
    assert r.count() == 40 and r.groupBy((F.col("pos") / 4).cast("int")).agg(F.countDistinct("value").alias("n")).filter("n > 1").count() == 0


def test_checkpoint_folder(spark):
    ensure_checkpoints(spark)
    assert shared_dir(spark) and spark.range(3).checkpoint().count() == 3


def test_ratings(spark, rows):
    lines = spark.createDataFrame([("1::2::3.5::17",), ("bad",)], "value string")
    assert rows(recsys.parse_ratings(lines)) == sorted([(1, 2, 3.5, 17), (None, None, None, None)], key=repr)
    ratings = spark.createDataFrame([(u, (u + k) % 10, 5.0, 10 * u + k) for u in range(20) for k in range(10)], "user int, item int, rating double, ts long")
    train, validation, test = recsys.split_by_digit(ratings)
    assert (train.count(), validation.count(), test.count()) == (120, 40, 40)
    model = recsys.best_of(train, validation, [2], [0.1, 1.0], 2)
    assert recsys.top_items(model, 3).count() == 60
    assert recsys.all_scores(model, ratings, ratings).count() == 200
    assert recsys.rmse(ratings.withColumn("p", F.col("rating") - 1), "rating", "p").first().rmse == 1.0


def test_small_learners(spark):
    rows = [("g", i, float(i % 2), float(i // 2 % 2), float(i % 2 or i // 2 % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, o int, a double, b double, y double")
    w = small_ml.perceptron(df, "k", ["a", "b"], "y", "o").first().weights
    assert all((w[0] * a + w[1] * b + w[2] >= 0) == bool(y) for _, _, a, b, y in rows)
    signs = df.withColumn("y", F.col("y") * 2 - 1)
    t = small_ml.tanh_unit(signs, "k", ["a", "b"], "y", "o").first().weights
    assert all((t[0] * a + t[1] * b + t[2] >= 0) == bool(y) for _, _, a, b, y in rows)
    net = small_ml.network(df.withColumn("y", ((F.col("a") + F.col("b")) % 2)), ["a", "b"], "y", hidden=4)
    assert net.transform(df).count() == 40


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    a = readers.write_bucketed(spark.range(1000).withColumnRenamed("id", "k"), "bucketed_a", str(tmp_path / "a"), "k", 4)
    b = readers.write_bucketed(spark.range(0, 2000, 2).withColumnRenamed("id", "k"), "bucketed_b", str(tmp_path / "b"), "k", 4)
    joined = a.hint("merge").join(b, "k").groupBy("k").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 500
    for t in ("bucketed_a", "bucketed_b"):
        spark.sql(f"DROP TABLE {t}")
