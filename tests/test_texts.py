from pyspark.sql import functions as F

from millrace.operators import bayes, fuzzy, search


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_index_and_lookup(spark, rows):
    index = search.inverted_index(search.tokenise(docs(spark, "a b a", "B", None, ""), "id", "text"), "id")
    assert rows(index) == [("a", 0, 2, [0, 2]), ("b", 0, 1, [1]), ("b", 1, 1, [0])]
    assert rows(search.term_lookup(index, "b").select("id")) == [(0,), (1,)]
    assert rows(search.both_terms(index, "id", "a", "b")) == [(0,)]


def test_other_analyser(spark, rows):
    tokens = search.tokenise(docs(spark, "x_y"), "id", "text", F.split("text", "_"))
    assert rows(tokens) == [(0, 0, "x"), (0, 1, "y")]


def test_merged_segments_equal_the_whole(spark, rows):
    d = docs(spark, *["a b c a"] * 6)
    whole = search.inverted_index(search.tokenise(d, "id", "text"), "id")
    parts = [search.inverted_index(search.tokenise(d.filter(F.col("id") % 2 == i), "id", "text"), "id") for i in (0, 1)]
    assert rows(search.merge_segments(parts, "id")) == rows(whole)


def test_phrases(spark, rows):
    tokens = search.tokenise(docs(spark, "new york new york", "york new"), "id", "text")
    assert rows(search.phrase(tokens, "id", "new", "york")) == [(0, 0), (0, 2)]
    placed = spark.createDataFrame([(1, "ab", 4), (1, "cd", 6), (2, "ab", 4), (2, "cd", 7)], "id int, term string, pos long")
    assert rows(search.phrase(placed, "id", "ab", "cd", by_length=True)) == [(1, 4)]
    assert [(r.term, r.offset) for r in search.char_offsets(docs(spark, " Ab  c\nd"), "id", "text").orderBy("pos").collect()] == [("ab", 1), ("c", 5), ("d", 7)]


def test_longest_match(spark):
    find = search.longest_matches(["ab", "abc", "c", ""])
    got = {r.id: r.m for r in docs(spark, "abcab", "xx", "", None, "ccab").select("id", find("text").alias("m")).collect()}
    assert got == {0: ["abc", "ab"], 1: [], 2: [], 3: None, 4: ["c", "c", "ab"]}


def test_ranked_hits(spark):
    index = search.inverted_index(search.tokenise(docs(spark, "x y", "x x", "z", "x"), "id", "text"), "id")
    assert [r.id for r in search.ranked_hits(index, 4, "id", ["x", "y"], 3).collect()] == [0, 1, 3]


def test_correction(spark, rows):
    words = spark.createDataFrame([("google",), ("goggle",), ("apple",), ("google",)], "w string")
    asked = spark.createDataFrame([("googla",), ("zzz",), ("g",)], "q string")
    assert rows(fuzzy.correct(asked, words, "q", "w")) == [("googla", "goggle", 2, 2), ("googla", "google", 1, 1)]


def test_correction_equals_brute_force(spark, rows):
    import random

    rng = random.Random(2)
    make = lambda n: ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    words, asked = sorted(set(make(80))), sorted(set(make(60)))
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    truth = []
    for q in asked:
        for w in words:
            c = len(grams(q) & grams(w))
            if c and c / (len(q) + len(w) - 2 - c) >= 0.4:
                truth.append((q, w))
    got = fuzzy.correct(spark.createDataFrame([(q,) for q in asked], "q string"), spark.createDataFrame([(w,) for w in words], "w string"), "q", "w", k=1000)
    assert rows(got.select("q", "w")) == sorted(truth, key=repr)


def test_suggestions_keep_input_order_on_ties(spark):
    entries = spark.createDataFrame([("abx", 5, 0), ("aby", 5, 1), ("abz", 4, 2), ("aby", 9, 3)], "e string, s int, o int")
    index = fuzzy.prefix_index(entries, "e", "s", "o", k=2)
    assert [(r.e, r.s) for r in fuzzy.suggest(index, "ab").collect()] == [("abx", 5), ("aby", 5)]


def test_categorical_estimate(spark):
    table = [("ALPHA", "YES")] * 7 + [("BETA", "YES")] * 2 + [("ALPHA", "NO")] * 5
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(table)], "id int, snow string, ski string")
    model = bayes.categorical_train(df, ["snow"], "ski")
    p = {(r.ski, r.value): r.p for r in model.collect()}
    assert abs(p["YES", "BETA"] - 0.3) < 1e-12
    sizes = df.groupBy("ski").agg(F.count("*").alias("n_label"))
    post = {(r.id, r.ski): r.log_posterior for r in bayes.categorical_posterior(df, model, sizes, "id", ["snow"], "ski").collect()}
    assert post[7, "YES"] > post[7, "NO"]


def test_classifiers_learn(spark):
    train = [("a", i, w) for i in range(6) for w in ("x", "x", "y")] + [("b", 10 + i, w) for i in range(6) for w in ("z", "y", "z")]
    counts = bayes.term_counts(spark.createDataFrame(train, "cat string, doc int, term string"), "cat", "doc")
    test = spark.createDataFrame([(1, "x", 2), (2, "z", 1), (2, "y", 1), (3, "unknown", 1)], "doc int, term string, f long")
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "doc int, label string")
    for scores in (bayes.multinomial_score(test, *bayes.multinomial_train(counts, "cat", "doc"), "cat", "doc"), bayes.complement_score(test, *bayes.complement_train(counts, "cat", "doc"), "cat", "doc")):
        result = bayes.accuracy(bayes.ranked(scores, "doc", "cat"), truth, "doc", "cat", "label").first()
        assert (result.docs, result.accuracy, result.top3) == (2, 1.0, 1.0)
        assert scores.count() == 6
