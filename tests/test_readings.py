"""Readings of kana, and suggestions in two dictionaries."""

from pyspark.sql import functions as F

from millrace.functions.kana import HIRAGANA, KATAKANA, katakana, romanise
from millrace.functions.text import strip_marks, unicode_words
from millrace.operators import fuzzy, mutate, ranking


def test_romanise():
    cases = {"すし": "sushi", "カタカナ": "katakana", "きょうと": "kyouto", "しゃしん": "shashin", "チョコ": "choko", "がっこう": "gakkou", "ラーメン": "raamen", "ファン": "fan", "ティー": "tii", "abc": "abc", "漢字かな": "漢字kana", "": "", "ッ": "", "ヴァ": "va"}
    assert {t: romanise(t) for t in cases} == cases


def test_katakana(spark):
    assert len(HIRAGANA) == len(KATAKANA) == 86
    df = spark.createDataFrame([("ひらがなとカナ漢字a",), (None,)], "t string")
    assert [r[0] for r in df.select(katakana(F.col("t"))).collect()] == ["ヒラガナトカナ漢字a", None]


def test_dictionaries(spark):
    listed = [(1, "Sushi", 5), (2, "すし", 9), (3, "ＳＵＳＨＩ", 99), (4, "すみ", 9), (5, "sun", None), (6, None, 3), (7, "スシ", 1), (8, "", 3)]
    df = spark.createDataFrame(listed, "ord int, e string, s int")
    found = {}
    for r in fuzzy.reading_index(df, "e", "s", "ord").orderBy("dictionary", "prefix", "rank").collect():
        found.setdefault((r.dictionary, r.prefix), []).append((r.entry, r.score))
    assert found["latin", "s"] == found["latin", "su"] == [("sushi", 5), ("sun", None)]  # the same entry in another width is the first one
    assert found["japanese", "su"] == [("すし", 9), ("すみ", 9), ("スシ", 1)]
    assert found["japanese", "スシ"] == found["japanese", "sushi"] == [("すし", 9), ("スシ", 1)]
    assert ("japanese", "すし") not in found and ("latin", "ス") not in found
    assert fuzzy.reading_index(df.limit(0), "e", "s", "ord").collect() == []


def test_suggesting_without_an_index_is_the_same(spark, rows):
    df = spark.createDataFrame([(i, f"ab{i % 13}", i * 7 % 5) for i in range(60)], "ord int, e string, s int")
    index = fuzzy.prefix_index(df, "e", "s", "ord")
    for prefix in ("a", "ab1", "ab12", "x"):
        assert rows(fuzzy.suggest_now(df, "e", "s", "ord", prefix)) == rows(fuzzy.suggest(index, prefix).select("rank", "e", "s"))


def test_words_of_every_script(spark):
    df = spark.createDataFrame([("Größe, naïve! 列指向とカラム2 Привет x_y",), (None,), ("",), (" .,",)], "t string")
    assert [r[0] for r in df.select(unicode_words(F.col("t"))).collect()] == [["größe", "naïve", "列指向", "と", "カラム", "2", "привет", "x", "y"], None, [], []]
    marks = spark.createDataFrame([("(«it's!»)",), ("...",), (None,), ("é",)], "t string")
    assert [r[0] for r in marks.select(strip_marks(F.col("t"))).collect()] == ["it's", "", None, "é"]


def test_dynamic_rows(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))
    other = F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("a"), F.lit("1"))
    r = spark.range(1).select(
        mutate.same_row(m, other).alias("same"), mutate.same_row(m, mutate.remove(m, "a")).alias("less"), mutate.remove(m, "a", "x").alias("removed"),
        mutate.clear(m).alias("cleared"), mutate.put_all(m, F.create_map(F.lit("c"), F.lit("3"), F.lit("a"), F.lit(None).cast("string"))).alias("put"),
    ).first()
    assert (r.same, r.less, r.removed, r.cleared, r.put) == (True, False, {"b": None}, {}, {"a": None, "b": None, "c": "3"})


def test_scored_set_add(spark, rows):
    base = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("t", "a", 3.0)], "k string, m string, v double")
    new = spark.createDataFrame([("s", "a", 5.0), ("s", "a", 4.0), ("u", "c", 1.0)], "k string, m string, v double")
    assert rows(ranking.set_add(base, new, "k", "m", "v")) == [("s", "a", 5.0), ("s", "b", 2.0), ("t", "a", 3.0), ("u", "c", 1.0)]


def test_similar_pairs_against_brute_force(spark):
    import random

    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    grams = {w: {w[i : i + 2] for i in range(len(w) - 1)} for w in words}
    truth = {}
    for a in words:
        for b in words:
            common = len(grams[a] & grams[b])
            if a < b and common and common / (len(a) + len(b) - 2 - common) >= 0.4:
                truth[a, b] = common
    df = spark.createDataFrame([(w,) for w in [*words, *words[:5], None]], "w string")
    found = fuzzy.similar_pairs(df, "w").collect()
    assert {(r.a, r.b): r.common for r in found} == truth and len(found) == len(truth) > 20
    assert fuzzy.similar_pairs(df.limit(0), "w").collect() == []
