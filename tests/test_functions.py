import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.codecs import CODECS, decode, encode, vbyte_last, vbyte_last_decode, vbyte_size
from millrace.functions.dates import epoch_day, yyyymmdd
from millrace.functions.hashing import hash37, md5_tail, shift_add, shift_xor, two_factors


def one(spark, expression, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(expression).first()[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=300), st.sampled_from(sorted(CODECS)))
def test_codecs_round_trip(xs, name):
    to_bytes, to_numbers = CODECS[name]
    assert to_numbers(to_bytes(xs)) == xs


def test_variable_bytes():
    assert vbyte_last([5]) == b"\x85" and vbyte_last([130]) == b"\x01\x82"
    assert vbyte_last_decode(b"\x85\x01\x82") == [5, 130]
    assert CODECS["vbyte_more"][0]([5, 130]) == b"\x0a\x03\x04"


def test_small_numbers_shrink():
    xs = [1, 2, 3, 1, 2, 3, 1, 1] * 50
    for name in ("rice", "frame", "simple9", "simple16"):
        assert len(CODECS[name][0](xs)) < len(xs) / 2


def test_codec_columns(spark):
    df = spark.createDataFrame([([1, 5, 2**32 - 1],), ([],), (None,)], "a array<long>")
    for name in CODECS:
        assert [r[0] for r in df.select(decode(encode(F.col("a"), name), name)).collect()] == [[1, 5, 2**32 - 1], [], None]
    assert [one(spark, vbyte_size(F.col("x")), x=x) for x in (0, 127, 128, 2**21, 2**28)] == [1, 1, 2, 4, 5]


def test_hashes(spark):
    assert one(spark, hash37(F.col("a"), F.col("b")), a=1, b=2) == 23312
    h = 1315423911
    assert one(spark, shift_add(F.col("a")), a=9) == h ^ ((h << 5) + 9 + (h >> 2))
    assert one(spark, two_factors(F.col("a"), F.col("b")), a=3, b=4) == 3 * ((63689 * 378551 + 2**31) % 2**32 - 2**31) + 4
    h = 0
    for x in (70000, 5):
        for j in range(4):
            h = (h << 5) ^ (h >> 27) ^ (x >> 8 * j & 0xFFFF)
    assert one(spark, shift_xor(F.col("a"), F.col("b")), a=70000, b=5) == h
    for x in (0, 7, 123456):
        assert one(spark, md5_tail(F.col("x")), x=x) == int.from_bytes(hashlib.md5(struct.pack(">I", x)).digest()[-2:])


def test_dates(spark):
    day = F.lit("1996-03-09").cast("timestamp_ntz")
    assert one(spark, yyyymmdd(day)) == 19960309 and one(spark, epoch_day(day)) == 9564


@pytest.mark.parametrize(("text", "grams"), [("google", ["go", "oo", "og", "gl", "le"]), ("a", []), ("", []), ("日本語", ["日本", "本語"])])
def test_qgrams(spark, text, grams):
    assert one(spark, tx.qgrams(F.col("s")), s=text) == grams


def test_strings(spark):
    assert one(spark, tx.prefixes(F.col("s")), s="abc") == ["a", "ab", "abc"]
    assert one(spark, tx.normalise(F.col("s")), s="  A \n b\t") == "a b"
    assert one(spark, tx.strip_punctuation(F.col("s")), s="('it's!)") == "it's"
    assert one(spark, tx.unescape(F.col("s")), s="&lt;b&gt; &amp;lt;\\sx") == "<b> &lt; x"
    assert one(spark, tx.link(F.col("s"), "abc|c", "/k/"), s="abcab") == '<a href="/k/abc">abc</a>ab'
    assert one(spark, tx.nth_field(F.col("s"), "|", 3), s="a|b|c|") == "c"
    assert one(spark, tx.words(F.col("s")), s="One, TWO--3!") == ["one", "two", "3"]
    assert one(spark, F.levenshtein(F.lit("googla"), F.lit("google"))) == 1
    assert abs(one(spark, tx.jaccard_estimate(F.lit(4), F.lit("googla"), F.lit("google"))) - 4 / 6) < 1e-12


def test_words_of_simple_codecs_are_the_published_ones():
    from millrace.functions.codecs import SIMPLE9, SIMPLE16, simple9, simple16

    word = lambda data: int.from_bytes(data[8:12], "little")
    assert all(sum(w) <= 28 for w in SIMPLE9) and all(sum(w) == 28 for w in SIMPLE16) and (len(SIMPLE9), len(SIMPLE16)) == (9, 16)
    assert word(simple16([1] * 28)) == 0x0FFFFFFF
    assert word(simple16([15] + [7] * 8)) == 0x5FFFFFFF
    assert word(simple16([7, 15, 15, 15, 15, 7, 7, 7])) == 0x6FFFFFFF
    assert word(simple16([5])) == 0x50000005
    assert word(simple16([1023, 511, 511])) == 0xDFFFFFFF
    assert word(simple16([2**28 - 1])) == 0xFFFFFFFF
    assert word(simple9([3] * 14)) == 0x1FFFFFFF and word(simple9([2**28 - 1])) == 0x8FFFFFFF


def test_long_lists_code_in_linear_time():
    import time

    xs = [i * 7919 % 5000 for i in range(60_000)]
    began = time.perf_counter()
    for to_bytes, to_numbers in CODECS.values():
        assert to_numbers(to_bytes(xs)) == xs
    assert time.perf_counter() - began < 20
