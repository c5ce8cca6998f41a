import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.forms import CYRILLIC, GREEK, form_of, look_alike_groups, look_alikes, skeleton, skeleton_of


def test_tables_hold_what_they_say():
    assert all("CYRILLIC" in unicodedata.name(c) for c in CYRILLIC)
    assert all("GREEK" in unicodedata.name(c) for c in GREEK)


def test_one_form():
    for text, form in [
        ("Ｋｅｚｏｓ　９", "Kezos 9"), ("ﾊﾞﾅﾅ", "バナナ"), ("ビ", "ビ"), ("é", "é"), ("ké​z­", "kéz"), (" a b\t", "a b"),
        ("Аᴏ", "Aᴏ"), ("ЅТОР", "STOP"), ("ё", "ë"), ("Ωα", "Ωa"), ("a️", "a"), ("K", "K"), ("É", "É"), ("жук", "жyк"), ("a  b", "a  b"), ("", ""), ("​", ""),
    ]:
        assert form_of(text) == form, text
    assert skeleton_of("A") != skeleton_of("a") and skeleton_of("e") != skeleton_of("é")


@given(st.text(max_size=40))
def test_forms_are_stable(text):
    assert form_of(form_of(text)) == form_of(text)
    assert skeleton_of(form_of(text)) == skeleton_of(text)
    assert skeleton_of(unicodedata.normalize("NFD", text)) == skeleton_of(unicodedata.normalize("NFC", text))


def test_look_alikes(spark, rows):
    listed = spark.createDataFrame([(1, "Kezos", 5), (1, "Kezos", 6), (2, "bu​do", None), (3, None, 1), (None, "x", 1), (4, " ", 1), (5, "Kezos ", 1)], "key_id long, keys string, _skeleton int")
    asked = spark.createDataFrame(
        [(10, "Ｋezos", 1), (10, "Ｋezos", 2), (11, "Kezos", 1), (12, "budo", 1), (13, None, 1), (14, "", 1), (15, "​", 1), (16, "kezos", 1), (None, "Ｋezos", 1), (17, "Кezos" + "‍" * 50_000, 1)],
        "query_id long, queries string, _text int",
    )
    found = rows(look_alikes(asked, listed, "query_id", "queries", "key_id", "keys"))
    assert found == [(10, 1), (10, 5), (12, 2), (17, 1), (17, 5)]
    assert rows(look_alikes(asked.limit(0), listed, "query_id", "queries", "key_id", "keys")) == []
    assert rows(look_alikes(asked, listed.limit(0), "query_id", "queries", "key_id", "keys")) == []


def test_groups(spark, rows):
    df = spark.createDataFrame([("aＢ",), ("aB",), ("aB",), (None,), ("ab",)], "t string")
    assert rows(look_alike_groups(df, "t")) == [("aB", 2, 3, "aB"), ("ab", 1, 1, "ab")]


_ODD = "aZ9 .-\t\n\x00\x0b\x7f\x85\xa0­​‌﻿　ＡａｂＢ１ｱァアёЁйЙеЕсіκΚοäé́̀̂ßﬁ①日本語한글 ️🙂аΑ"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.one_of(st.sampled_from(_ODD), st.characters(codec="utf-8")), max_size=12), min_size=200, max_size=300))
def test_expressions_and_python_agree(spark, texts):
    from millrace.llm.forms import one_form

    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", one_form(F.col("t")).alias("form"), skeleton(F.col("t")).alias("skeleton"))
    for r in df.collect():
        assert (r.form, r.skeleton) == ((form_of(r.t), skeleton_of(r.t)) if r.t is not None else (None, None)), repr(r.t)


def test_simple_characters_one_by_one():
    from millrace.llm.forms import _simple

    source, to = _simple()
    for i, ch in enumerate(source):
        assert skeleton_of(f"a{ch}b") == f"a{to[i] if i < len(to) else ''}b"
    assert len(source) > 250
