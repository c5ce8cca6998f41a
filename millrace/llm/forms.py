"""Problem 4: text that looks alike in one form, and the confusables skeleton behind it.

One form: invisible characters are left out, every kind of blank is a blank and blanks at the ends
don't count, wide and narrow forms are the ordinary ones, a letter and its mark are one letter, and
a Cyrillic or Greek letter drawn like a Latin letter is that letter. Case and accents stay.

The skeleton is that form taken apart: decompose, replace every character by its prototype, and
decompose again. Two texts look alike exactly if their skeletons are equal; one_form composes the
skeleton again, for those who go on with words or letters. In tables, most texts are brought to one form by
expressions; Python sees only those with letters that ASCII lacks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters drawn like a Latin letter. Letters with marks are taken apart before.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԚԜаԁеһіјӏорԛѕсуүѵԝх"
CYRILLIC_AS = "ABESIJKMHOPCTYXYQWadehijlopqscyyvwx"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ"
GREEK_AS = "ABEZHIKMNOPTYXaivopu"
# Characters without a look of their own that aren't of the format category.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"


def _prototype(ch: str) -> str:
    """Prototype of a character that no fixed value names, by rule from the character database."""
    category = unicodedata.category(ch)
    if ch.isspace() or category in ("Zs", "Zl", "Zp"):
        return " "
    if category in ("Cf", "Cc") or ch in UNSEEN or unicodedata.name(ch, "").startswith(("VARIATION SELECTOR", "MONGOLIAN FREE VARIATION")):
        return ""
    if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKD", ch)
    return ch


class _Prototypes(dict):
    """Prototype of every character, kept once it was needed."""

    def __missing__(self, code: int) -> str:
        self[code] = to = _prototype(chr(code))
        return to


PROTOTYPES = _Prototypes(zip(map(ord, CYRILLIC + GREEK), CYRILLIC_AS + GREEK_AS, strict=True))
#: Lower-case letters whose capital is drawn like a Latin letter, for comparisons without regard to case.
CASELESS = {c.lower(): to.lower() for c, to in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS) if ord(c.lower()) not in PROTOTYPES}


def skeleton_of(text: str) -> str:
    """The confusables skeleton of one text."""
    if text.isascii() and text.isprintable():
        return text.strip()
    apart = unicodedata.normalize("NFD", text).translate(PROTOTYPES)
    return unicodedata.normalize("NFD", apart).strip()


def form_of(text: str) -> str:
    """One form of one text."""
    skeleton = skeleton_of(text)
    return skeleton if skeleton.isascii() else unicodedata.normalize("NFC", skeleton)


@F.pandas_udf(T.StringType())
def _skeleton(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def _form(texts: pd.Series) -> pd.Series:
    return texts.map(form_of, na_action="ignore")


# Declared so, though they are not, that filters on their results aren't pushed below a distinct and evaluated once more for every row.
_skeleton, _form = _skeleton.asNondeterministic(), _form.asNondeterministic()


@cache
def _simple() -> tuple[str, str]:
    """Characters that stand alone and have a plain ASCII character or nothing as prototype, and these prototypes; those that vanish come last."""
    found = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True))
    for ch in map(chr, [*range(1, 0x20), *range(0x7F, 0xD800), *range(0xE000, 0x10000)]):
        if ch not in found and not unicodedata.combining(ch) and unicodedata.normalize("NFD", ch) == ch:
            to = _prototype(ch)
            if to != ch and to.isascii() and len(to) <= 1:
                found[ch] = to
    order = sorted(found, key=lambda ch: (found[ch] == "", ch))
    return "".join(order), "".join(found[ch] for ch in order)


def _in_one_form(text: Column, rest: Callable[[Column], Column]) -> Column:
    """Texts whose prototypes all are plain ASCII, by expressions; only the others go to `rest`, which is Python.

    Characters that stand alone don't act on their neighbours, so replacing them one by one gives the
    form if nothing else than ASCII is left.
    """
    ready = (F.char_length(text) == F.octet_length(text)) & ~text.rlike(r"[\x00-\x1f\x7f]")
    plain = F.translate(text, *_simple())
    done = plain.rlike(r"\A[ -~]*\z")
    return F.when(ready, F.trim(text)).when(done, F.trim(plain)).otherwise(rest(F.when(~ready & ~done, text)))


def skeleton(text: Column) -> Column:
    """The skeleton of a column of texts; null stays null, blank and invisible texts become empty."""
    return _in_one_form(text, _skeleton)


def one_form(text: Column) -> Column:
    """One form of a column of texts; null stays null, blank and invisible texts become empty."""
    return _in_one_form(text, _form)


def caseless(form: Column) -> Column:
    """One form without regard to case: small letters, and those whose capital is a Latin letter's twin as that letter."""
    return F.translate(F.lower(form), "".join(CASELESS), "".join(CASELESS.values()))


def look_alike_groups(df: DataFrame, text: str) -> DataFrame:
    """(skeleton, form, spellings, n_rows): the distinct originals behind each skeleton are counted, not gathered.

    Every original is skeletonised once. Null texts are left out; repeated rows count in n_rows only.
    """
    originals = df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("original")).agg(F.count(F.lit(1)).alias("n_rows"))
    return originals.withColumn("skeleton", skeleton(F.col("original"))).groupBy("skeleton").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n_rows").alias("n_rows"), F.min("original").alias("least"))


def look_alike_classes(texts: DataFrame, source: str, id: str, text: str) -> DataFrame:
    """(original, skeleton, form, class_id, sources, spellings, n_rows): each distinct original with its class.

    sources lists per source the rows that have the original and their least id. spellings and n_rows
    count the distinct originals and the rows of the class; class_id is a hash of the skeleton. Null
    texts are left out; blank and invisible texts are a class of their own, with an empty skeleton.
    """
    by_source = texts.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("original"), F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min(id).alias("id"))
    originals = by_source.groupBy("original").agg(F.sort_array(F.collect_list(F.struct("source", "n", "id"))).alias("sources"), F.sum("n").alias("n")).withColumn("skeleton", skeleton(F.col("original")))
    classes = originals.groupBy("skeleton").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n_rows"))
    return originals.join(classes, "skeleton").select("original", "skeleton", one_form(F.col("original")).alias("form"), F.md5("skeleton").alias("class_id"), "sources", "spellings", "n_rows")


def look_alikes(df: DataFrame, listed: DataFrame, id: str, text: str, key: str, entry: str) -> DataFrame:
    """(id, key): each row whose text isn't an entry of the list character for character but has the skeleton of one.

    Rows with null id or text give nothing; texts that are blank or invisible look like no entry.
    Repeated rows give one result row; an entry listed twice under one key too, under two keys both.
    """
    entries = listed.select(F.col(key).alias("_key"), F.col(entry).alias("_text")).filter("_key is not null and _text is not null").distinct()
    keyed = entries.select("_key", skeleton(F.col("_text")).alias("_skeleton")).filter("_skeleton <> ''").distinct()
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text")).filter("_id is not null and _text is not null")
    # skeletons are made once per distinct text
    odd = rows.select("_text").distinct().join(entries.select("_text").distinct(), "_text", "left_anti")
    alike = odd.select("_text", skeleton(F.col("_text")).alias("_skeleton")).join(keyed, "_skeleton").select("_text", "_key")
    return rows.join(alike, "_text").select(F.col("_id").alias(id), F.col("_key").alias(key)).distinct()
