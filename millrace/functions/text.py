"""String functions as column expressions: normalising, cutting, comparing, linking."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Named entities and what they stand for; the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("\\s", " "), ("&amp;", "&")]


def normalise(text: Column) -> Column:
    """Small letters, runs of white space as one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def strip_punctuation(token: Column) -> Column:
    """A token without punctuation at its ends."""
    return F.regexp_replace(F.regexp_replace(token, r"^[^a-z0-9]+", ""), r"[^a-z0-9]+$", "")


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the text in small letters, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


#: Runs of one Japanese script, which stand for words where no blanks do.
SCRIPT_RUNS = r"([\p{IsHan}々]+|\p{IsHiragana}+|[\p{IsKatakana}ー]+)"


def unicode_words(text: Column) -> Column:
    """Runs of letters and digits of any script in small letters, in order; Japanese is cut where the script changes."""
    apart = F.regexp_replace(F.lower(text), SCRIPT_RUNS, " $1 ")
    return F.filter(F.split(apart, r"[^\p{L}\p{N}\p{M}ー]+"), lambda w: w != "")


def strip_marks(token: Column) -> Column:
    """A token without anything but letters and digits, of any script, at its ends; empty if it has none."""
    return F.regexp_replace(F.regexp_replace(token, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")


def qgrams(text: Column, q: int = 2) -> Column:
    """All runs of q characters, in order; an empty array for shorter texts."""
    n = F.char_length(text)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def prefixes(text: Column) -> Column:
    """All prefixes from one character on."""
    n = F.char_length(text)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def jaccard_estimate(common: Column, a: Column, b: Column) -> Column:
    """Shared bigrams over all bigrams, from the lengths of two texts."""
    return common / (F.char_length(a) + F.char_length(b) - 2 - common)


def unescape(text: Column) -> Column:
    """Text with the named entities decoded."""
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def link(text: Column, pattern: str, base: str) -> Column:
    """Every match of the pattern wrapped in a link to base plus the match."""
    return F.regexp_replace(text, f"({pattern})", f'<a href="{base}$1">$1</a>')


def nth_field(line: Column, separator: str, n: int) -> Column:
    """The n-th field (from 1) of a delimited line."""
    return F.split_part(line, F.lit(separator), F.lit(n))


def ordinary_width(text: Column) -> Column:
    """Full-width and half-width forms as ordinary ones, compatibility forms resolved (NFKC); null stays null."""
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")

    return run(text)
