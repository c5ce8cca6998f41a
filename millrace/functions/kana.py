"""Kana: as katakana by expressions, in Latin letters by rule from the character database."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hiragana and their katakana, which lie a fixed distance above.
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(chr(ord(c) + 0x60) for c in HIRAGANA)

# Syllables whose usual spelling isn't that of the character database.
SPELLING = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}


def katakana(text: Column) -> Column:
    """Hiragana as katakana; all else as it is."""
    return F.translate(text, HIRAGANA, KATAKANA)


@cache
def _syllable(ch: str) -> str | None:
    """Latin letters of a full-size kana; None for other characters."""
    name = unicodedata.name(ch, "")
    if not name.startswith(("HIRAGANA LETTER ", "KATAKANA LETTER ")) or " SMALL " in name:
        return None
    sound = name.rsplit(" ", 1)[1].lower()
    return SPELLING.get(sound, sound)


@cache
def _small(ch: str) -> str | None:
    """The sound of a small kana; None for other characters."""
    name = unicodedata.name(ch, "")
    return name.rsplit(" ", 1)[1].lower() if name.startswith(("HIRAGANA LETTER SMALL ", "KATAKANA LETTER SMALL ")) else None


def romanise(text: str) -> str:
    """Kana in Latin letters: small kana change the syllable before, a small tu doubles the next consonant, a long mark the vowel before."""
    out: list[str] = []
    double = False
    for ch in text:
        syllable, small = _syllable(ch), _small(ch)
        if small == "tu":
            double = True
            continue
        if small and out and out[-1][-1:] in "aiueo":
            stem = out[-1][:-1]
            out[-1] = stem + (small[1:] if small[0] == "y" and stem in ("sh", "ch", "j") else small)
        elif small:
            out.append(small)
        elif syllable:
            out.append((syllable[0] if double and syllable[0] not in "aiueo" else "") + syllable)
        elif ch == "ー" and out and out[-1][-1:] in "aiueo":
            out.append(out[-1][-1])
        else:
            out.append(ch)
        double = False
    return "".join(out)


@F.pandas_udf(T.StringType())
def _romanised(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else romanise(unicodedata.normalize("NFKC", t)), na_action="ignore")


def romanised(text: Column) -> Column:
    """Kana of a text in Latin letters, wide and narrow forms as ordinary ones; null stays null."""
    return _romanised(text)
