"""Positional inverted index: build, merge of segments, term and phrase search, ranking, dictionary match."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import words


def tokenise(df: DataFrame, id: str, text: str, cut: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, pos, term): words in order, from 0. cut: another expression that gives the words as an array, such as an analyser's."""
    tokens = words(F.col(text)) if cut is None else cut
    return df.select(id, *keep, F.posexplode(tokens).alias("pos", "term")).withColumn("pos", F.col("pos").cast("bigint"))


def char_offsets(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, pos, term, offset): runs of non-blanks with their character offset in the text, white space counted."""
    pieces = df.select(id, F.regexp_extract_all(text, F.lit(r"([ \t\r\n]*[^ \t\r\n]+)"), 1).alias("_p"))
    rows = pieces.select(id, F.posexplode("_p").alias("pos", "_piece"))
    end = F.sum(F.char_length("_piece")).over(Window.partitionBy(id).orderBy("pos"))
    term = F.regexp_replace("_piece", r"^[ \t\r\n]+", "")
    return rows.select(id, F.col("pos").cast("bigint"), F.lower(term).alias("term"), (end - F.char_length(term)).cast("bigint").alias("offset"))


def inverted_index(tokens: DataFrame, id: str, place: str = "pos") -> DataFrame:
    """(term, id, tf, positions), one posting a row: a common term's postings stay spread over tasks."""
    return tokens.groupBy("term", id).agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list(place)).alias("positions"))


def merge_segments(segments: Iterable[DataFrame], id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One index from several: postings of the same term and document are joined, their positions in order. keep: columns that keep postings apart."""
    merged = None
    for s in segments:
        merged = s if merged is None else merged.unionByName(s)
    return merged.groupBy(*keep, "term", id).agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def term_lookup(index: DataFrame, term: str) -> DataFrame:
    return index.filter(F.col("term") == term)


def phrase(tokens: DataFrame, id: str, first: str, second: str, place: str = "pos", by_length: bool = False) -> DataFrame:
    """(id, at): places where `second` follows `first`: at the next place, or by_length at first's place plus its characters."""
    step = F.char_length(F.lit(first)) if by_length else F.lit(1)
    a = tokens.filter(F.col("term") == first).select(id, F.col(place).alias("at"), (F.col(place) + step).alias("_next"))
    b = tokens.filter(F.col("term") == second).select(id, F.col(place).alias("_next"))
    return a.join(b, [id, "_next"]).select(id, "at").distinct()


def both_terms(index: DataFrame, id: str, first: str, second: str) -> DataFrame:
    """Documents that hold both terms."""
    return index.filter(F.col("term") == first).select(id).join(index.filter(F.col("term") == second).select(id), id, "left_semi")


def ranked_hits(index: DataFrame, documents: int, id: str, terms: list[str], k: int = 5) -> DataFrame:
    """(id, score): the k best documents by the sum of tf * ln(documents / df) over the terms, ties to the lower id."""
    hits = index.filter(F.col("term").isin(terms)).select("term", id, "tf")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, "term").groupBy(id).agg(F.round(F.sum(F.col("tf") * F.log(F.lit(float(documents)) / F.col("df"))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), id).limit(k)


def _finder(dictionary: list[str]):
    """A function of a text: (start, end) of the entries in it, left to right, the longest at each place, without overlap."""
    trie: dict = {}
    for entry in dictionary:
        node = trie
        for ch in entry:
            node = node.setdefault(ch, {})
        if entry:
            node[""] = True

    def find(text: str) -> list[tuple[int, int]]:
        out, i = [], 0
        while i < len(text):
            node, end, j = trie, 0, i
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    end = j
            if end:
                out.append((i, end))
            i = end or i + 1
        return out

    return find


def longest_matches(dictionary: list[str]):
    """A column function: entries found left to right, the longest at each place, without overlap.

    dictionary is the query set and goes to every task; it is held as a trie of dictionaries.
    """
    find = _finder(dictionary)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [t[i:j] for i, j in find(t)], na_action="ignore")

    return run


def linked(dictionary: list[str], base: str):
    """A column function: the text with the entries of longest_matches wrapped in links to base plus the entry; null where there is none."""
    find = _finder(dictionary)

    def link(text: str) -> str | None:
        out, at = [], 0
        for i, j in find(text):
            out += [text[at:i], f'<a href="{base}{text[i:j]}">{text[i:j]}</a>']
            at = j
        return "".join([*out, text[at:]]) if out else None

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(link, na_action="ignore")

    return run


def alternation(dictionary: list[str]) -> str:
    """A regular expression that matches the longest entry first; entries must be free of its signs."""
    return "|".join(sorted(dictionary, key=lambda e: (-len(e), e)))
