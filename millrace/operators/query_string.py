"""Queries in words over several fields of documents: parsing, matching and ranking.

    query   := clause (OR clause)*
    clause  := factor (AND? factor)*
    factor  := NOT? (field:)? (word | "phrase" | (query))

Words are compared as the tokeniser gives them. A field before a parenthesis holds for all inside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import unicode_words


@dataclass(frozen=True)
class Leaf:
    """One word, or several that must follow each other, in a field."""

    field: str
    words: tuple[str, ...]


@dataclass(frozen=True)
class All:
    """Every part of `wanted`, none of `unwanted`."""

    wanted: tuple
    unwanted: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


_PIECES = re.compile(r'\s*(?:(\()|(\))|(\w+):(?=[\w"(])|"([^"]*)"|([^\s()"]+))')


def parse(text: str, default: str):
    """The tree of a query; words without a field are looked for in `default`. A query must want something: NOT alone is refused."""
    pieces, at = [], 0
    while at < len(text.rstrip()):
        m = _PIECES.match(text, at)
        if not m:
            raise ValueError(f"can't read the query from {text[at:]!r}")
        pieces.append(m)
        at = m.end()
    pieces.reverse()

    def words_of(raw: str) -> tuple[str, ...]:
        return tuple(re.findall(r"[^\W_]+", raw.lower()))

    def factor(field: str):
        m = pieces.pop()
        opening, closing, named, phrase, word = m.groups()
        if word and word.endswith(":"):
            raise ValueError(f"nothing follows {word}")
        if named:
            if not pieces:
                raise ValueError(f"nothing follows {named}:")
            return factor(named)
        if opening:
            inner = either(field)
            if not pieces or not pieces.pop().group(2):
                raise ValueError("a parenthesis isn't closed")
            return inner
        if closing:
            raise ValueError("a parenthesis closes nothing")
        words = words_of(phrase if phrase is not None else word)
        if not words:
            raise ValueError(f"no word in {m.group(0)!r}")
        return Leaf(field, words)

    def ahead(sign: str) -> bool:
        return bool(pieces) and pieces[-1].group(5) == sign

    def every(field: str):
        wanted, unwanted = [], []
        while pieces and not pieces[-1].group(2) and not ahead("OR"):
            if ahead("AND"):
                pieces.pop()
                continue
            no = ahead("NOT")
            if no:
                pieces.pop()
                if not pieces:
                    raise ValueError("nothing follows NOT")
            (unwanted if no else wanted).append(factor(field))
        if not wanted:
            raise ValueError("a query must want something")
        return wanted[0] if len(wanted) == 1 and not unwanted else All(tuple(wanted), tuple(unwanted))

    def either(field: str):
        parts = [every(field)]
        while ahead("OR"):
            pieces.pop()
            parts.append(every(field))
        return parts[0] if len(parts) == 1 else Any(tuple(parts))

    tree = either(default)
    if pieces:
        raise ValueError("a parenthesis closes nothing")
    return tree


def leaves(tree) -> set[Leaf]:
    if isinstance(tree, Leaf):
        return {tree}
    return set().union(*(leaves(t) for t in ((*tree.wanted, *tree.unwanted) if isinstance(tree, All) else tree.parts)))


def occurrences(words: Column, leaf: Leaf) -> Column:
    """How often a leaf's words stand one after the other in an array of words; 0 for null."""
    first, *rest = leaf.words
    if not rest:
        found = F.filter(words, lambda w: w == first)
    else:
        begin = F.size(words) - len(leaf.words)
        places = F.when(begin >= 0, F.sequence(F.lit(0), begin))
        found = F.filter(places, lambda i: reduce(lambda a, b: a & b, [F.get(words, i + j) == w for j, w in enumerate(leaf.words)]))
    return F.coalesce(F.size(found), F.lit(0))


def _matched(tree, times: dict[Leaf, Column]) -> Column:
    if isinstance(tree, Leaf):
        return times[tree] > 0
    if isinstance(tree, Any):
        return reduce(lambda a, b: a | b, [_matched(t, times) for t in tree.parts])
    return reduce(lambda a, b: a & b, [_matched(t, times) for t in tree.wanted] + [~_matched(t, times) for t in tree.unwanted])


def _score(tree, weight: dict[Leaf, Column], times: dict[Leaf, Column]) -> Column:
    if isinstance(tree, Leaf):
        return weight[tree]
    parts = tree.wanted if isinstance(tree, All) else tree.parts
    return reduce(lambda a, b: a + b, [F.when(_matched(t, times), _score(t, weight, times)).otherwise(0.0) for t in parts])


def search(df: DataFrame, id: str, fields: dict[str, Column], text: str, default: str, k: int = 5, stored: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, *stored): the k best rows for a query, ties to the lower id.

    A leaf scores how often it stands in the row times ln(rows / rows that have it); the scores of all
    that is wanted and found add up. Rows with a null field lack its words; an unknown field is
    refused. Words are counted where the row is: nothing but one row of counts and the k best rows of
    each task leaves its place.
    """
    tree = parse(text, default)
    asked = sorted(leaves(tree), key=lambda leaf: (leaf.field, leaf.words))
    if unknown := {leaf.field for leaf in asked} - set(fields):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    # the words go through a generator as one value: they are cut once, and no filter on counts is pushed below it and cuts them again
    words = F.struct(*[unicode_words(c).alias(n) for n, c in fields.items() if n in {leaf.field for leaf in asked}])
    counts = F.transform(F.array(words), lambda w: F.struct(*[occurrences(w[leaf.field], leaf).alias(f"_tf{i}") for i, leaf in enumerate(asked)]))
    counted = df.select(id, *stored, F.inline(counts))
    held = counted.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(asked))])
    times = {leaf: F.col(f"_tf{i}") for i, leaf in enumerate(asked)}
    weight = {leaf: F.col(f"_tf{i}") * F.log(F.col("_n").cast("double") / F.nullif(F.col(f"_df{i}"), F.lit(0))) for i, leaf in enumerate(asked)}
    found = counted.filter(_matched(tree, times)).crossJoin(F.broadcast(held))  # one row
    return found.select(id, F.round(_score(tree, weight, times), 6).alias("score"), *stored).orderBy(F.desc("score"), id).limit(k)
