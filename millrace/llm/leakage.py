"""Problem 7: passages of held-out items in a training corpus, by an FM-index per shard of the corpus.

Texts become sequences of words (runs of letters and digits in one form, without regard to case).
A shard is a run of whole texts, written as one sequence over the words the passages use; stretches
of other words become one symbol that no phrase holds, and texts are set apart by separators. The
shard's suffix array gives the Burrows-Wheeler transform, which a wavelet matrix holds; all phrases
(every run of `words` words of a passage) are searched backwards in it together, their occurrences
are located by sampled suffix positions, and overlapping occurrences are merged into removal spans.

The query set (the passages) is given to every task in slices of a bounded number of words; the corpus
is read once per slice, in place, without a shuffle before the matches. Only a slice at a time is on
the driver.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.forms import CASELESS, form_of
from millrace.session import ensure_checkpoints

OTHER, SEPARATOR = 1, 0
#: Words of a shard, and the distance of sampled suffix positions.
SHARD_WORDS, SAMPLE = 400_000, 16
#: Words of passages that one slice of the query set has, about. Each begins a phrase of 12 numbers: 25 MB in a task, some 100 MB while the driver builds it.
SLICE_WORDS = 250_000

_WORDS = re.compile(r"[^\W_]+").findall
_PLAIN = re.compile(r"[\t-\r -~]*").fullmatch
_CASELESS = str.maketrans(CASELESS)
_TWINS = re.compile(f"[{''.join(CASELESS)}]").search


def words_of(text: str) -> list[str]:
    """The words of a text in one form, without regard to case."""
    if _PLAIN(text):
        return _WORDS(text.lower())
    text = form_of(text).casefold()
    return _WORDS(text.translate(_CASELESS) if _TWINS(text) else text)


class Phrases:
    """The distinct phrases of a set of passages: word numbers from 2 on, phrases as rows of numbers, and each phrase's passages."""

    def __init__(self, passages: list[list[str]], words: int):
        self.words = words
        self.numbers: dict[str, int] = {}
        owners: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for p, passage in enumerate(passages):
            if len(passage) < words:
                continue
            coded = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in passage]
            for phrase in {tuple(coded[i : i + words]) for i in range(len(coded) - words + 1)}:
                owners[phrase].append(p)
        self.rows = np.array(list(owners), np.int64).reshape(-1, words)
        self.owners = list(owners.values())


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; every separator counts as another symbol, in order of place."""
    separators = np.flatnonzero(sequence == SEPARATOR)
    rank = sequence + len(separators)
    rank[separators] = np.arange(len(separators))
    n, step = len(rank), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-step] = rank[step:] + 1
        keys = rank * (int(rank.max()) + 2) + second
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        if fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2
        if step >= n:
            return order


class WaveletMatrix:
    """rank() over a sequence of small numbers: one bit vector with running counts per binary digit."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.shifts = range(max(1, int(top).bit_length()) - 1, -1, -1)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for shift in self.shifts:
            bits = (sequence >> shift) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, end = np.zeros_like(before), before
        for shift, ones, zeros in zip(self.shifts, self.ones, self.zeros, strict=True):
            bit = ((symbol >> shift) & 1).astype(bool)
            start = np.where(bit, zeros + ones[start], start - ones[start])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - start


class Marks:
    """A set of places with rank(): a bit each, and a running count per 64 of them."""

    def __init__(self, marked: np.ndarray):
        bits = np.zeros(-(-len(marked) // 64) * 64, np.uint8)
        bits[: len(marked)] = marked
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def has(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked places lie before each place."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


class FMIndex:
    """Backward search and location in one sequence whose texts all end with a separator."""

    def __init__(self, sequence: np.ndarray, top: int):
        order = suffix_array(sequence)
        previous = np.where(order > 0, order - 1, len(sequence) - 1)
        self.last = sequence[previous]
        self.matrix = WaveletMatrix(self.last, top)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=top + 2))])
        text_start = np.zeros(len(sequence), bool)
        text_start[0] = True
        text_start[1:] = sequence[:-1] == SEPARATOR
        kept = (order % SAMPLE == 0) | text_start[order]  # a walk back never crosses a separator
        self.sampled, self.position = Marks(kept), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that begin with each phrase."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.smaller[symbol] + self.matrix.rank(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.matrix.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        found = np.zeros(len(phrases), bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of each suffix row."""
        steps, at = np.zeros(len(rows), np.int64), rows.copy()
        while len(walking := np.flatnonzero(~self.sampled.has(at))):
            symbol = self.last[at[walking]]
            at[walking] = self.smaller[symbol] + self.matrix.rank(symbol, at[walking])
            steps[walking] += 1
        return self.position[self.sampled.rank(at)] + steps


def find_in_shard(texts: list[list[int]], phrases: Phrases) -> Iterator[tuple[int, int, int]]:
    """(text, passage, word place) of every phrase occurrence. texts: word numbers, OTHER where no passage has the word."""
    symbols, places, lengths = [], [], []
    for text in texts:
        numbers = np.array(text, np.int64)
        keep = np.ones(len(numbers), bool)
        keep[1:] = (numbers[1:] != OTHER) | (numbers[:-1] != OTHER)
        symbols += [numbers[keep], np.array([SEPARATOR])]
        places += [np.flatnonzero(keep), np.array([len(numbers)])]
        lengths.append(int(keep.sum()) + 1)
    if not symbols or not len(phrases.rows):
        return
    index = FMIndex(np.concatenate(symbols), len(phrases.numbers) + 1)
    low, high = index.search(phrases.rows)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    if not len(which):
        return
    rows = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = index.locate(rows)
    ends = np.cumsum(lengths)
    text, place = np.searchsorted(ends, at, "right"), np.concatenate(places)[at]
    for w, t, p in zip(which.tolist(), text.tolist(), place.tolist(), strict=True):
        for passage in phrases.owners[w]:
            yield t, passage, p


def merge_spans(starts: list[int], words: int) -> list[dict[str, int]]:
    """Runs of words that phrases of `words` words at these places cover."""
    spans: list[dict[str, int]] = []
    for s in sorted(set(starts)):
        if spans and s <= spans[-1]["end"]:
            spans[-1]["end"] = s + words
        else:
            spans.append({"start": s, "end": s + words})
    return spans


def _shards(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[tuple[list, list[list[int]]]]:
    number = phrases.numbers.get
    ids, texts, size = [], [], 0
    for b in batches:
        for id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = [number(w, OTHER) for w in words_of(text)]
            if len(words) < phrases.words:
                continue
            ids.append(id)
            texts.append(words)
            size += len(words) + 1
            if size >= SHARD_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _find(batches: Iterator[pa.RecordBatch], shared, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    phrases, names = shared.value
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for ids, texts in _shards(batches, phrases):
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        for text, passage, place in find_in_shard(texts, phrases):
            found[text, passage].append(place)
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[t] for t, _ in keys], id_type), pa.array([names[p] for _, p in keys], pa.string()), pa.array([merge_spans(found[k], phrases.words) for k in keys], spans)],
            names=["id", "passage", "spans"],
        )


@F.pandas_udf(T.StringType())
def _joined_words(passages: pd.Series) -> pd.Series:
    return passages.map(lambda p: " ".join(words_of(p)), na_action="ignore")


def find_leaks(corpus: DataFrame, items: DataFrame, id: str, text: str, item: str, passage: str, words: int = 12, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(id, item, spans): each text that holds at least `words` consecutive words of an item's passage.

    spans are the leaked runs of words [start, end), counted from 0 in the text. Items that share a
    passage are all reported; passages of fewer words can't leak. Rows with null id, text, item or
    passage give nothing; repeated rows give repeated results only if their ids repeat. The items
    are the query set: the driver reads the distinct passages in slices of about `slice_words` words
    and sends each to the tasks of one pass over the corpus. An empty side gives no rows.
    """
    spark = corpus.sparkSession
    ensure_checkpoints(spark)
    listed = items.select(F.col(item).alias("item"), F.col(passage).alias("text")).filter("item is not null and text is not null").distinct()
    owners = listed.select("item", _joined_words("text").alias("joined")).select("item", "joined", F.md5("joined").alias("passage")).checkpoint()
    distinct = owners.groupBy("passage").agg(F.first("joined").alias("joined")).withColumn("n", F.size(F.split("joined", " "))).filter(F.col("n") >= words)
    held = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = max(1, -(-held // slice_words))
    id_type = corpus.schema[id].dataType
    arrow_type, schema = to_arrow_type(id_type), f"id {id_type.simpleString()}, passage string, spans array<struct<start:int,end:int>>"
    texts = corpus.select(F.col(id), F.col(text)).filter(F.col(id).isNotNull() & F.col(text).isNotNull())

    def one_slice(number: int) -> DataFrame:
        own = distinct.filter(F.pmod(F.xxhash64("passage"), F.lit(slices)) == number).select("passage", "joined").collect()
        shared = spark.sparkContext.broadcast((Phrases([r.joined.split(" ") for r in own], words), [r.passage for r in own]))
        return texts.mapInArrow(lambda batches: _find(batches, shared, arrow_type), schema)

    found = reduce(DataFrame.unionByName, map(one_slice, range(slices)))
    return found.join(owners.select("passage", "item"), "passage").select(F.col("id").alias(id), F.col("item").alias(item), "spans")


def removal_spans(leaks: DataFrame, id: str) -> DataFrame:
    """(id, start, end): the words to remove from each text, overlapping spans of several items merged."""
    flat = leaks.select(id, F.explode("spans").alias("s")).select(id, "s.start", "s.end").distinct()
    order = Window.partitionBy(id).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = flat.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    return begins.withColumn("run", F.sum("new").over(order)).groupBy(id, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
