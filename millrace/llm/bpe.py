"""Problem 6: token ids of a whole corpus by a public byte-pair vocabulary, from a pair occurrence index.

The vocabulary is read, never trained. A partition's texts are cut into pieces by the vocabulary's
pattern, and each distinct piece is encoded once. All new pieces of a batch lie in one linked list of
symbols; an index maps each adjacent pair to all its places. The pairs' ranks are taken in ascending
order: every place of the lowest active rank is merged, and the pairs that arise enter the lists of
their own ranks. A pair that holds a merged symbol always has a higher rank than the symbol, so one
ascending pass gives what merging piece by piece gives, in time proportional to the merges.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pieces a task remembers; beyond that it forgets them all and encodes them again.
REMEMBERED = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """first: id of each byte; ranks: (left id << 32 | right id) to rank; made: id of the symbol each rank makes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.first = [0] * 256
        for letter, byte in byte_letters().items():
            self.first[byte] = ids[letter]
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]


def encode_pieces(pieces: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each piece, all pieces at once."""
    ranks, made, first = vocabulary.ranks, vocabulary.made, vocabulary.first
    symbols: list[int] = []
    after: list[int] = []
    heads: list[int] = []
    for piece in pieces:
        heads.append(len(symbols))
        symbols += [first[b] for b in piece.encode("utf-8")]
        after += range(len(after) + 1, len(symbols))
        after.append(-1)
    before = [-1] * len(symbols)
    for i, j in enumerate(after):
        if j >= 0:
            before[j] = i

    places: dict[int, list[int]] = defaultdict(list)
    for i, j in enumerate(after):
        if j >= 0 and (rank := ranks.get(symbols[i] << 32 | symbols[j])) is not None:
            places[rank].append(i)
    active = list(places)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        new = made[rank]
        for i in sorted(places.pop(rank)):  # left to right, as overlapping pairs need it
            j = after[i]
            # a place is out of date if one of its symbols has been merged since
            if j < 0 or symbols[i] < 0 or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
                continue
            k = after[j]
            symbols[i], symbols[j], after[i] = new, -1, k
            if k >= 0:
                before[k] = i
                if (r := ranks.get(new << 32 | symbols[k])) is not None:
                    if r not in places:
                        heapq.heappush(active, r)
                    places[r].append(i)
            h = before[i]
            if h >= 0 and (r := ranks.get(symbols[h] << 32 | new)) is not None:
                if r not in places:
                    heapq.heappush(active, r)
                places[r].append(h)

    encoded = []
    for i in heads:
        ids = []
        while i >= 0:
            ids.append(symbols[i])
            i = after[i]
        encoded.append(ids)
    return encoded


class _Codes(dict):
    """Piece to number, numbered as they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _encode(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    cut, known = regex.compile(PATTERN).findall, vocabulary.value
    codes, encoded = _Codes(), []
    for b in batches:
        if len(codes) > REMEMBERED:
            codes, encoded = _Codes(), []
        texts = [[codes[p] for p in cut(t)] if t else [] for t in b.column(1).to_pylist()]
        if len(codes) > len(encoded):
            encoded += encode_pieces(list(codes)[len(encoded) :], known)
        ids = [list(chain.from_iterable([encoded[c] for c in text])) for text in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])


def encode_corpus(df: DataFrame, id: str, text: str, vocabulary_file: str) -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens; an empty list for null and empty texts.

    Texts are encoded as stored and whole; every row gives one, repeated rows and null ids too. An
    empty table gives no rows. The vocabulary file (about 2 MB) is read by the driver and broadcast.
    """
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(vocabulary_file))
    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id), F.col(text)).mapInArrow(lambda batches: _encode(batches, vocabulary), f"id {kind}, ids array<int>").withColumnRenamed("id", id)
