"""Problem 1: frequency of every distinct term, from bitmaps of record identifiers.

Vertical layout: a term's records are a set of 64-bit identifiers, kept as containers of 65,536
identifiers each (the upper 48 bits are the chunk). A container with fewer than 4,096 members is
their sorted lower 16 bits, two bytes each; a fuller one is a bitmap of 8,192 bytes, so a container
never exceeds 8 KB, however common the term. Beside each container runs the counter of occurrences.
Partial containers are built where the rows are, shuffled by (term, chunk) and merged by union; the
document frequency is the cardinality. No term's records are ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.records import counted_pairs

#: Members from which a container is a bitmap, and its bytes.
DENSE, BITMAP_BYTES = 4096, 8192
#: Rows and bytes a task holds before it writes containers out, and before it merges them.
BLOCK_ROWS, BLOCK_BYTES = 1 << 20, 64 << 20
MERGE_ROWS, MERGE_BYTES = 1 << 17, 16 << 20

PARTIAL = "term string, chunk long, occurrences long, members binary"
TOTALS = "term string, chunk long, occurrences long, cardinality long"
MERGED = f"{TOTALS}, members binary"


def _binary(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def pack(starts: np.ndarray, low: np.ndarray) -> pa.Array:
    """Containers of the groups that begin at `starts` in `low`, which is sorted and distinct in each group."""
    sizes = np.diff(np.append(starts, len(low)))
    dense = np.flatnonzero(sizes >= DENSE)
    if not len(dense):
        return _binary(sizes * 2, low.astype("<u2").view(np.uint8))
    pieces, at = [], 0
    for g in dense:
        first, last = starts[g], starts[g] + sizes[g]
        bits = np.zeros(BITMAP_BYTES * 8, np.uint8)
        bits[low[first:last]] = 1
        pieces += [low[at:first].astype("<u2").view(np.uint8), np.packbits(bits, bitorder="little")]
        at = last
    pieces.append(low[at:].astype("<u2").view(np.uint8))
    return _binary(np.where(sizes >= DENSE, BITMAP_BYTES, sizes * 2), np.concatenate(pieces))


def unpack(members: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(container number, lower 16 bits) of every member of every container."""
    offsets = np.frombuffer(members.buffers()[1], np.int32, len(members) + 1, members.offset * 4)
    data = np.frombuffer(members.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    dense = np.flatnonzero(lengths == BITMAP_BYTES)
    if not len(dense):
        return np.repeat(np.arange(len(members)), lengths // 2), data[offsets[0] : offsets[-1]].view("<u2").astype(np.int64)
    groups, lows = [], []
    for c in range(len(members)):
        part = data[offsets[c] : offsets[c + 1]]
        low = np.flatnonzero(np.unpackbits(part, bitorder="little")) if lengths[c] == BITMAP_BYTES else part.view("<u2").astype(np.int64)
        groups.append(np.full(len(low), c))
        lows.append(low)
    return np.concatenate(groups), np.concatenate(lows)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    """The batches in blocks of about `rows` rows or `size` bytes, whichever comes first."""
    held, n, held_bytes = [], 0, 0
    for batch in batches:
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            b = batch.slice(at, step)
            held.append(b)
            n, held_bytes = n + b.num_rows, held_bytes + b.nbytes
            if n >= rows or held_bytes >= size:
                yield pa.Table.from_batches(held)
                held, n, held_bytes = [], 0, 0
    if n:
        yield pa.Table.from_batches(held)


def build_partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, docno, tf) to containers with counters, a block of rows at a time."""
    for block in _blocks(batches, BLOCK_ROWS, BLOCK_BYTES):
        coded = block["term"].combine_chunks().dictionary_encode()
        code, doc, tf = coded.indices.to_numpy(), block["docno"].to_numpy(), block["tf"].to_numpy()
        order = np.lexsort((doc, code))
        code, doc, tf = code[order], doc[order], tf[order]
        chunk = doc >> 16
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])))
        occurrences = np.add.reduceat(tf, first)
        fresh = np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))
        starts = (np.cumsum(fresh) - 1)[first]
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(code[first])), pa.array(chunk[first]), pa.array(occurrences), pack(starts, (doc & 0xFFFF)[fresh])], names=["term", "chunk", "occurrences", "members"]
        )


def _sparse_union(group: np.ndarray, low: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(cardinality per group, members in order): union of arrays of lower 16 bits; `group` doesn't decrease."""
    member = (group << 16) | low
    if len(member) > 1 and not np.all(member[1:] > member[:-1]):
        member = np.unique(member)
    return np.bincount(member >> 16, minlength=groups), member & 0xFFFF


def _union(block: pa.Table) -> pa.RecordBatch:
    """One row per (term, chunk) of a block that is sorted by them.

    Arrays are merged with arrays. Where a group has a bitmap, its containers are or-ed into one
    bitmap and its bits are counted: a bitmap is never taken apart.
    """
    block = block.combine_chunks()
    term, chunk = block["term"].combine_chunks(), block["chunk"].to_numpy()
    code = term.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
    members = block["members"].combine_chunks()
    offsets = np.frombuffer(members.buffers()[1], np.int32, len(members) + 1, members.offset * 4).astype(np.int64)
    data = np.frombuffer(members.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)

    full = np.flatnonzero(lengths == BITMAP_BYTES)
    dense = np.unique(group[full])  # groups that have a bitmap
    row_of = np.full(len(first), -1)
    row_of[dense] = np.arange(len(dense))
    bitmaps = np.zeros((len(dense), BITMAP_BYTES), np.uint8)
    for c in full:
        bitmaps[row_of[group[c]]] |= data[offsets[c] : offsets[c + 1]]

    arrays = np.flatnonzero(lengths != BITMAP_BYTES)
    if len(full):
        values = np.concatenate([data[offsets[c] : offsets[c + 1]] for c in arrays]) if len(arrays) else data[:0]
    else:
        values = data[offsets[0] : offsets[-1]]
    low = values.view("<u2").astype(np.int64)
    owner = np.repeat(group[arrays], lengths[arrays] // 2)
    beside = row_of[owner] >= 0
    if beside.any():
        np.bitwise_or.at(bitmaps, (row_of[owner[beside]], low[beside] >> 3), (1 << (low[beside] & 7)).astype(np.uint8))
        owner, low = owner[~beside], low[~beside]
    cardinality, low = _sparse_union(owner, low, len(first))
    starts = np.cumsum(cardinality) - cardinality
    if len(dense):
        merged = _interleave(dense, bitmaps, cardinality, starts, low)
        cardinality[dense] = np.bitwise_count(bitmaps.view(np.uint64)).sum(axis=1, dtype=np.int64)
    else:
        merged = pack(starts, low)
    return pa.RecordBatch.from_arrays(
        [term.take(pa.array(first)), pa.array(chunk[first]), pa.array(np.add.reduceat(block["occurrences"].to_numpy(), first)), pa.array(cardinality), merged],
        names=["term", "chunk", "occurrences", "cardinality", "members"],
    )


def _interleave(dense: np.ndarray, bitmaps: np.ndarray, sizes: np.ndarray, starts: np.ndarray, low: np.ndarray) -> pa.Array:
    """The containers in order of their groups: bitmaps of the groups in `dense`, packed arrays of all others between them."""
    pieces, done = [], 0
    for g, bits in zip(dense.tolist(), bitmaps, strict=True):
        if g > done:
            pieces.append(pack(starts[done:g] - starts[done], low[starts[done] : starts[g]]))
        pieces.append(_binary(np.array([BITMAP_BYTES]), bits))
        done = g + 1
    if done < len(sizes):
        pieces.append(pack(starts[done:] - starts[done], low[starts[done] :]))
    return pa.concat_arrays(pieces)


def merge_partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the containers of each (term, chunk); the input is sorted by them within the partition."""
    rest = None
    for block in _blocks(batches, MERGE_ROWS, MERGE_BYTES):
        if rest is not None:
            block = pa.concat_tables([rest, block])
        last = block.num_rows - 1
        other = np.flatnonzero(~pc.equal(block["term"], block["term"][last]).to_numpy() | (block["chunk"].to_numpy() != block["chunk"][last].as_py()))
        cut = int(other[-1]) + 1 if len(other) else 0
        # the rows from `cut` on are of the last (term, chunk), which may go on in the next block
        rest = block.slice(cut)
        if cut:
            yield _union(block.slice(0, cut))
        if rest.num_rows > 64:  # many partial containers of one key: fold them, so that memory stays bounded
            rest = pa.Table.from_batches([_union(rest)]).drop_columns(["cardinality"])
    if rest is not None and rest.num_rows:
        yield _union(rest)


def _merge_to_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """merge_partials without the containers, for those who need their cardinality only."""
    for b in merge_partials(batches):
        yield b.drop_columns(["members"])


def term_bitmaps(pairs: DataFrame, members: bool = True) -> DataFrame:
    """(term, chunk, occurrences, cardinality, members) from pairs (docno, term, tf) of records and terms; members False leaves the containers out."""
    partial = pairs.select("term", F.col("docno").cast("long"), F.col("tf").cast("long")).mapInArrow(build_partials, PARTIAL)
    return partial.repartition("term", "chunk").sortWithinPartitions("term", "chunk").mapInArrow(*((merge_partials, MERGED) if members else (_merge_to_totals, TOTALS)))


def term_frequencies(rows: DataFrame, rare: int = 2, common: float = 0.4, **columns: str) -> DataFrame:
    """(term, occurrences, df, mark): how often each term occurs, in how many records, and whether that is too rare or too common.

    mark is `rare` for terms of at most `rare` records, else `common` for terms of more than `common`
    of all records, else null. Rows are counted as counted_pairs says: nulls, tf below one and
    repeated rows don't count; an empty table gives no rows.
    """
    counted = counted_pairs(rows, **columns)
    totals = term_bitmaps(counted.pairs, members=False).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("cardinality").alias("df"))
    mark = F.when(F.col("df") <= rare, "rare").when(F.col("df") > common * counted.records, "common")
    return totals.withColumn("mark", mark)
