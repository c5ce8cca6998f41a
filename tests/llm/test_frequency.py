import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.frequency import build_partials, merge_partials, pack, term_frequencies, unpack
from millrace.llm.records import counted_pairs, with_record_totals

ROWS = [
    (1, 1, "a", "The", 2),
    (1, 1, "a", "The", 2),  # sent again
    (2, 1, "a", " the, ", 3),
    (3, 2, "a", "the", 1),
    (4, 3, "a", "The.", 1),
    (5, 3, None, "rare", 4),
    (6, None, "a", "the", 1),
    (7, 4, "a", None, 1),
    (8, 4, "a", "...", 1),
    (9, 4, "a", "the", 0),
    (10, 4, "a", "the", None),
    (11, 5, "a", "", 1),
    (None, 6, "a", "other", 1),
    (None, 6, "a", "other", 1),
]


def test_counts_marks_and_dirt(nb, rows):
    assert rows(term_frequencies(nb(ROWS), rare=1)) == [("other", 2, 1, "rare"), ("rare", 4, 1, "rare"), ("the", 7, 3, "common")]


def test_empty_table(nb, rows):
    assert rows(term_frequencies(nb([]))) == []


def test_null_only_table(nb, rows):
    assert rows(term_frequencies(nb([(None, None, None, None, None)]))) == []


def test_ties_and_threshold(nb, rows):
    made = [(i, i, "c", "half", 1) for i in range(4)] + [(10 + i, 10 + i, "c", f"t{i}", 1) for i in range(6)]
    found = {r[0]: r[3] for r in rows(term_frequencies(nb(made)))}
    assert found["half"] is None  # exactly 40 % of ten records is not more than 40 %


def test_long_token_and_wide_identifiers(nb, rows):
    long = "x" * 40_000
    made = [(1, -1, "c", long, 1), (2, 1 << 40, "c", long, 2), (3, (1 << 40) + 1, "c", long, 3)]
    assert rows(term_frequencies(nb(made))) == [(long, 6, 3, "common")]


def test_hot_record_is_spread_and_summed(nb, rows, spark):
    made = [(i, 1, "c", f"w{i % 50}", 1) for i in range(600)] + [(1000 + i, 2 + i, "c", "w0", 1) for i in range(300)]
    counted = counted_pairs(nb(made))
    assert counted.profile.hot == (1,) and counted.records == 301
    totals = {(r.docno, r.term): (r.tf, r.total) for r in with_record_totals(counted).collect()}
    assert totals[1, "w3"] == (12, 600) and totals[5, "w0"] == (1, 1)
    assert {r[0]: (r[1], r[2]) for r in rows(term_frequencies(nb(made)))}["w0"] == (312, 301)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 65535), min_size=1, max_size=60), min_size=1, max_size=5), st.booleans())
def test_containers_round_trip(groups, dense):
    if dense:
        groups.append(set(range(0, 65536, 7)))
    low = np.concatenate([np.sort(np.fromiter(g, np.int64)) for g in groups])
    starts = np.cumsum([0] + [len(g) for g in groups])[:-1]
    owner, members = unpack(pack(starts, low))
    assert [set(members[owner == i]) for i in range(len(groups))] == groups


def test_union_of_partials_is_the_set_union():
    rng = np.random.default_rng(3)
    truth, parts = {}, []
    for _ in range(6):
        terms, docs = rng.choice(["a", "b", "c"], 5000), rng.integers(0, 200_000, 5000)
        for t, d in zip(terms, docs):
            truth.setdefault(t, set()).add(int(d))
        batch = pa.RecordBatch.from_arrays([pa.array(terms), pa.array(docs), pa.array(np.ones(5000, np.int64))], names=["term", "docno", "tf"])
        parts += list(build_partials(iter([batch])))
    table = pa.Table.from_batches(parts).sort_by([("term", "ascending"), ("chunk", "ascending")])
    for size in (3, 1000):
        merged = pa.Table.from_batches(merge_partials(iter(table.to_batches(max_chunksize=size)))).group_by("term").aggregate([("cardinality", "sum"), ("occurrences", "sum")])
        got = {r["term"]: (r["cardinality_sum"], r["occurrences_sum"]) for r in merged.to_pylist()}
        assert {t: n for t, (n, _) in got.items()} == {t: len(s) for t, s in truth.items()}
        assert sum(o for _, o in got.values()) == 30_000


@pytest.mark.parametrize("name", ["p1_found", "p1_frequencies"])
def test_query_equals_sql(spark, rows, name):
    from tests.llm.test_llm_queries import against_sql

    against_sql(spark, rows, name)


def _containers(sets):
    """Partial containers (term, chunk 0) of sets of lower 16 bits."""
    low = np.concatenate([np.sort(np.fromiter(s, np.int64)) for _, s in sets])
    starts = np.cumsum([0] + [len(s) for _, s in sets])[:-1]
    n = len(sets)
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in sets]), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, np.int64)), pack(starts, low)], names=["term", "chunk", "occurrences", "members"])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from([7, 13, 1000, 30_000]), st.integers(0, 60)), min_size=1, max_size=12), st.integers(1, 4))
def test_union_of_arrays_and_bitmaps_is_the_set_union(drawn, size):
    sets = sorted(((t, set(range(start, 65536, step))) for t, step, start in drawn), key=lambda x: x[0])
    truth = {}
    for t, s in sets:
        truth.setdefault(t, set()).update(s)
    merged = pa.Table.from_batches(merge_partials(iter(pa.Table.from_batches([_containers(sets)]).to_batches(max_chunksize=size))))
    owner, low = unpack(merged["members"].combine_chunks())
    assert {t: set(low[owner == i].tolist()) for i, t in enumerate(merged["term"].to_pylist())} == truth
    assert merged["cardinality"].to_pylist() == [len(truth[t]) for t in merged["term"].to_pylist()]
    assert sum(merged["occurrences"].to_pylist()) == len(sets)


def test_full_containers_merge_without_being_taken_apart():
    import time
    import tracemalloc

    full = _containers([(f"t{i // 2:03}", range(65536)) for i in range(512)])
    tracemalloc.start()
    began = time.perf_counter()
    merged = pa.Table.from_batches(merge_partials(iter([full])))
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert merged["cardinality"].to_pylist() == [65536] * 256
    assert took < 0.5 and peak < 50 << 20


def test_rare_terms_of_one_chunk_merge_by_columns():
    import time

    n = 1 << 17
    batch = pa.RecordBatch.from_arrays([pa.array([f"t{i:07}" for i in range(n)]), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, np.int64)), pack(np.arange(n), np.arange(n) & 0xFFFF)], names=["term", "chunk", "occurrences", "members"])
    began = time.perf_counter()
    merged = sum(b.num_rows for b in merge_partials(iter([batch])))
    assert merged == n and time.perf_counter() - began < 1


def test_blocks_are_bounded_by_bytes():
    from millrace.llm.frequency import _blocks

    batch = _containers([(f"t{i:03}", range(65536)) for i in range(100)])
    sizes = [t.nbytes for t in _blocks(iter([batch]), 1 << 17, 100_000)]
    assert max(sizes) < 200_000 and len(sizes) > 4
