import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.leakage import FMIndex, Phrases, find_in_shard, find_leaks, merge_spans, removal_spans, suffix_array, words_of


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), max_size=40), min_size=1, max_size=6), st.integers(1, 4))
def test_index_finds_every_occurrence(texts, size):
    sequence = np.array([x for t in texts for x in (*t, 0)], np.int64)
    index = FMIndex(sequence, 5)
    assert sorted(index.locate(np.arange(len(sequence)))) == list(range(len(sequence)))
    whole = sequence.tolist()
    phrases = {tuple(whole[i : i + size]) for i in range(len(whole) - size + 1)} | {(1,) * size, (5,) * size}
    phrases = [p for p in phrases if 0 not in p]
    if not phrases:
        return
    low, high = index.search(np.array(phrases))
    for p, a, b in zip(phrases, low, high, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(whole) - size + 1) if tuple(whole[i : i + size]) == p]


def test_suffix_order():
    rng = np.random.default_rng(2)
    s = np.append(rng.integers(1, 4, 300), 0)
    assert suffix_array(s).tolist() == sorted(range(301), key=lambda i: s[i:].tolist())


def test_words():
    assert words_of("a­b ÉTÉ ét Ѕtop") == ["ab", "été", "ét", "stop"]
    assert words_of("a\x07b\nc") == words_of("ab c") == ["ab", "c"]


def leaked(spark, docs, items, **options):
    a = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, passage int, spans int")
    b = spark.createDataFrame([(i, p, 1, 2) for i, p in items], "item_id long, passage string, id int, text int")
    return find_leaks(a, b, "doc_id", "text", "item_id", "passage", **options)


def test_cases(spark, rows):
    words = [f"w{i}" for i in range(30)]
    passage = " ".join(words)
    docs = [
        (1, "x " + " ".join(words[5:17]) + " y"), (2, " ".join(words[5:16])), (3, None), (4, ""), (5, ", ".join(words).upper() + "!"), (6, " ".join(words[:14] + ["z"] + words[14:28])),
        (7, " ".join(words[:12]) + " q " + passage), (None, passage), (8, "q " * 20_000 + passage), (9, passage), (9, passage), (10, "no words of it " * 4000),
    ]
    items = [(1, passage), (1, passage), (2, passage.title()), (3, None), (4, "too short"), (None, passage), (5, " ".join(reversed(words)))]
    found = leaked(spark, docs, items)
    spans = {(r.doc_id, r.item_id): [(s.start, s.end) for s in r.spans] for r in found.collect()}
    assert spans[1, 1] == [(1, 13)] and spans[6, 2] == [(0, 14), (15, 29)] and spans[7, 1] == [(0, 12), (13, 43)] and spans[8, 1] == [(20_000, 20_030)]
    assert set(spans) == {(d, i) for d in (1, 5, 6, 7, 8, 9) for i in (1, 2)}
    assert found.filter("doc_id = 9 and item_id = 1").count() == 2  # a repeated row repeats its result
    assert (7, 0, 12) in rows(removal_spans(found, "doc_id")) and (9, 0, 30) in rows(removal_spans(found, "doc_id"))


def test_empty_sides(spark):
    assert leaked(spark, [], [(1, "a " * 12)]).collect() == []
    assert leaked(spark, [(1, "a " * 12)], []).collect() == []
    assert leaked(spark, [(1, None)], [(1, "a " * 12)]).collect() == []


def test_shards_against_brute_force():
    rng = random.Random(4)
    passages = [[rng.choice("abcdef") for _ in range(40)] for _ in range(10)]
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(200))] for _ in range(60)]
    for t in texts[::3]:
        p = rng.choice(passages)
        t[10:10] = p[5 : 5 + rng.randrange(3, 30)]
    phrases = Phrases(passages, 8)
    coded = [[phrases.numbers.get(w, 1) for w in t] for t in texts]
    truth = {(t, p, i) for t, x in enumerate(texts) for p, y in enumerate(passages) for i in range(len(x) - 7) for j in range(len(y) - 7) if x[i : i + 8] == y[j : j + 8]}
    assert set(find_in_shard(coded, phrases)) == truth


def test_spans_merge():
    assert merge_spans([3, 1, 2, 30], 12) == [{"start": 1, "end": 15}, {"start": 30, "end": 42}]


def test_whole_table_against_brute_force(spark, rows):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    held: dict[tuple, set] = {}
    for r in items.collect():
        w = words_of(r.passage)
        for i in range(len(w) - 11):
            held.setdefault(tuple(w[i : i + 12]), set()).add(r.item_id)
    truth = set()
    for r in docs.filter("text is not null").collect():
        w = words_of(r.text)
        truth |= {(r.doc_id, x) for i in range(len(w) - 11) for x in held.get(tuple(w[i : i + 12]), ())}
    assert set(rows(find_leaks(docs, items, "doc_id", "text", "item_id", "passage").select("doc_id", "item_id").distinct())) == truth and truth


def test_slices_of_the_passages_give_the_same_rows(spark, rows):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(25)]
    items += [(100, items[3][1]), (101, None), (None, "a b c d")]
    docs = []
    for i in range(60):
        text = [word() for _ in range(20)]
        for _ in range(2):
            passage = rng.choice(items[:25])[1].split(" ")
            at = rng.randrange(len(passage))
            text += passage[at : at + 9] + [word()]
        docs.append((i, " ".join(text)))
    whole = rows(leaked(spark, docs, items, words=4))
    assert whole and rows(leaked(spark, docs, items, words=4, slice_words=40)) == whole


def test_one_slice_for_every_passage(spark, rows):
    items = [(1, "a b c d e"), (2, "c d e f g"), (3, "x y z w")]
    docs = [(1, "o a b c d e f g o x y z w"), (2, "a b c")]
    whole = rows(leaked(spark, docs, items, words=3))
    assert len(whole) == 4 and rows(leaked(spark, docs, items, words=3, slice_words=1)) == whole


def test_marks_rank():
    from millrace.llm.leakage import Marks

    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 1000):
        marked = rng.random(n) < 0.3
        marks, at = Marks(marked), np.arange(n)
        assert marks.has(at).tolist() == marked.tolist()
        assert marks.rank(at).tolist() == (np.cumsum(marked) - marked).tolist()
