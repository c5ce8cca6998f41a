"""Queries over whole tables: rows beyond a fixed bound, a language or a short list come out too."""

import random
import re
from datetime import datetime

from millrace.operators import fuzzy
from millrace.plans.catalogue import QUERIES


def folder(spark, path, **tables):
    for name, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def orders(n):
    return [(i, i * 7, datetime(1995, 1, 1)) for i in range(n)], "o_orderkey long, o_custkey long, o_orderdate timestamp"


def test_composite_lookup_has_all_parts_and_orders(spark, rows, tmp_path):
    items = [(1, 5, 2, "R"), (2, 5, 2, "N"), (3, 5000, 2, "N"), (4, 5000, 2, "R"), (5, 5000, 3, "N"), (6, 5000, 2, "A")]
    d = folder(spark, tmp_path, lineitem=(items, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string"))
    assert rows(QUERIES["composite_lookup_all"](spark, d)) == [(5, 2, 2), (5000, 2, 3)]


def test_positional_join_has_all_customers(spark, rows, tmp_path):
    d = folder(spark, tmp_path, orders=orders(40))
    assert rows(QUERIES["positional_join_all"](spark, d)) == sorted([(i, f"{i},{i * 7}") for i in range(40)], key=repr)


def test_positional_read_strides_to_the_last_row(spark, rows, tmp_path):
    d = folder(spark, tmp_path, orders=orders(5300))
    assert rows(QUERIES["positional_read_all"](spark, d)) == sorted([(i, i) for i in range(5, 5300, 97)], key=repr)


def test_point_lookup_asks_up_to_the_largest_key(spark, tmp_path):
    d = folder(spark, tmp_path, customer=([(37, 3), (37 * 6000, 4)], "c_custkey long, c_nationkey int"))
    got = dict(map(tuple, QUERIES["point_lookup_all"](spark, d).collect()))
    assert sorted(got) == list(range(0, 37 * 6000 + 1, 37))
    assert {k: v for k, v in got.items() if v != -1} == {37: 3, 37 * 6000: 4}


def normalised(text):
    return None if text is None else re.sub(r"[ \t\r\n]+", " ", text).strip(" ").lower()


def test_normalised_texts_are_of_every_language(spark, rows, tmp_path):
    made = [(1, " A\t\nB ", "en"), (2, "ÄÖ  ß", "de"), (3, "É", None), (4, None, "fr"), (5, "X\r\n", "EN"), (6, "", "en-EN"), (7, "ΟΔΟΣ \u00a0", "el"), (8, "漢 字", "ja")]
    d = folder(spark, tmp_path, documents=(made, "doc_id long, text string, lang string"))
    assert rows(QUERIES["normalise_text_all"](spark, d)) == sorted([(i, normalised(t)) for i, t, _ in made], key=repr)


def test_normalised_texts_equal_brute_force(spark, rows):
    d = "/root/testdata/sf0.01"
    made = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert rows(QUERIES["normalise_text_all"](spark, d)) == sorted([(r.doc_id, normalised(r.text)) for r in made], key=repr)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_pairs(words, distance):
    words = sorted(words)
    near = ((a, b, levenshtein(a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= distance)
    return sorted(((a, b, n) for a, b, n in near if n <= distance), key=repr)


KEYS = "key_id long, keys string, score int"
DIRTY = [(1, "old", 1), (2, "cold", 1), (2, "cold", None), (3, None, 1), (4, "Gold", 1), (5, "é", 1), (6, "", 1), (7, "hash table", 1), (8, "漢字", 1), (9, "漢", 1), (10, "bash table", 1)]


def test_near_words_equal_brute_force(spark, rows):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé漢") for _ in range(rng.randrange(0, 12))) for _ in range(250)}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    for distance in (0, 1, 2, 3):
        assert rows(fuzzy.within(df, "w", distance)) == near_pairs(words, distance)


def test_near_keywords_may_differ_in_the_first_letter(spark, rows, tmp_path):
    d = folder(spark, tmp_path, correctme=(DIRTY, KEYS))
    got = rows(QUERIES["levenshtein_keys"](spark, d))
    assert ("cold", "old", 1) in got and ("bash table", "hash table", 1) in got
    assert got == near_pairs({k.lower() for _, k, _ in DIRTY if k is not None}, 2)


def test_bigrams_are_of_all_keywords(spark, rows, tmp_path):
    d = folder(spark, tmp_path, correctme=(DIRTY, KEYS))
    grams = {k.lower(): {k.lower()[i : i + 2] for i in range(len(k) - 1)} for _, k, _ in DIRTY if k is not None}
    assert rows(QUERIES["qgram_index_keys"](spark, d)) == sorted(((w, g) for w, gs in grams.items() for g in gs), key=repr)
    shared = [(a, b, len(grams[a] & grams[b])) for a in grams for b in grams if a < b and grams[a] & grams[b]]
    truth = [(a, b, n, round(n / (len(a) + len(b) - 2 - n), 6)) for a, b, n in shared]
    assert rows(QUERIES["jaccard_pairs_keys"](spark, d)) == sorted(truth, key=repr)


def cut(text, keys):
    """Pieces of a text, every second of them a keyword, by brute force."""
    pieces, i, rest = [], 0, ""
    while i < len(text):
        best = max((k for k in keys if k and text.startswith(k, i)), key=len, default="")
        if best:
            pieces += [rest, best]
            rest = ""
        else:
            rest += text[i]
        i += len(best) or 1
    return [*pieces, rest]


def test_keywords_of_the_table_are_found_and_linked(spark, rows, tmp_path):
    texts = ["a cold day, old as gold", "Gold hash table", "no match: zzz", "", None, "漢字漢é", "bash tablecold<old>", "oldold"]
    d = folder(spark, tmp_path, correctme=(DIRTY, KEYS), documents=(list(enumerate(texts)), "doc_id long, text string"))
    pieces = {i: cut(t, {k for _, k, _ in DIRTY if k}) for i, t in enumerate(texts) if t}
    hits = {i: p for i, p in pieces.items() if len(p) > 1}
    assert hits[0][1::2] == ["cold", "old", "old"] and 2 not in hits
    assert rows(QUERIES["dict_longest_match_keys"](spark, d)) == sorted([(i, len(p) // 2, "|".join(p[1::2])) for i, p in hits.items()], key=repr)
    linked = {i: "".join(f'<a href="/k/{x}">{x}</a>' if n % 2 else x for n, x in enumerate(p)) for i, p in hits.items()}
    assert rows(QUERIES["keyword_link_keys"](spark, d)) == sorted(linked.items(), key=repr)
