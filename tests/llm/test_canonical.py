import random

import pytest

from millrace.llm.canonical import map_to_list

LISTED = "key_id long, keys string, score int, typed string"
ASKED = "query_id long, queries string, form string, slips int"


def slips(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    last, far = {}, len(a) + len(b)
    h = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        h[i + 1][1] = i
    for j in range(len(b) + 1):
        h[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            h[i + 1][j + 1] = min(h[i][j] + cost, h[i + 1][j] + 1, h[i][j + 1] + 1, h[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return h[-1][-1]


def mapped(spark, asked, listed):
    a = spark.createDataFrame([(i, q, "x", 9) for i, q in asked], ASKED)
    b = spark.createDataFrame([(k, e, 1, "y") for k, e in listed], LISTED)
    return {r.query_id: r.key_id for r in map_to_list(a, b, "query_id", "queries", "key_id", "keys").collect()}


def test_cases(spark):
    listed = [(1, "Kezos"), (2, "drimetrir bovu"), (3, "surulivas"), (3, "surulivas"), (4, None), (None, "nothing"), (5, "Rugоris-676-No"), (6, "цветочная")]
    asked = [
        (1, "KEZOS"), (2, "kezo"), (3, "bovu drimetrir"), (4, "bovudrimetrir!"), (5, "sruulivsa"), (6, "surulvas"), (7, "sxruxivxs"), (8, "surulivas"), (9, None), (10, "  "), (11, "​"),
        (12, "🙂"), (13, "rugoris676no"), (14, "ЦВЕТОЧНАЯ"), (15, "х" * 40_000), (16, "ｓurulivás"), (16, "ｓurulivás"), (17, "surulivasab"), (18, "urulivasx"), (None, "surulivax"),
    ]
    assert mapped(spark, asked, listed) == {1: 1, 2: -1, 3: 2, 4: 2, 5: 3, 6: 3, 7: -1, 12: -1, 13: 5, 14: 6, 15: -1, 16: 3, 17: 3, 18: 3}


def test_empty_sides(spark):
    assert mapped(spark, [], [(1, "surulivas")]) == {}
    assert mapped(spark, [(1, "surulivas"), (2, None)], []) == {1: -1}


def test_ties_go_to_fewest_slips_then_the_least_key(spark):
    assert mapped(spark, [(1, "abcdefghxy"), (2, "abcdefghij")], [(7, "abcdefghxx"), (5, "abcdefghyy"), (4, "abcdefghkl")]) == {1: 5, 2: 4}


@pytest.mark.parametrize("size", [8, 9, 10, 13, 22])
def test_no_slip_is_lost(spark, size):
    rng = random.Random(size)
    letters = "abc"  # few letters: many near misses, overlapping swaps
    listed = [(i, "".join(rng.choice(letters) for _ in range(size))) for i in range(12)]
    asked = []
    for i in range(500):
        word = list(rng.choice(listed)[1])
        for _ in range(rng.choice([1, 2, 2, 2, 3])):
            at, kind = rng.randrange(len(word)), rng.randrange(4)
            if kind == 0:
                del word[at]
            elif kind == 1:
                word.insert(at, rng.choice(letters + "d"))
            elif kind == 2:
                word[at] = rng.choice(letters + "d")
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
        asked.append((i, "".join(word)))
    known = {e for _, e in listed}
    truth = {}
    for i, q in asked:
        if q not in known:
            near = [(slips(q, e), k) for k, e in listed if slips(q, e) <= 2]
            truth[i] = min(near)[1] if near else -1
    assert mapped(spark, asked, listed) == truth
