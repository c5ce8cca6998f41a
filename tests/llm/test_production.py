"""Queries whose meaning SQL can't say, over a whole small table against plain Python."""

import unicodedata

from millrace.llm.forms import CASELESS, form_of, skeleton_of
from millrace.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def tables(spark):
    asked = {(r.query_id, r.queries) for r in spark.read.parquet(f"{D}/spell_correction.parquet").collect() if r.queries is not None}
    listed = {(r.key_id, r["keys"]) for r in spark.read.parquet(f"{D}/correctme.parquet").collect()}
    return asked, listed, {k for _, k in listed}


def test_p4(spark, rows):
    asked, listed, plain = tables(spark)
    truth = {(i, k) for i, q in asked if q not in plain for k, e in listed if skeleton_of(q) == skeleton_of(e)}
    found = rows(QUERIES["p4_found"](spark, D))
    assert set(found) == truth and len(found) == len(truth) > 0


def test_p5(spark, rows):
    from tests.llm.test_canonical import slips

    def letters(text):
        low = "".join(CASELESS.get(c, c) for c in form_of(text).lower())
        return "".join(c for c in low if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")

    asked, listed, plain = tables(spark)
    forms = set()
    for k, e in listed:
        words = form_of(e).split()
        forms |= {(letters(e), k)} | ({(letters(words[1] + words[0]), k)} if len(words) == 2 else set())
    truth = set()
    for i, q in asked:
        if q in plain or not form_of(q):
            continue
        typed = letters(q)
        near = [(0, k) for f, k in forms if f == typed] or [
            (n, k) for f, k in forms if len(f) >= 8 and abs(len(f) - len(typed)) <= 2 and len(set(f) ^ set(typed)) <= 4 and (n := slips(typed, f)) <= 2
        ]
        truth.add((i, min(near)[1] if near else -1))
    found = rows(QUERIES["p5_found"](spark, D))
    assert set(found) == truth and len(found) == len(truth) > 0


def test_sample_takes_the_quotas(spark):
    report = {r.cat: r for r in QUERIES["p2_report"](spark, D).collect()}
    labels = {}
    for r in spark.read.parquet(f"{D}/nb.parquet").select("docno", "cat").distinct().collect():
        if r.docno is not None and r.cat is not None:
            labels.setdefault(r.docno, set()).add("".join(c for c in r.cat.lower() if c.isalnum()))
    sample = {r.docno for r in QUERIES["p2_sample"](spark, D).collect()}
    for cat, r in report.items():
        key = "".join(c for c in cat.lower() if c.isalnum())
        assert sum(key in labels[i] for i in sample) == r.sampled >= min(r.quota, r.available)
