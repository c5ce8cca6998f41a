import random

import numpy as np

from millrace.llm.subjects import accepted, number_words, sentences_of, subject_areas

WORDS = {"alpha": ["atom", "quark", "orbit", "laser", "prism"], "beta": ["goal", "coach", "medal", "relay", "racket"], "gamma": ["court", "judge", "clause", "appeal", "verdict"]}
FILLERS = ["More on this tomorrow, I hope.", "Thanks in advance for any reply.", "Has anyone else noticed this?"]


def sentence(rng, subject):
    a, b = rng.choice(WORDS[subject]), rng.choice(WORDS[subject])
    name = "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)).title()
    return rng.choice([f"The {a} of {name} was replaced by {rng.randrange(900)} new {b}s.", f"Please compare this {a} with the {b} of {name}.", f"Without {name}, no {a} beats the {b}."])


def corpus(n, seed=3):
    """(doc, text, true subjects); a stray sentence below a quarter is no subject."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        main = rng.sample(list(WORDS), rng.choice([1, 1, 2]))
        parts = [sentence(rng, m) for m in main for _ in range(4)]
        if len(main) == 1 and rng.random() < 0.5:
            parts.append(sentence(rng, rng.choice([s for s in WORDS if s not in main])))
        parts += rng.sample(FILLERS, 2)
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), set(main)))
    return docs


def tables(spark, docs, labels):
    a = spark.createDataFrame([(i, t, "en", "q") for i, t, *_ in docs], "doc_id long, text string, lang string, subject string")
    b = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    return a, b, spark.createDataFrame([(s, s) for s in [*WORDS, "unused"]], "subject string, about string")


def test_held_out_accuracy(spark):
    docs = corpus(900)
    rng = random.Random(1)
    labels = []
    for i, _, truth in docs[:300]:
        for s in truth:
            if rng.random() < 0.8:
                labels.append((i, rng.choice([s, s.upper(), f" {s}"]), "x"))
        if rng.random() < 0.05:
            labels.append((i, rng.choice(list(WORDS)), "y"))
    labels += [(0, None, "z"), (None, "alpha", "z"), (1, "no such subject", "z"), labels[0]]
    found = {(r.doc_id, r.subject) for r in subject_areas(*tables(spark, docs, labels)).collect()}
    truth = {(i, s) for i, _, t in docs[300:] for s in t}
    said = {x for x in found if x[0] >= 300}
    assert len(said & truth) > 0.97 * len(truth) and len(said & truth) > 0.97 * len(said)


def test_defined_cases(spark):
    docs = [(i, t) for i, t, _ in corpus(300)] + [(1000, None), (1001, ""), (1002, " ".join(FILLERS)), (None, "The atom beats the quark."), (1003, "The quark beats the orbit. " * 5000), (1003, "The quark beats the orbit. " * 5000)]
    labels = [(i, s, "x") for i, _, t in corpus(300) for s in t]
    found = subject_areas(*tables(spark, docs, labels)).filter("doc_id >= 1000 or doc_id is null").collect()
    assert sorted((r.doc_id, r.subject) for r in found) == [(1003, "alpha"), (1003, "alpha")]


def test_nothing_to_learn_from(spark):
    docs = corpus(20)
    assert subject_areas(*tables(spark, docs, [])).collect() == []
    assert subject_areas(*tables(spark, [], [(1, "alpha", "x")])).collect() == []
    a, b, s = tables(spark, docs, [(1, "alpha", "x")])
    assert subject_areas(a, b, s.limit(0)).collect() == []


def test_sentences():
    assert sentences_of("> It took 3 days\r\nto see. A_b x! 列指向と索引。次は？Ja") == [["it", "took", "0", "days", "to", "see"], ["a_b", "x"], ["列指向", "と", "索引"], ["次", "は"], ["ja"]]
    assert sentences_of("") == [] == sentences_of("!!! ...")


def test_a_quarter_is_enough():
    gains = np.array([[2.0, 0], [2, 0], [2, 0], [0, 2], [0, 0]])
    assert accepted(gains, np.full(5, 5), np.zeros(5, np.int64), 1, 0.1, 1.0).tolist() == [[True, True]]


def test_words_count_apart_in_each_language():
    words = number_words([["die", "x"], ["die", "x"], ["die", "y"], ["die", "y"]], np.arange(4), ["de", "de", "en", "en"])
    rows, _, _ = words.code([["die", "x"], ["die", "y"]], np.array([0, 1]))
    assert rows[0] != rows[2]


def test_agreement_with_labels_left_out(spark):
    from millrace.llm.subjects import held_out_agreement

    docs = corpus(400)
    labels = [(i, s, "x") for i, _, truth in docs[:300] for s in truth] + [(2, None, "y"), (3, "no such subject", "y")]
    found = held_out_agreement(*tables(spark, docs, labels)).first()
    assert 40 < found.documents < 110 and found.precision > 0.95 and found.recall > 0.95


def test_background_and_gains_from_coded_texts():
    import pyarrow as pa

    from millrace.llm.subjects import _code, _numbers

    class Shared:
        value = number_words([["a", "b"], ["b", "a"], ["a", "b"]], np.arange(3), [None] * 3)

    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(["a b. b", "", "x"])], names=["id", "text"])
    coded = next(_code(iter([batch]), Shared))
    words, of = _numbers(coded.column(1))
    sizes, sentences = _numbers(coded.column(2))
    number = Shared.value.numbers
    assert words.tolist() == [number["a"], number["b"], number["b"], 0] and of.tolist() == [3, 0, 1]
    assert sizes.tolist() == [2, 1, 1] and sentences.tolist() == [2, 0, 1]


def test_labelled_sample_is_bounded_by_characters(spark):
    from millrace.llm.subjects import labelled_sample

    docs = corpus(60)
    a, b, _ = tables(spark, docs, [(i, s, "x") for i, _, t in docs for s in t])
    whole = labelled_sample(a, b, list(WORDS), "doc_id", "text", "subject", "lang", 1000, 10**9)
    part = labelled_sample(a, b, list(WORDS), "doc_id", "text", "subject", "lang", 1000, 2000)
    assert len(whole) == 60 and part == whole[: len(part)] and 2000 < sum(len(t) for t, *_ in part) < 4000
    assert len(labelled_sample(a, b, list(WORDS), "doc_id", "text", "subject", "lang", 7, 10**9)) == 7
