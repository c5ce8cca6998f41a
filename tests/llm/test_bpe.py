import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.bpe import PATTERN, Vocabulary, encode_corpus, encode_pieces
from millrace.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(FILE)


def own(vocabulary, text):
    import regex

    pieces = regex.findall(PATTERN, text)
    return [i for ids in encode_pieces(pieces, vocabulary) for i in ids]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(public, vocabulary, text):
    assert own(vocabulary, text) == public([text])[0]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab a\n'st12", max_size=200))
def test_repetitive_text(public, vocabulary, text):
    assert own(vocabulary, text) == public([text])[0]


def test_long_runs(public, vocabulary):
    texts = ["a" * 40_000, " " * 20_000 + "x", "ab" * 15_000, "<|endoftext|>", "1" * 9_999, "\r\n" * 5_000, "家" * 10_000]
    for text in texts:
        assert own(vocabulary, text) == public([text])[0]


def test_corpus(spark, public):
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", 5), (None, "a", 5), (1, "Hello world", 5), (4, "naïve 🙂 text\t" * 500, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df, "doc_id", "text", FILE).collect()), key=repr)
    assert got == sorted(((i, public([t or ""])[0]) for i, t, _ in rows), key=repr)
    assert encode_corpus(df.limit(0), "doc_id", "text", FILE).collect() == []


def test_whole_table_against_the_library(spark, public):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.ids for r in encode_corpus(docs, "doc_id", "text", FILE).collect()}
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert got == dict(zip([i for i, _ in texts], public([t for _, t in texts])))
