"""Problem 8: the subject areas of each document, by interpolated n-gram language models per subject.

Every subject gets a model of single words and word pairs, interpolated; so does the background. The
subjects' models are fitted on documents that bear hand-given labels (a bounded sample of them), the
background is counted over the whole corpus. Labels are per document, incomplete and sometimes wrong,
so counts are interpolated strongly and a word counts once a text. Words count apart in each
language, and a text's language is told by its words, for a subject that is rare in one language
mustn't make that language's ordinary words speak against it. A sentence speaks of the subject whose
cross-entropy per word is lowest, if it lies below the background's by a margin per word and by some
evidence in all; both are calibrated on labelled documents that the models for it weren't fitted on, so
that the subjects accepted for them agree best with their labels. A document has every subject with at
least a quarter of its speaking sentences.

The corpus is cut into words once: numbered words and lengths of sentences are written to the shared
folder, the background is counted and subjects are assigned from there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.forms import CASELESS, form_of
from millrace.session import ensure_checkpoints

#: Labelled documents, and characters of them, that the models are fitted on at most; all others only count in the background.
LABELLED, LABELLED_CHARS = 8_000, 100_000_000
#: Occurrences by which a word's and a pair's counts are interpolated.
WORD_PRIOR, PAIR_PRIOR = 20.0, 20.0
#: What calibration chooses from: gain per word, and gain of a sentence as a part of ln(subjects), the gain
#: of a word that only one of equally large subjects has. Parts of the labelled documents left out in turn.
MARGINS, EVIDENCE, FOLDS = [0.03 * i for i in range(11)], [0.3, 0.4, 0.5, 0.6, 0.7, 0.8], 2
#: Share of the speaking sentences that makes a subject one of the document's.
QUARTER = 0.25

_OTHER_LINE_ENDS = ("\r\n", "\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029")
_LEAD = re.compile(r"^[ \t>*#|-]+", re.MULTILINE)
#: A line that ends without a stop and goes on in small letters in the next.
_GOES_ON = re.compile(r"(?<=[^\n.?!。:])\n(?=[a-zß-öø-ÿ])")
_PLAIN = re.compile(r"[\t-\r -~]*").fullmatch
_DIGITS = re.compile(r"\d+")
#: Words (identifiers, Latin and like words, runs of one Japanese script, other letters), numbers, and ends of sentences.
_TOKENS = re.compile(
    r"[A-Za-z0-9]*_\w+|[^\W\d_a-zà-öø-ÿ]*[a-zà-öø-ÿ]+[^\W\d_぀-ヿ一-鿿]*|\d+|[ぁ-ゟ]+|[゠-ヿ]+|[一-鿿々]+|[^\W\d_]+"
    r"|[\n。]|[.?!](?=\s|$)|(?<=[぀-ヿ一-鿿])[?!]|[?!](?=[^\x00-\x7f])"
).findall
#: The same for texts in small ASCII letters.
_PLAIN_TOKENS = re.compile(r"[a-z0-9]*_\w+|[a-z]+|\d+|\n|[.?!](?=\s|$)").findall
_ENDS = frozenset("\n。.?!")
_KEPT_LINE = ""
_CASELESS = str.maketrans(CASELESS)
_TWINS = re.compile(f"[{''.join(CASELESS)}]").search
UNKNOWN, NUMBER, START = 0, 1, 2


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence that has any, in one form and small letters; numbers are '0'. Runs of one Japanese script are words.

    A line end ends a sentence unless the next line goes on in small letters.
    """
    for end in _OTHER_LINE_ENDS:
        text = text.replace(end, "\n")
    if not _PLAIN(text):
        text = form_of(text.replace("\n", _KEPT_LINE)).replace(_KEPT_LINE, "\n")
    text = _DIGITS.sub("0", _GOES_ON.sub(" ", _LEAD.sub("", text))).casefold()
    plain = text.isascii()
    if not plain and _TWINS(text):
        text = text.translate(_CASELESS)
    found, words = [], []
    for token in (_PLAIN_TOKENS if plain else _TOKENS)(text):
        if token not in _ENDS:
            words.append(token)
        elif words:
            found.append(words)
            words = []
    if words:
        found.append(words)
    return found


@dataclass
class Words:
    """Numbered words, the language of texts, and pairs of words; a word counts apart in every language.

    language_gain: log-likelihood of each word number in each language. A word of a language has the
    row `number * languages + language`, a pair of such rows has a row in `pairs`.
    """

    numbers: dict[str, int]
    language_gain: np.ndarray
    pairs: np.ndarray

    @property
    def rows(self) -> int:
        return self.language_gain.size

    def code(self, sentences: list[list[str]], documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word row, word row before or START, sentence number) of all words. documents: number of each sentence's text."""
        get, languages = self.numbers.get, self.language_gain.shape[1]
        words = np.array([get(w, UNKNOWN) for s in sentences for w in s], np.int64)
        sizes = lengths_of(sentences)
        owner = np.repeat(np.arange(len(sentences)), sizes)
        if languages > 1 and len(words):
            document = documents[owner]
            score = np.stack([np.bincount(document, self.language_gain[words, x]) for x in range(languages)], axis=1)
            words = words * languages + score.argmax(axis=1)[document]
        return words, self.before(words, sizes), owner

    def before(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Word row before each word in its sentence, or that of START."""
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[np.cumsum(sizes) - sizes] = START * self.language_gain.shape[1]
        return before

    def pair_rows(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Row of each pair, -1 for those without."""
        keys = before << 32 | word
        if not len(self.pairs):
            return np.full(len(keys), -1)
        row = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[row] == keys, row, -1)


def once_a_text(rows: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Weights by which every row counts once in each document: a name that one text repeats is no word of its subject."""
    _, which, n = np.unique((documents << 40) | rows, return_inverse=True, return_counts=True)
    return 1.0 / n[which]


def number_words(sentences: list[list[str]], documents: np.ndarray, languages: list[str | None]) -> Words:
    """Words of at least two documents get numbers; pairs that occur twice get rows. languages: of each document, null if unknown."""
    held = Counter(w for _, w in {(d, w) for d, s in zip(documents.tolist(), sentences, strict=True) for w in s})
    numbers = {"0": NUMBER} | {w: i + 3 for i, w in enumerate(sorted(w for w, n in held.items() if n >= 2 and w != "0"))}
    known = sorted({x for x in languages if x})
    counts = np.full((len(numbers) + 3, max(1, len(known))), 0.1)
    for d, s in zip(documents.tolist(), sentences, strict=True):
        if languages[d]:
            for w in s:
                if w in numbers:
                    counts[numbers[w], known.index(languages[d])] += 1
    counts[[UNKNOWN, NUMBER, START]] = 1.0
    words = Words(numbers, np.log(counts / counts.sum(axis=0)), np.zeros(0, np.int64))
    word, before, _ = words.code(sentences, documents)
    keys, n = np.unique(before << 32 | word, return_counts=True)
    words.pairs = keys[n >= 2]
    return words


def spread_of(word_counts: np.ndarray, pair_counts: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The background: P(word) in its language, and P(word | word before) of each pair row; nowhere zero."""
    languages = words.language_gain.shape[1]
    every = word_counts + 0.01
    single = every / np.tile(every.reshape(-1, languages).sum(axis=0), len(every) // languages)
    before, word = words.pairs >> 32, words.pairs & 0xFFFFFFFF
    context = np.bincount(before, pair_counts, len(every))
    return single, (pair_counts + PAIR_PRIOR * single[word]) / (context[before] + PAIR_PRIOR)


def interpolated_gains(word_counts: np.ndarray, pair_counts: np.ndarray, background: tuple[np.ndarray, np.ndarray], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """log P(word) and log P(word | word before) of each model, less the background's; one column per model.

    A word's counts are interpolated with WORD_PRIOR occurrences that are spread over the models by
    their size, as the background has it, a pair's with PAIR_PRIOR occurrences at the word's own gain.
    """
    single, pair = background
    languages, models = words.language_gain.shape[1], word_counts.shape[1]
    totals = word_counts.reshape(-1, languages, models).sum(axis=0)
    size = np.tile(totals, (len(word_counts) // languages, 1))
    prior = WORD_PRIOR * np.tile(totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-9), (len(word_counts) // languages, 1)) + 1e-6
    word_gain = np.log((word_counts + prior) / (size * single[:, None] + prior))
    before, word = words.pairs >> 32, words.pairs & 0xFFFFFFFF
    context = np.stack([np.bincount(before, pair_counts[:, k], len(word_counts)) for k in range(models)], axis=1)
    prior = prior[word] * (PAIR_PRIOR / WORD_PRIOR)
    return word_gain, np.log((pair_counts + prior * np.exp(word_gain[word])) / (context[before] * pair[:, None] + prior))


@dataclass
class Model:
    """Per-word gain of each subject over the background, for words and for pairs; subjects in order; what a sentence must reach a word and in all."""

    subjects: list[str]
    words: Words
    word_gain: np.ndarray
    pair_gain: np.ndarray
    margin: float
    evidence: float

    def gains(self, word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Cross-entropy of the background less that of each subject, per word of each sentence. word: word rows; sizes: words of each sentence."""
        if not len(word):
            return np.zeros((0, len(self.subjects)))
        row = self.words.pair_rows(word, self.words.before(word, sizes))
        gain = self.word_gain[word]
        known = row >= 0
        gain[known] = self.pair_gain[row[known]]
        return np.add.reduceat(gain, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


def accepted(gains: np.ndarray, lengths: np.ndarray, documents: np.ndarray, n: int, margin: float, evidence: float) -> np.ndarray:
    """(document, subject) booleans: subjects with a quarter of the speaking sentences of the document."""
    if not gains.size:
        return np.zeros((n, gains.shape[1]), bool)
    best = gains.argmax(axis=1)
    most = gains.max(axis=1, initial=-np.inf)
    speaks = (most > margin) & (most * lengths > evidence)
    k = gains.shape[1]
    shares = np.bincount(documents[speaks] * k + best[speaks], minlength=n * k).reshape(n, k)
    total = shares.sum(axis=1, keepdims=True)
    return (total > 0) & (shares >= QUARTER * total)


def counts_of(words: Words, word: np.ndarray, sizes: np.ndarray, documents: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subjects' word and pair counts. labels: (document, subject) booleans; a document counts for its labels in equal parts, without labels for none."""
    row = words.pair_rows(word, words.before(word, sizes))
    known, of = row >= 0, np.repeat(documents, sizes)
    share = labels / np.maximum(labels.sum(axis=1, keepdims=True), 1)
    each_word, each_pair = once_a_text(word, of), once_a_text(row[known], of[known])
    counts = [np.bincount(word, each_word * share[of, c], words.rows) for c in range(labels.shape[1])]
    pairs = [np.bincount(row[known], each_pair * share[of[known], c], len(words.pairs)) for c in range(labels.shape[1])]
    return np.stack(counts, axis=1), np.stack(pairs, axis=1)


def _split(texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
    """Sentences of all texts, and the number of the text of each."""
    sentences, documents = [], []
    for d, text in enumerate(texts):
        own = sentences_of(text)
        sentences += own
        documents += [d] * len(own)
    return sentences, np.array(documents, np.int64)


def once(sentences: list[list[str]], documents: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Each distinct sentence once: texts that are posted again mustn't make their names words of a subject."""
    first: dict[tuple[str, ...], int] = {}
    for i, s in enumerate(sentences):
        first.setdefault(tuple(s), i)
    kept = list(first.values())
    return [sentences[i] for i in kept], documents[kept]


def lengths_of(sentences: list[list[str]]) -> np.ndarray:
    return np.array([len(s) for s in sentences], np.int64)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each row has) of a column of packed 32-bit numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<i4").astype(np.int64), np.diff(offsets) // 4


CODED = "words binary, sizes binary"


def _code(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Texts as their word rows and the lengths of their sentences."""
    words = shared.value
    for b in batches:
        sentences, documents = _split(b.column(1).to_pylist())
        word, sizes = words.code(sentences, documents)[0], lengths_of(sentences)
        sentences_of_text = np.bincount(documents, minlength=b.num_rows)
        words_of_text = np.bincount(documents, sizes, b.num_rows).astype(np.int64)
        packed = [
            pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.append(0, np.cumsum(n) * 4).astype(np.int32)), pa.py_buffer(values.astype("<i4"))])
            for values, n in ((word, words_of_text), (sizes, sentences_of_text))
        ]
        yield pa.RecordBatch.from_arrays([b.column(0), *packed], names=["id", "words", "sizes"])


def _background(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Counts of the models' words (kind 0) and pairs (kind 1) in a partition, each once a text."""
    words = shared.value
    singles, pairs = np.zeros(words.rows, np.int64), np.zeros(len(words.pairs), np.int64)
    for b in batches:
        word, per_text = _numbers(b.column(0))
        sizes, _ = _numbers(b.column(1))
        if len(word):
            row = words.pair_rows(word, words.before(word, sizes))
            known = row >= 0
            of = np.repeat(np.arange(b.num_rows), per_text)
            singles += np.bincount(np.unique((of << 40) | word) & 0xFFFFFFFFFF, minlength=len(singles))
            pairs += np.bincount(np.unique((of[known] << 40) | row[known]) & 0xFFFFFFFFFF, minlength=len(pairs))
    for kind, counts in ((0, singles), (1, pairs)):
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(counts[at])], names=["kind", "number", "n"])


def labelled_sample(corpus: DataFrame, labels: DataFrame, names: list[str], id: str, text: str, subject: str, language: str | None, bound: int, characters: int) -> list[tuple[str, str | None, list[int]]]:
    """(text, language, subject numbers) of at most `bound` labelled documents and about `characters` characters, in the order of a hash of their id."""
    column = {n.strip().lower(): i for i, n in enumerate(names)}
    given = labels.select(F.col(id).alias("id"), F.lower(F.trim(F.col(subject))).alias("subject")).filter("id is not null and subject is not null").distinct()
    given = given.groupBy("id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("id"), "id").limit(bound)
    spoken = F.lower(F.substring(F.trim(F.col(language)), 1, 2)) if language else F.lit(None).cast("string")
    rows = corpus.select(F.col(id).alias("id"), F.col(text).alias("text"), spoken.alias("language")).filter("text is not null").join(F.broadcast(given), "id")
    sample, held = [], 0
    for r in rows.orderBy(F.xxhash64("id"), "id", "text").toLocalIterator():
        if held > characters:
            break
        chosen = [column[s] for s in r.subjects if s in column]
        if chosen:
            sample.append((r.text, r.language, chosen))
            held += len(r.text)
    return sample


def fit(corpus: DataFrame, labels: DataFrame, subjects: DataFrame, id: str, text: str, subject: str, language: str | None, bound: int = LABELLED, characters: int = LABELLED_CHARS) -> tuple[Model, DataFrame]:
    """(models, coded corpus); see the module. The coded corpus has a row (id, words, sizes) for every text that isn't null."""
    spark = corpus.sparkSession
    ensure_checkpoints(spark)
    names = [r[0] for r in subjects.select(subject).filter(F.col(subject).isNotNull()).distinct().orderBy(subject).collect()]
    sample = labelled_sample(corpus, labels, names, id, text, subject, language, bound, characters)
    sentences, documents = once(*_split([t for t, _, _ in sample]))
    truth = np.zeros((len(sample), len(names)), bool)
    for d, (_, _, chosen) in enumerate(sample):
        truth[d, chosen] = True
    texts = corpus.select(F.col(id).alias("id"), F.col(text)).filter(F.col(text).isNotNull())
    if not sentences:
        empty = Model(names, Words({}, np.zeros((3, 1)), np.zeros(0, np.int64)), np.zeros((3, len(names))), np.zeros((0, len(names))), np.inf, np.inf)
        return empty, texts.select("id", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("sizes")).limit(0)
    words = number_words(sentences, documents, [x for _, x, _ in sample])
    shared = spark.sparkContext.broadcast(words)
    coded = texts.mapInArrow(lambda b: _code(b, shared), f"id {corpus.schema[id].dataType.simpleString()}, {CODED}").checkpoint()
    everywhere, together = np.zeros(words.rows), np.zeros(len(words.pairs))
    counted = coded.select("words", "sizes").mapInArrow(lambda b: _background(b, shared), "kind int, number long, n long")
    for r in counted.groupBy("kind", "number").agg(F.sum("n").alias("n")).collect():  # at most one row per word and pair of the models
        (together if r.kind else everywhere)[r.number] = r.n
    return calibrated(names, words, spread_of(everywhere, together, words), words.code(sentences, documents)[0], lengths_of(sentences), documents, truth), coded


def calibrated(names: list[str], words: Words, background: tuple, word: np.ndarray, sizes: np.ndarray, documents: np.ndarray, truth: np.ndarray) -> Model:
    """The models fitted on all labelled documents, with the margin and evidence that agree best with the labels of documents left out of the fit."""
    fold = np.arange(len(truth)) % FOLDS
    alone = np.log(max(2, truth.any(axis=0).sum()))

    def fitted(kept: np.ndarray) -> Model:
        gains = interpolated_gains(*counts_of(words, word, sizes, documents, truth & kept[:, None]), background, words)
        return Model(names, words, *(g.astype(np.float32) for g in gains), 0.0, 0.0)

    left_out = np.zeros((len(sizes), len(names)), np.float32)
    for f in range(FOLDS):
        out = fold[documents] == f
        left_out[out] = fitted(fold != f).gains(word[np.repeat(out, sizes)], sizes[out])
    model, best = fitted(np.ones(len(truth), bool)), -1.0
    for part in EVIDENCE:
        for margin in MARGINS:
            said = accepted(left_out, sizes, documents, len(truth), margin, part * alone)
            score = 2 * (said & truth).sum() / max(1, said.sum() + truth.sum())
            if score > best:
                best, model.margin, model.evidence = score, margin, part * alone
    return model


def _assign(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b in batches:
        (word, _), (sizes, per_text) = _numbers(b.column(1)), _numbers(b.column(2))
        chosen = accepted(model.gains(word, sizes), sizes, np.repeat(np.arange(b.num_rows), per_text), b.num_rows, model.margin, model.evidence)
        d, s = np.nonzero(chosen)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array([model.subjects[i] for i in s], pa.string())], names=["id", "subject"])


def subject_areas(corpus: DataFrame, labels: DataFrame, subjects: DataFrame, id: str = "doc_id", text: str = "text", subject: str = "subject", language: str | None = "lang", bound: int = LABELLED) -> DataFrame:
    """(id, subject): every subject with at least a quarter of a document's sentences that speak of any subject.

    Documents that speak of none, with null id or text or an empty text give no row; repeated rows
    repeat their result. Labels are compared without blanks at the ends and case; null and unknown
    ones don't count. Without usable labels nothing is accepted.
    """
    model, coded = fit(corpus, labels, subjects, id, text, subject, language, bound)
    shared = corpus.sparkSession.sparkContext.broadcast(model)
    kind = corpus.schema[id].dataType.simpleString()
    return coded.filter("id is not null").mapInArrow(lambda b: _assign(b, shared), f"id {kind}, subject string").select(F.col("id").alias(id), F.col("subject").alias(subject))


def held_out_agreement(corpus: DataFrame, labels: DataFrame, subjects: DataFrame, id: str = "doc_id", subject: str = "subject", ways: int = 4, **options) -> DataFrame:
    """(documents, precision, recall) against the labels of one labelled document in `ways`, which the models are fitted without.

    Labels are compared as fit() does. Wrong and missing labels count against both figures.
    """
    out = F.pmod(F.xxhash64(F.col(id), F.lit("held out")), F.lit(ways)) == 0
    given = labels.filter(out).select(F.col(id).alias("id"), F.lower(F.trim(F.col(subject))).alias("subject")).filter("id is not null and subject is not null")
    known = subjects.select(F.lower(F.trim(F.col(subject))).alias("subject")).distinct()
    truth = given.join(known, "subject").distinct().withColumn("given", F.lit(1))
    said = subject_areas(corpus, labels.filter(~out), subjects, id=id, subject=subject, **options).select(F.col(id).alias("id"), F.lower(F.trim(F.col(subject))).alias("subject")).distinct()
    both = said.join(truth.select("id").distinct(), "id", "left_semi").withColumn("said", F.lit(1)).join(truth, ["id", "subject"], "full")
    agreed = F.count(F.when(F.col("said").isNotNull() & F.col("given").isNotNull(), 1))
    return both.agg(F.countDistinct("id").alias("documents"), F.round(agreed / F.count("said"), 4).alias("precision"), F.round(agreed / F.count("given"), 4).alias("recall"))
