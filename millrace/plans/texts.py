"""Queries over documents and names: index, search, correction, suggestion, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bayes, fuzzy, query_string, search, small_ml
from millrace.plans.registry import query, scratch
from millrace.sources.tables import load
from millrace.streaming import streams

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_TOKENS = f"""listed AS (SELECT doc_id, lang, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, lang, unnest(range(len(ws))) AS pos, unnest(ws) AS term FROM listed)"""


def _tokens(spark, d):
    return search.tokenise(load(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_TOKENS} SELECT doc_id, pos, term FROM tokens")
def tokenise(spark, d):
    return _tokens(spark, d)


@query(f"WITH {_TOKENS} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tokens GROUP BY term, doc_id")
def inverted_index(spark, d):
    return search.inverted_index(_tokens(spark, d), "doc_id").select("term", "doc_id", "tf", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))).alias("positions"))


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS tf FROM tokens WHERE term = 'index' GROUP BY doc_id")
def term_lookup(spark, d):
    return search.term_lookup(search.inverted_index(_tokens(spark, d), "doc_id"), "index").select("doc_id", "tf")


@query(f"WITH {_TOKENS} SELECT doc_id FROM tokens WHERE term = 'index' INTERSECT SELECT doc_id FROM tokens WHERE term = 'table'")
def posting_intersection(spark, d):
    return search.both_terms(search.inverted_index(_tokens(spark, d), "doc_id"), "doc_id", "index", "table")


@query(f"WITH {_TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY term, doc_id) GROUP BY term")
def segment_merge(spark, d):
    """The index in segments of about 200 kB of text each, written in one pass, and merged by four level by level."""
    path = scratch(spark, "segments")
    docs = load(spark, d, "documents")
    segment, n = streams.segments_by_size(docs, "doc_id", F.octet_length("text"), 200_000)
    postings = search.inverted_index(search.tokenise(docs, "doc_id", "text"), "doc_id")
    streams.add_segments(postings.withColumn("segment", segment), path, n)
    streams.compact(path, spark, lambda s: search.merge_segments([s], "doc_id", ("segment",)), 4)
    return streams.read_segments(spark, path).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH {_TOKENS} SELECT a.doc_id, a.pos AS at FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'hash' AND b.term = 'table'")
def phrase_ordinal(spark, d):
    return search.phrase(_tokens(spark, d), "doc_id", "hash", "table")


_UNICODE = """list_filter(regexp_split_to_array(regexp_replace(lower({}), '([\\p{{Han}}々]+|\\p{{Hiragana}}+|[\\p{{Katakana}}ー]+)', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}ー]+'), lambda w: w <> '')"""


@query(f"WITH l AS (SELECT doc_id, {_UNICODE.format('text')} AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS term FROM l")
def tokenise_unicode(spark, d):
    """Words of every script."""
    return search.tokenise(load(spark, d, "documents"), "doc_id", "text", tx.unicode_words(F.col("text")))


@query("""WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+')) AS w FROM documents), s AS (SELECT regexp_replace(regexp_replace(w, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '') AS term FROM w)
SELECT term, count(*) AS n FROM s WHERE term <> '' GROUP BY term""")
def stripped_tokens(spark, d):
    """How often each token between blanks occurs, without the marks at its ends."""
    tokens = load(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[ \t\r\n]+")).alias("w"))
    return tokens.select(tx.strip_marks(F.col("w")).alias("term")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_FIELDS = f"""t AS (SELECT doc_id, 'title' AS field, {_UNICODE.format('title')} AS ws FROM documents UNION ALL SELECT doc_id, 'text', {_UNICODE.format('text')} FROM documents),
w AS (SELECT doc_id, field, unnest(range(len(ws))) AS pos, unnest(ws) AS term FROM t WHERE ws IS NOT NULL), n AS (SELECT count(*) AS n FROM documents),
a AS (SELECT doc_id, count(*) AS tf FROM w WHERE field = 'title' AND term = 'index' GROUP BY doc_id),
b AS (SELECT x.doc_id, count(*) AS tf FROM w x JOIN w y ON y.doc_id = x.doc_id AND y.field = x.field AND y.pos = x.pos + 1 WHERE x.field = 'text' AND x.term = 'hash' AND y.term = 'table' GROUP BY x.doc_id),
c AS (SELECT doc_id, count(*) AS tf FROM w WHERE field = 'text' AND term = 'query' GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS tf FROM w WHERE field = 'text' AND term = 'planner' GROUP BY doc_id),
s AS (SELECT doc_id, tf * ln(n * 1.0 / (SELECT count(*) FROM a)) AS score FROM a, n UNION ALL SELECT doc_id, tf * ln(n * 1.0 / (SELECT count(*) FROM b)) FROM b, n
UNION ALL SELECT c.doc_id, c.tf * ln(n * 1.0 / (SELECT count(*) FROM c)) FROM c, n WHERE c.doc_id NOT IN (SELECT doc_id FROM e))"""


@query(f"WITH {_FIELDS} SELECT doc_id, round(sum(score), 6) AS score, any_value(title) AS title FROM s JOIN documents USING (doc_id) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 5")
def field_query(spark, d):
    """Ranked hits of a query string over two fields, with a stored one."""
    text = 'title:index OR "hash table" OR (text:query AND NOT text:planner)'
    return query_string.search(load(spark, d, "documents"), "doc_id", {"title": F.col("title"), "text": F.col("text")}, text, "text", 5, ("title",))


_PLACED = """p AS (SELECT doc_id, regexp_extract_all(text, '[ \\t\\r\\n]*[^ \\t\\r\\n]+') AS ps FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS piece FROM p),
y AS (SELECT doc_id, pos, lower(regexp_replace(piece, '^[ \\t\\r\\n]+', '')) AS term, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) - length(regexp_replace(piece, '^[ \\t\\r\\n]+', '')) AS BIGINT) AS o FROM x)"""


@query(f"WITH {_PLACED} SELECT doc_id, pos, term, o AS \"offset\" FROM y")
def char_tokens(spark, d):
    """Words between blanks with the character offset they begin at."""
    return search.char_offsets(load(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_PLACED} SELECT a.doc_id, a.o AS at FROM y a JOIN y b ON a.doc_id = b.doc_id AND b.o = a.o + 5 WHERE a.term = 'hash' AND b.term = 'table'")
def phrase_char(spark, d):
    """Adjacency by character offset with one blank between the words."""
    t = search.char_offsets(load(spark, d, "documents"), "doc_id", "text")
    a = t.filter("term = 'hash'").select("doc_id", "offset", (F.col("offset") + 5).alias("next"))
    return a.join(t.filter("term = 'table'").select("doc_id", F.col("offset").alias("next")), ["doc_id", "next"]).select("doc_id", F.col("offset").alias("at"))


@query(f"""WITH {_TOKENS}, n AS (SELECT count(*) AS n FROM documents), h AS (SELECT term, doc_id, count(*) AS tf FROM tokens WHERE term IN ('index', 'table', 'query') GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(sum(tf * ln(n * 1.0 / df)), 6) AS score FROM h JOIN df USING (term), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 5""")
def tfidf_top5(spark, d):
    docs = load(spark, d, "documents")
    return search.ranked_hits(search.inverted_index(_tokens(spark, d), "doc_id"), docs.count(), "doc_id", ["index", "table", "query"])


def _dictionary(spark, d):
    return [r[0] for r in load(spark, d, "correctme").filter("keys <> ''").select("keys").distinct().collect()]


# every keyword as it is stored, the longest first; the texts of the alternation are free of case folding
_KEYWORDS = """p AS (SELECT string_agg(regexp_escape(k), '|' ORDER BY length(k) DESC, k) AS pattern FROM (SELECT DISTINCT "keys" AS k FROM correctme WHERE "keys" <> ''))"""


@query(f"""WITH {_KEYWORDS}, f AS (SELECT doc_id, regexp_extract_all(text, pattern) AS f FROM documents, p WHERE text IS NOT NULL)
SELECT doc_id, len(f) AS n, array_to_string(f, '|') AS found FROM f WHERE len(f) > 0""")
def dict_longest_match_keys(spark, d):
    """Every keyword as it stands in correctme."""
    found = load(spark, d, "documents").select("doc_id", search.longest_matches(_dictionary(spark, d))(F.col("text")).alias("f"))
    return found.filter(F.size("f") > 0).select("doc_id", F.size("f").cast("bigint").alias("n"), F.concat_ws("|", "f").alias("found"))


@query(f"""WITH {_KEYWORDS} SELECT doc_id, regexp_replace(text, '(' || pattern || ')', '<a href="/k/\\1">\\1</a>', 'g') AS linked FROM documents, p WHERE regexp_matches(text, pattern)""")
def keyword_link_keys(spark, d):
    """Every keyword as it stands in correctme, linked."""
    linked = search.linked(_dictionary(spark, d), "/k/")
    return load(spark, d, "documents").select("doc_id", linked(F.col("text")).alias("linked")).filter("linked is not null")


@query("""SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '\\s', ' '), '&amp;', '&') AS plain,
url_encode(source) AS url FROM documents""")
def html_unescape(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.unescape(F.col("text")).alias("plain"), F.url_encode("source").alias("url"))


@query("SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS text FROM documents")
def normalise_text_all(spark, d):
    """Texts of every language, and of none."""
    return load(spark, d, "documents").select("doc_id", tx.normalise(F.col("text")).alias("text"))


_NAMES = "names AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)"


def _names(spark, d):
    return load(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()


@query(f"WITH {_NAMES} SELECT DISTINCT word, substr(word, CAST(i AS BIGINT), 2) AS gram FROM names, range(1, 40) t(i) WHERE i < length(word)")
def qgram_index(spark, d):
    return fuzzy.gram_index(_names(spark, d), "word").select("word", "gram")


@query()
def spell_correct(spark, d):
    """Every distinct typed query against the whole keyword list."""
    asked = load(spark, d, "spell_correction").filter("queries is not null").select(F.lower("queries").alias("query"))
    keys = load(spark, d, "correctme").filter("keys is not null").select(F.lower("keys").alias("word"))
    return fuzzy.correct(asked, keys, "query", "word")


@query(f"""WITH {_NAMES}, keys AS (SELECT DISTINCT lower(p_name) AS word FROM part UNION SELECT word FROM names),
asked AS (SELECT DISTINCT substr(word, 2, 1) || substr(word, 1, 1) || substr(word, 3) AS query FROM keys),
kg AS (SELECT DISTINCT word, substr(word, CAST(i AS BIGINT), 2) AS gram FROM keys, range(1, 200) t(i) WHERE i < length(word)),
ag AS (SELECT DISTINCT query, substr(query, CAST(i AS BIGINT), 2) AS gram FROM asked, range(1, 200) t(i) WHERE i < length(query)),
c AS (SELECT query, word, count(*) AS common FROM ag JOIN kg USING (gram) GROUP BY query, word),
j AS (SELECT query, word FROM c WHERE common / (length(query) + length(word) - 2 - common) >= 0.4),
r AS (SELECT query, word, levenshtein(query, word) AS distance FROM j)
SELECT query, word, CAST(distance AS INTEGER) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, word) AS rank FROM r QUALIFY rank <= 10""")
def spell_correct_names(spark, d):
    """Names and their words, typed with the first two letters swapped."""
    keys = load(spark, d, "part").select(F.lower("p_name").alias("word")).union(_names(spark, d)).distinct()
    asked = keys.select(F.concat(F.substring("word", 2, 1), F.substring("word", 1, 1), F.expr("substr(word, 3)")).alias("query"))
    return fuzzy.correct(asked, keys, "query", "word")


def _keys(spark, d):
    return load(spark, d, "correctme").filter("keys is not null").select(F.lower("keys").alias("word")).distinct()


@query()
def levenshtein_keys(spark, d):
    """Pairs of keywords at most two edits apart, whatever letter they begin with."""
    return fuzzy.within(_keys(spark, d), "word", 2)


_KEYS = """keys AS (SELECT DISTINCT lower("keys") AS word FROM correctme WHERE "keys" IS NOT NULL)"""


@query(f"WITH {_KEYS} SELECT DISTINCT word, substr(word, CAST(i AS BIGINT), 2) AS gram FROM keys, range(1, 200) t(i) WHERE i < length(word)")
def qgram_index_keys(spark, d):
    return fuzzy.gram_index(_keys(spark, d), "word").select("word", "gram")


_ENTRIES = "e AS (SELECT p_name AS entry, arg_min(p_size, p_partkey) AS score, min(p_partkey) AS ord FROM part GROUP BY p_name)"


@query(f"""WITH {_ENTRIES}, p AS (SELECT substr(entry, 1, CAST(i AS BIGINT)) AS prefix, entry, score, ord FROM e, range(1, 100) t(i) WHERE i <= length(entry))
SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, ord) AS rank, entry, score FROM p QUALIFY rank <= 10""")
def prefix_suggest(spark, d):
    return fuzzy.prefix_index(load(spark, d, "part").select(F.col("p_name").alias("entry"), F.col("p_size").alias("score"), "p_partkey"), "entry", "score", "p_partkey")


@query(f"""WITH {_ENTRIES}, p AS (SELECT substr(entry, 1, CAST(i AS BIGINT)) AS prefix, entry, score, ord FROM e, range(1, 100) t(i) WHERE i <= length(entry))
SELECT rank, entry, score FROM (SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, ord) AS rank, entry, score FROM p) WHERE prefix = (SELECT substr(min(p_name), 1, 2) FROM part) AND rank <= 10""")
def suggest_lookup(spark, d):
    """Suggestions for the first two letters of the first name."""
    part = load(spark, d, "part")
    prefix = part.agg(F.substring(F.min("p_name"), 1, 2)).first()[0] or ""
    entries = part.select(F.col("p_name").alias("entry"), F.col("p_size").alias("score"), "p_partkey")
    return fuzzy.suggest_now(entries, "entry", "score", "p_partkey", prefix)


@query()
def suggest_readings(spark, d):
    """Suggestions for every prefix of every keyword's readings, in a Latin and a Japanese dictionary."""
    keys = load(spark, d, "correctme").groupBy("key_id", "keys").agg(F.max("score").alias("score"))
    return fuzzy.reading_index(keys, "keys", "score", "key_id")


@query(f"""WITH {_NAMES}, g AS (SELECT DISTINCT word, substr(word, CAST(i AS BIGINT), 2) AS gram FROM names, range(1, 40) t(i) WHERE i < length(word)),
c AS (SELECT a.word AS a, b.word AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.word < b.word GROUP BY ALL)
SELECT a, b, common, round(common / (length(a) + length(b) - 2 - common), 6) AS jaccard FROM c""")
def jaccard_pairs(spark, d):
    """Pairs of name words that share bigrams, with the estimate of their similarity."""
    return _jaccard(_names(spark, d))


@query(f"""WITH {_KEYS}, g AS (SELECT DISTINCT word, substr(word, CAST(i AS BIGINT), 2) AS gram FROM keys, range(1, 200) t(i) WHERE i < length(word)),
c AS (SELECT a.word AS a, b.word AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.word < b.word GROUP BY ALL)
SELECT a, b, common, round(common / (length(a) + length(b) - 2 - common), 6) AS jaccard FROM c""")
def jaccard_pairs_keys(spark, d):
    """Pairs of keywords that share bigrams."""
    return _jaccard(_keys(spark, d))


@query(f"""WITH {_KEYS}, g AS (SELECT DISTINCT word, substr(word, CAST(i AS BIGINT), 2) AS gram FROM keys, range(1, 200) t(i) WHERE i < length(word)),
c AS (SELECT a.word AS a, b.word AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.word < b.word GROUP BY ALL)
SELECT a, b, common, round(common / (length(a) + length(b) - 2 - common), 6) AS jaccard FROM c WHERE common / (length(a) + length(b) - 2 - common) >= 0.4""")
def jaccard_similar_keys(spark, d):
    """Pairs of keywords that are similar enough to be taken for each other, without listing all that share a bigram."""
    return fuzzy.similar_pairs(_keys(spark, d), "word").withColumn("jaccard", F.round("jaccard", 6))


def _jaccard(words):
    grams = fuzzy.gram_index(words, "word")
    a, b = grams.select("gram", F.col("word").alias("a")), grams.select("gram", F.col("word").alias("b"))
    common = a.join(b, "gram").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    return common.withColumn("jaccard", F.round(tx.jaccard_estimate(F.col("common"), F.col("a"), F.col("b")), 6))


# ---- naive Bayes: documents by language; odd documents train, even ones are tested

_COUNTS = f"""{_TOKENS}, counts AS (SELECT lang, doc_id, term, count(*) AS f FROM tokens WHERE lang IS NOT NULL GROUP BY lang, doc_id, term),
train AS (SELECT * FROM counts WHERE doc_id % 2 = 1), test AS (SELECT doc_id, term, f FROM counts WHERE doc_id % 2 = 0)"""
_SUMS = "sums AS (SELECT doc_id, sum(f) AS ff, count(*) AS a FROM test GROUP BY doc_id)"
_MNB = f"""WITH {_COUNTS}, {_SUMS}, ci AS (SELECT lang AS cat, term, sum(f) AS n_ci FROM train GROUP BY ALL), c AS (SELECT cat, sum(n_ci) AS n_c FROM ci GROUP BY cat),
docs AS (SELECT lang AS cat, count(DISTINCT doc_id) AS docs FROM train GROUP BY lang), pr AS (SELECT cat, docs / (SELECT sum(docs) FROM docs) AS prior FROM docs),
known AS (SELECT doc_id, cat, sum(f * ln(n_ci + 1)) AS k FROM test JOIN ci USING (term) GROUP BY doc_id, cat),
scores AS (SELECT s.doc_id, c.cat, round(coalesce(k, 0) - ff * ln(n_c + a) + ln(prior), 6) AS score FROM sums s CROSS JOIN c JOIN pr ON pr.cat = c.cat LEFT JOIN known ON known.doc_id = s.doc_id AND known.cat = c.cat)"""


def _split(spark, d):
    docs = load(spark, d, "documents").filter("lang is not null")
    counts = bayes.term_counts(search.tokenise(docs, "doc_id", "text", keep=("lang",)), "lang", "doc_id")
    train = counts.filter("doc_id % 2 = 1").withColumnRenamed("lang", "cat")
    return train, counts.filter("doc_id % 2 = 0").select("doc_id", "term", "f"), docs.filter("doc_id % 2 = 0").select("doc_id", "lang")


def _mnb(spark, d):
    train, test, truth = _split(spark, d)
    return bayes.multinomial_score(test, *bayes.multinomial_train(train, "cat", "doc_id"), "cat", "doc_id"), truth


@query(f"{_MNB} SELECT doc_id, cat, score FROM scores")
def mnb_scores(spark, d):
    return _mnb(spark, d)[0]


@query(f"""{_MNB}, ranks AS (SELECT doc_id, cat, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cat) AS rank FROM scores)
SELECT count(*) AS docs, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3
FROM ranks JOIN (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0) t ON t.doc_id = ranks.doc_id AND t.lang = ranks.cat""")
def nb_accuracy(spark, d):
    scores, truth = _mnb(spark, d)
    return bayes.accuracy(bayes.ranked(scores, "doc_id", "cat"), truth, "doc_id", "cat", "lang")


@query(f"""WITH {_COUNTS}, {_SUMS}, nd AS (SELECT count(DISTINCT doc_id) AS n FROM train), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM train GROUP BY term),
w AS (SELECT lang AS cat, doc_id, t.term, ln(f + 1) * ln(n * 1.0 / df) AS w FROM train t JOIN df ON df.term = t.term, nd),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id), sc AS (SELECT cat, term, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS w FROM w JOIN nm USING (doc_id)),
own AS (SELECT cat, term, sum(w) AS own FROM sc GROUP BY ALL), ev AS (SELECT term, sum(own) AS every FROM own GROUP BY term), cats AS (SELECT DISTINCT cat FROM own),
theta AS (SELECT cats.cat, ev.term, every - coalesce(own, 0) AS theta FROM ev CROSS JOIN cats LEFT JOIN own ON own.term = ev.term AND own.cat = cats.cat),
tot AS (SELECT cat, sum(theta) AS theta_all FROM theta GROUP BY cat), known AS (SELECT doc_id, cat, sum(f * ln(theta + 1)) AS k FROM test JOIN theta USING (term) GROUP BY doc_id, cat)
SELECT s.doc_id, tot.cat, round(round(ff * ln(theta_all + a) - coalesce(k, 0), 6), 3) AS score FROM sums s CROSS JOIN tot LEFT JOIN known ON known.doc_id = s.doc_id AND known.cat = tot.cat""")
def cnb_scores(spark, d):
    train, test, _ = _split(spark, d)
    return bayes.complement_score(test, *bayes.complement_train(train, "cat", "doc_id"), "cat", "doc_id").withColumn("score", F.round("score", 3))


@query(f"""WITH {_COUNTS} SELECT doc_id, count(*) AS terms, CAST(sum(f) AS BIGINT) AS words, round(sqrt(sum(f * f)), 6) AS norm FROM counts GROUP BY doc_id""")
def document_norms(spark, d):
    docs = load(spark, d, "documents").filter("lang is not null")
    counts = search.tokenise(docs, "doc_id", "text").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("f"))
    sizes = counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("f").alias("words"))
    return sizes.join(bayes.document_norms(counts, "doc_id").withColumn("norm", F.round("norm", 6)), "doc_id")


_CAT = """rows AS (SELECT o_orderkey, o_orderstatus AS label, o_orderpriority AS p, CAST(o_custkey % 4 AS VARCHAR) AS q FROM orders),
sizes AS (SELECT label, count(*) AS nl FROM rows GROUP BY label),
long AS (SELECT o_orderkey, label, 'p' AS feature, p AS value FROM rows UNION ALL SELECT o_orderkey, label, 'q', q FROM rows),
model AS (SELECT label, feature, value, count(*) AS n FROM long GROUP BY ALL)"""


@query(f"WITH {_CAT} SELECT label, feature, value, n, nl AS n_label, round((n + 1) / (nl + 1), 9) AS p FROM model JOIN sizes USING (label)")
def cat_nb(spark, d):
    model = bayes.categorical_train(_rows(spark, d), ["p", "q"], "label")
    return model.select("label", "feature", "value", "n", "n_label", F.round("p", 9).alias("p"))


@query(f"""WITH {_CAT}, ev AS (SELECT l.o_orderkey, s.label, s.nl, l.feature, l.value FROM long l CROSS JOIN sizes s),
sc AS (SELECT ev.o_orderkey, ev.label, sum(ln(coalesce((n + 1) / (ev.nl + 1), 1 / (ev.nl + 1)))) + ln(min(ev.nl) / (SELECT sum(nl) FROM sizes)) AS lp FROM ev
LEFT JOIN model m ON m.label = ev.label AND m.feature = ev.feature AND m.value = ev.value GROUP BY ev.o_orderkey, ev.label)
SELECT o_orderkey, label, round(lp, 6) AS log_posterior FROM sc""")
def cat_nb_posterior(spark, d):
    rows = _rows(spark, d)
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    return bayes.categorical_posterior(rows, bayes.categorical_train(rows, ["p", "q"], "label"), sizes, "o_orderkey", ["p", "q"], "label")


def _rows(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("p"), (F.col("o_custkey") % 4).cast("string").alias("q"))


@query(f"{_MNB} SELECT doc_id, cat FROM (SELECT doc_id, cat, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cat) AS rank FROM scores) WHERE rank = 1")
def nb_decision(spark, d):
    """The best class of each document."""
    return bayes.ranked(_mnb(spark, d)[0], "doc_id", "cat").filter("rank = 1").select("doc_id", "cat")


def _dear(spark, d, yes, no):
    """Items by return flag and supplier: quantity and discount, and whether the item is dear."""
    dear = F.when(F.col("l_extendedprice") > 38000, float(yes)).otherwise(float(no))
    return load(spark, d, "lineitem").select("l_returnflag", "l_suppkey", (F.col("l_quantity") / 50).alias("quantity"), F.col("l_discount").alias("discount"), dear.alias("dear"), F.struct("l_orderkey", "l_linenumber").alias("at"))


def _rounded(df):
    return df.select("l_returnflag", "l_suppkey", F.transform("weights", lambda w: F.round(w, 9)).alias("weights"))


@query()
def perceptron_by_flag(spark, d):
    """A step unit per return flag and supplier that learns from every item in order whether it is dear."""
    return _rounded(small_ml.perceptron(_dear(spark, d, 1, 0), ["l_returnflag", "l_suppkey"], ["quantity", "discount"], "dear", "at"))


@query()
def tanh_by_flag(spark, d):
    """A tanh unit per return flag and supplier that learns the same."""
    return _rounded(small_ml.tanh_unit(_dear(spark, d, 1, -1), ["l_returnflag", "l_suppkey"], ["quantity", "discount"], "dear", "at"))


@query("SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(xor(a, b) AS DOUBLE) AS prediction FROM range(2) x(a), range(2) y(b)")
def network_xor(spark, d):
    """What a network with one hidden layer has learnt of exclusive or."""
    corners = spark.range(4).select((F.col("id") % 2).cast("double").alias("a"), F.floor(F.col("id") / 2).cast("double").alias("b"))
    rows = corners.withColumn("y", (F.col("a") + F.col("b")) % 2)
    return small_ml.network(rows, ["a", "b"], "y", hidden=4).transform(rows).select("a", "b", "prediction")


# ---- structured records as text and bytes

_RECORDS = """r AS (SELECT doc_id AS id, list_filter([{'name': 'title', 'value': title}, {'name': 'lang', 'value': lang}, {'name': 'text', 'value': text}], lambda f: f.value IS NOT NULL) AS fields FROM documents)"""


@query(f"WITH {_RECORDS} SELECT id, len(fields) AS n, array_to_string(list_transform(fields, lambda f: f.name), ',') AS names, array_to_string(list_transform(fields, lambda f: f.value), '|') AS \"values\", true AS as_text, "
       "CAST(octet_length(encode(array_to_string(list_transform(fields, lambda f: f.name || f.value), ''))) AS BIGINT) AS payload FROM r")
def record_messages(spark, d):
    """Documents as records of named fields, through their binary and their text form and back."""
    from millrace.functions import messages

    field = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("name"), F.col(c).alias("value")))
    records = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_compact(F.array(*map(field, ("title", "lang", "text")))).alias("fields"))
    coded = records.select("id", "fields", messages.to_message(F.col("id"), F.col("fields")).alias("message"), F.to_json(F.struct("id", "fields")).alias("json"))
    back = coded.select("id", "fields", messages.from_message(F.col("message")).alias("m"), F.from_json("json", messages.RECORD).alias("j"))
    return back.select(
        F.col("m.id").alias("id"), F.size("m.fields").cast("bigint").alias("n"), F.concat_ws(",", "m.fields.name").alias("names"), F.concat_ws("|", "m.fields.value").alias("values"),
        ((F.col("j.id") == F.col("id")) & (F.col("j.fields") == F.col("fields"))).alias("as_text"), F.octet_length(F.array_join(F.transform("m.fields", lambda f: F.concat(f["name"], f["value"])), "")).cast("bigint").alias("payload"),
    )
