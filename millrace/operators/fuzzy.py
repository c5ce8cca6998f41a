"""Spelling correction by bigrams and edit distance, and suggestions by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.kana import katakana, romanised
from millrace.functions.text import jaccard_estimate, ordinary_width, prefixes, qgrams


def gram_index(words: DataFrame, word: str, q: int = 2) -> DataFrame:
    """(gram, word): the distinct q-grams of every distinct word."""
    return words.select(word).distinct().select(F.explode(F.array_distinct(qgrams(F.col(word), q))).alias("gram"), word)


def _rare_grams(texts: DataFrame, text: str, frequencies: DataFrame, threshold: float, side: str) -> DataFrame:
    """(code, text, <side>size, <side>all, <side>at): of each text so many of its rarest bigrams that no text similar enough lacks all of them, the codes of all in this order, and the place of this one.

    Two texts that reach the threshold share at least threshold * (length - 1) bigrams of either; in a
    common order of bigrams, the first of them is then among the first (bigrams - that + 1) of both.
    """
    size, every = f"{side}size", f"{side}all"
    ranked = _coded(texts, text).join(frequencies, "code", "left").select(text, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code").alias("g"))
    grams = ranked.groupBy(text).agg(F.sort_array(F.collect_list("g")).alias("gs")).select(text, F.char_length(text).alias(size), F.col("gs.code").alias(every))
    least = F.ceil((F.col(size) - 1) * threshold - 1e-9).cast("int")
    return grams.select(F.posexplode(F.slice(every, F.lit(1), F.greatest(F.size(every) - least + 1, F.lit(0)))).alias(f"{side}at", "code"), text, size, every)


def _coded(texts: DataFrame, text: str) -> DataFrame:
    """(code, text): the bigrams of gram_index, their two characters as one number."""
    code = F.shiftleft(F.ascii(F.substring("gram", 1, 1)).cast("bigint"), 21) + F.ascii(F.substring("gram", 2, 1))
    return gram_index(texts, text).select(code.alias("code"), text)


def _alike(queries: DataFrame, words: DataFrame, query: str, word: str, threshold: float) -> DataFrame:
    """(query, word, common): the pairs whose estimated similarity reaches the threshold, with their shared bigrams.

    Candidates share one of their rare bigrams, at places and with lengths that allow the threshold; the
    bigrams of these pairs only are compared, as numbers.
    """
    frequencies = _coded(words, word).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    asked, index = _rare_grams(queries, query, frequencies, threshold, "_a"), _rare_grams(words, word, frequencies, threshold, "_b")
    # of two lengths the shorter has at most its own bigrams in common
    near = (F.least("_asize", "_bsize") - 1) >= threshold * (F.greatest("_asize", "_bsize") - 1) - 1e-9
    # at most so many can be shared that come before this bigram in both, and after it
    most = F.least("_aat", "_bat") + 1 + F.least(F.size("_aall") - F.col("_aat"), F.size("_ball") - F.col("_bat")) - 1
    needed = threshold * (F.col("_asize") + F.col("_bsize") - 2) / (1 + threshold) - 1e-9
    common = F.size(F.array_intersect("_aall", "_ball"))
    met = asked.join(index, "code").filter(near & (most >= needed)).select(query, word, common.alias("common"))
    return met.filter(jaccard_estimate(F.col("common"), F.col(query), F.col(word)) >= threshold).distinct()


def correct(queries: DataFrame, words: DataFrame, query: str, word: str, threshold: float = 0.4, k: int = 10) -> DataFrame:
    """(query, word, distance, rank): the k nearest words by edit distance among those that share enough bigrams. Ties go to the lesser word."""
    kept = _alike(queries, words, query, word, threshold).withColumn("distance", F.levenshtein(query, word))
    rank = F.row_number().over(Window.partitionBy(query).orderBy("distance", word))
    return kept.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select(query, word, "distance", "rank")


def similar_pairs(words: DataFrame, word: str, threshold: float = 0.4) -> DataFrame:
    """(a, b, common, jaccard): pairs a < b of distinct words whose estimated similarity reaches the threshold; words of one character have none."""
    texts = words.select(F.col(word).alias("a")).filter("a is not null").distinct()
    pairs = _alike(texts, texts.withColumnRenamed("a", "b"), "a", "b", threshold).filter("a < b")
    return pairs.select("a", "b", F.col("common").cast("bigint").alias("common"), jaccard_estimate(F.col("common"), F.col("a"), F.col("b")).alias("jaccard"))


def _segments(length: Column, distance: int) -> Column:
    """(i, start, size) of the distance + 1 segments of a word of this length, the longer ones last; start counts from 1."""
    n = F.lit(distance + 1)
    base, longer = F.floor(length / n).cast("int"), (length % n).cast("int")
    start = lambda i: i * base + F.greatest(i - (n - longer), F.lit(0)) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: F.struct(i.alias("i"), start(i).alias("start"), (start(i + 1) - start(i)).alias("size")))


def within(words: DataFrame, word: str, distance: int) -> DataFrame:
    """(a, b, distance): all pairs a < b of distinct words with at most this edit distance. Null words are left out.

    The shorter word is cut into distance + 1 segments. So many edits leave one of them whole, and
    it then stands in the longer word at its own place moved by `distance` at most. A word too short
    for this has an empty segment and meets every word of a length that allows the distance.
    """
    texts = words.select(F.col(word).alias("w")).filter("w is not null").distinct().withColumn("n", F.char_length("w"))
    cut = texts.select(F.col("w").alias("s"), "n", F.explode(_segments(F.col("n"), distance)).alias("g"))
    index = cut.select("s", "n", F.col("g.i").alias("i"), F.expr("substr(s, g.start, g.size)").alias("piece"))
    lengths = F.sequence(F.greatest(F.col("n") - distance, F.lit(0)), F.col("n"))
    spread = texts.select("w", F.explode(lengths).alias("n")).select("w", "n", F.explode(_segments(F.col("n"), distance)).alias("g"))
    starts = F.sequence(F.greatest(F.col("g.start") - distance, F.lit(1)), F.col("g.start") + distance)
    placed = spread.select("w", "n", "g", F.explode(starts).alias("at"))
    probe = placed.select("w", "n", F.col("g.i").alias("i"), F.expr("substr(w, at, g.size)").alias("piece")).distinct()
    # of two words of one length each is the shorter
    pairs = index.join(probe, ["n", "i", "piece"]).filter("s <> w").select(F.least("s", "w").alias("a"), F.greatest("s", "w").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= distance)


def prefix_index(entries: DataFrame, entry: str, score: str, order: str, k: int = 10) -> DataFrame:
    """(prefix, rank, entry, score): the k best entries of each prefix, equal scores in input order; a repeated entry counts once, as first seen."""
    first = entries.groupBy(entry).agg(F.min_by(score, order).alias(score), F.min(order).alias("_order"))
    spread = first.select(F.explode(prefixes(F.col(entry))).alias("prefix"), entry, score, "_order")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc(score), "_order"))
    return spread.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select("prefix", "rank", entry, score)


def reading_index(entries: DataFrame, entry: str, score: str, order: str, k: int = 10) -> DataFrame:
    """(dictionary, prefix, rank, entry, score): prefix_index over an entry's readings, with a dictionary for Latin entries and one for Japanese.

    Entries are compared in ordinary width and small letters; an entry that is listed again, in
    whatever width or case, counts once, as first seen. What changes when its kana are written in Latin letters is Japanese
    and found under that and under its katakana; all else is found under itself. Null entries are left
    out, null scores are the lowest.
    """
    norm = F.lower(ordinary_width(F.col(entry)))
    seen = entries.filter(F.col(entry).isNotNull()).select(norm.alias("entry"), F.col(score).alias("score"), F.col(order).alias("_order"))
    first = seen.groupBy("entry").agg(F.min(F.struct("_order", "score")).alias("f")).select("entry", "f.score", "f._order")
    read = first.withColumn("_roman", romanised(F.col("entry"))).withColumn("dictionary", F.when(F.col("_roman") == F.col("entry"), "latin").otherwise("japanese"))
    readings = F.array_distinct(F.array("_roman", katakana(F.col("entry"))))
    spread = read.withColumn("_reading", F.explode(F.when(F.col("dictionary") == "latin", F.array("entry")).otherwise(readings)))
    spread = spread.select("dictionary", F.explode(prefixes(F.col("_reading"))).alias("prefix"), "entry", "score", "_order").distinct()
    rank = F.row_number().over(Window.partitionBy("dictionary", "prefix").orderBy(F.desc_nulls_last("score"), "_order"))
    return spread.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select("dictionary", "prefix", "rank", "entry", "score")


def suggest_now(entries: DataFrame, entry: str, score: str, order: str, prefix: str, k: int = 10) -> DataFrame:
    """(rank, entry, score): what prefix_index has for one prefix, from the entries that begin with it, without an index."""
    first = entries.filter(F.col(entry).startswith(prefix)).groupBy(entry).agg(F.min_by(score, order).alias(score), F.min(order).alias("_order"))
    best = first.orderBy(F.desc(score), "_order").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "_order")).cast("bigint")).select("rank", entry, score)


def suggest(index: DataFrame, prefix: str) -> DataFrame:
    return index.filter(F.col("prefix") == prefix).orderBy("rank")
