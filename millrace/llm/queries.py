"""The queries of the operators for training data, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_corpus
from millrace.llm.canonical import map_to_list
from millrace.llm.distinctive import distinctive_terms, top_terms
from millrace.llm.forms import look_alike_classes, look_alikes
from millrace.llm.frequency import term_frequencies
from millrace.llm.leakage import find_leaks, removal_spans
from millrace.llm.sampling import sample_categories, sample_categories_and_periods
from millrace.llm.subjects import subject_areas
from millrace.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(load(spark, d, "nb")).filter("mark is not null").select("term", "mark")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(load(spark, d, "nb"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = sample_categories(load(spark, d, "nb"), load(spark, d, "cat_targets"))
    return report.filter("gap > 0").select("cat")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = sample_categories(load(spark, d, "nb"), load(spark, d, "cat_targets"))
    return report.select("cat", "quota", "available", "sampled", "gap")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    sample, _ = sample_categories(load(spark, d, "nb"), load(spark, d, "cat_targets"))
    return sample.select(F.col("id").alias("docno"), F.round("probability", 6).alias("probability"))


def p2_margins(spark: SparkSession, d: str) -> DataFrame:
    _, report = sample_categories_and_periods(load(spark, d, "nb"), load(spark, d, "cat_targets"))
    return report


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive_terms(load(spark, d, "nb"))
    # the exact rule: at least a fifth of the record, at least two records, at most 2 % of the records
    return scored.filter("tf * 5 >= total and df >= 2 and df * 50 <= records").select("docno", "term")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive_terms(load(spark, d, "nb")).withColumn("score", F.round("score", 6)).drop("records", "log_odds")


def p3_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return top_terms(distinctive_terms(load(spark, d, "nb"))).withColumn("score", F.round("score", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alikes(load(spark, d, "spell_correction"), load(spark, d, "correctme"), "query_id", "queries", "key_id", "keys")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "spell_correction").select(F.lit("query").alias("source"), F.col("query_id").alias("id"), F.col("queries").alias("text"))
    keys = load(spark, d, "correctme").select(F.lit("keyword").alias("source"), F.col("key_id").alias("id"), F.col("keys").alias("text"))
    return look_alike_classes(asked.unionByName(keys), "source", "id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return map_to_list(load(spark, d, "spell_correction"), load(spark, d, "correctme"), "query_id", "queries", "key_id", "keys")


#: Where the public vocabularies lie.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(load(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items"), "doc_id", "text", "item_id", "passage")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return removal_spans(_leaks(spark, d), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(load(spark, d, "documents"), load(spark, d, "subject_labels"), load(spark, d, "subjects"))


QUERIES = {f.__name__: f for f in (p1_found, p1_frequencies, p2_found, p2_report, p2_sample, p2_margins, p3_found, p3_scores, p3_top_terms, p4_found, p4_forms, p5_found, p6_ids, p7_found, p7_spans, p8_found)}
