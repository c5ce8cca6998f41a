"""Naive Bayes text classification: multinomial, complement, categorical; scores, ranks, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import broadcast_within
from millrace.session import ensure_checkpoints

#: Classes up to which the class list is broadcast; more of them are joined by shuffle.
CLASSES = 10_000


def term_counts(tokens: DataFrame, cat: str, doc: str) -> DataFrame:
    """(cat, doc, term, f)."""
    return tokens.groupBy(cat, doc, "term").agg(F.count(F.lit(1)).alias("f"))


def document_frequencies(counts: DataFrame, doc: str) -> DataFrame:
    return counts.groupBy("term").agg(F.countDistinct(doc).alias("df"))


def document_norms(counts: DataFrame, doc: str) -> DataFrame:
    """(doc, norm): the Euclidean length of each document's counts."""
    return counts.groupBy(doc).agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("norm"))


def multinomial_train(counts: DataFrame, cat: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """(cat, term, n_ci) and (cat, n_c, prior): term counts, all counts and share of documents of each class."""
    per_term = counts.groupBy(cat, "term").agg(F.sum("f").alias("n_ci"))
    docs = counts.groupBy(cat).agg(F.countDistinct(doc).alias("docs"))
    classes = per_term.groupBy(cat).agg(F.sum("n_ci").alias("n_c")).join(docs, cat)
    total = F.sum("docs").over(Window.partitionBy(F.lit(0)))  # one row a class
    return per_term, classes.select(cat, "n_c", (F.col("docs") / total).alias("prior"))


def multinomial_score(test: DataFrame, per_term: DataFrame, classes: DataFrame, cat: str, doc: str) -> DataFrame:
    """(doc, cat, score): sum of f * ln((n_ci + 1) / (n_c + a)) + ln prior, a being the number of distinct terms of the document.

    Known (term, class) counts join on the term; what all classes have in common, ln 1 for terms a
    class lacks, needs only the document's own sums, so documents meet classes, not terms.
    """
    sums = test.groupBy(doc).agg(F.sum("f").alias("_f"), F.count(F.lit(1)).alias("_a"))
    known = test.join(per_term, "term").groupBy(doc, cat).agg(F.sum(F.col("f") * F.log(F.col("n_ci") + 1.0)).alias("_known"))
    joined = sums.crossJoin(broadcast_within(classes, CLASSES)).join(known, [doc, cat], "left")
    score = F.coalesce("_known", F.lit(0.0)) - F.col("_f") * F.log(F.col("n_c") + F.col("_a").cast("double")) + F.log("prior")
    return joined.select(doc, cat, F.round(score, 6).alias("score"))


def complement_train(counts: DataFrame, cat: str, doc: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cat, term, own), (term, every) and (cat, theta_all): tf-idf weights, scaled by the document's length and summed.

    A class's weight of a term is every - own, what all other classes have. Only the pairs of class
    and term that occur have a row; theta_all is the sum of a class's weights over all terms.
    """
    n = counts.select(doc).distinct().count()
    weight = F.log(F.col("f") + 1.0) * F.log(F.lit(float(n)) / F.col("df"))
    weighted = counts.join(document_frequencies(counts, doc), "term").withColumn("w", weight)
    norm = weighted.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scaled = weighted.join(norm, doc).withColumn("w", F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0))
    ensure_checkpoints(counts.sparkSession)
    own = scaled.groupBy(cat, "term").agg(F.sum("w").alias("own")).checkpoint()  # read four times below
    every = own.groupBy("term").agg(F.sum("own").alias("every"))
    sums = own.groupBy(cat).agg(F.sum("own").alias("own_all"))
    total = F.sum("own_all").over(Window.partitionBy(F.lit(0)))  # one row a class
    return own, every, sums.select(cat, (total - F.col("own_all")).alias("theta_all"))


def complement_score(test: DataFrame, own: DataFrame, every: DataFrame, totals: DataFrame, cat: str, doc: str) -> DataFrame:
    """(doc, cat, score): minus the sum of f * ln((theta + 1) / (theta_all + a)), theta being every - own; the class whose complement fits worst wins.

    f * ln(every + 1) is summed once per document; classes that have a term themselves correct it. So
    terms meet the classes they occur in, never all of them.
    """
    sums = test.groupBy(doc).agg(F.sum("f").alias("_f"), F.count(F.lit(1)).alias("_a"))
    known = test.join(every, "term").withColumn("_base", F.log(F.col("every") + 1.0))
    base = known.groupBy(doc).agg(F.sum(F.col("f") * F.col("_base")).alias("_base"))
    mended = known.join(own, "term").groupBy(doc, cat).agg(F.sum(F.col("f") * (F.log(F.col("every") - F.col("own") + 1.0) - F.col("_base"))).alias("_mend"))
    joined = sums.join(base, doc, "left").crossJoin(broadcast_within(totals, CLASSES)).join(mended, [doc, cat], "left")
    fit = F.coalesce("_base", F.lit(0.0)) + F.coalesce("_mend", F.lit(0.0))
    score = F.col("_f") * F.log(F.col("theta_all") + F.col("_a").cast("double")) - fit
    return joined.select(doc, cat, F.round(score, 6).alias("score"))


def ranked(scores: DataFrame, doc: str, cat: str) -> DataFrame:
    """scores with the rank of each class for each document; ties go to the lesser class name."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), cat)).cast("bigint"))


def accuracy(ranks: DataFrame, truth: DataFrame, doc: str, cat: str, label: str) -> DataFrame:
    """(docs, accuracy, top3): how often the true class ranks first, and among the first three."""
    of = ranks.join(truth, doc).filter(F.col(cat) == F.col(label))
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return of.agg(F.count(F.lit(1)).alias("docs"), hit(1).alias("accuracy"), hit(3).alias("top3"))


def categorical_train(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(label, feature, value, n, n_label, p): Laplace estimate (n + 1) / (n_label + 1) of each value given the label."""
    pairs = df.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])).alias("x")).select(label, "x.*")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))
    counts = pairs.groupBy(label, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(sizes, label).withColumn("p", (F.col("n") + 1) / (F.col("n_label") + 1))


def categorical_posterior(df: DataFrame, model: DataFrame, sizes: DataFrame, id: str, features: list[str], label: str) -> DataFrame:
    """(id, label, log_posterior) for each row and label; a value never seen with a label counts 1 / (n_label + 1). sizes: (label, n_label)."""
    total = F.sum("n_label").over(Window.partitionBy(F.lit(0)))
    labels = sizes.select(label, "n_label", F.log(F.col("n_label") / total).alias("_prior"))
    pairs = df.select(id, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])).alias("x")).select(id, "x.*")
    every = pairs.crossJoin(broadcast_within(labels, CLASSES)).join(model.select(label, "feature", "value", "p"), [label, "feature", "value"], "left")
    p = F.coalesce("p", 1 / (F.col("n_label") + 1.0))
    return every.groupBy(id, label).agg(F.round(F.sum(F.log(p)) + F.first("_prior"), 6).alias("log_posterior"))
