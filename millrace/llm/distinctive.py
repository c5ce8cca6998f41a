"""Problem 3: how distinctive a term is of a record, by a two-Poisson mixture per term.

A term's counts over all records are taken as a mixture of two Poisson laws: the few elite records
that are about the term, and the rest. The mixture is fitted by expectation-maximisation on the
term's histogram (how many records hold it 0, 1, 2, ... times), which is tiny beside the records.
The score of an occurrence count is the posterior probability that the record is elite; it has the
closed form of a logistic function of the count, so scoring stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.records import Counted, counted_pairs, with_record_totals

#: Rounds of fitting at most, and the relative move of a parameter below which a term's fit is done.
ROUNDS, TOLERANCE = 300, 1e-6

MODEL = "term string, df long, occurrences long, elite_share double, elite_mean double, rest_mean double, base double, slope double"


def fit_two_poisson(owner: np.ndarray, count: np.ndarray, weight: np.ndarray, records: int, terms: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, ...]:
    """Fit all terms at once. owner: term number of a histogram cell, not decreasing; count, weight: the cell.

    Returns (elite share, elite mean, rest mean) per term. The zero counts are the records that no cell
    has. A term is done when no parameter moves by more than `tolerance` of itself, or after `rounds`.
    """
    n = float(records)
    held = np.bincount(owner, weight, terms)
    total = np.bincount(owner, weight * count, terms)
    zero = np.maximum(n - held, 0.0)
    share = np.clip(held / n, 1e-12, 1 - 1e-9)
    high, low = np.maximum(total / held, 1.0), np.maximum(0.1 * total / n, 1e-12)
    going = np.arange(terms)
    for _ in range(rounds):
        if not len(going):
            break
        s, h, l = share[going], high[going], low[going]
        base = np.log(s) - np.log1p(-s) - (h - l)
        slope = np.log(h) - np.log(l)
        elite = weight / (1 + np.exp(-np.clip(base[owner] + slope[owner] * count, -700, 700)))
        elite_zero = zero[going] / (1 + np.exp(-np.clip(base, -700, 700)))
        mass = np.bincount(owner, elite, len(going)) + elite_zero
        part = np.bincount(owner, elite * count, len(going))
        s = np.clip(mass / n, 1e-12, 1 - 1e-9)
        h = np.maximum(part / np.maximum(mass, 1e-12), 1e-9)
        l = np.maximum((total[going] - part) / np.maximum(n - mass, 1e-9), 1e-12)
        h, l = np.maximum(h, l * (1 + 1e-9)), np.minimum(h, l)
        moved = np.maximum.reduce([np.abs(new - old[going]) / old[going] for new, old in ((s, share), (h, high), (l, low))])
        share[going], high[going], low[going] = s, h, l
        stays = moved > tolerance
        if not stays.all():
            kept = stays[owner]
            owner, count, weight = (np.cumsum(stays) - 1)[owner[kept]], count[kept], weight[kept]
            going = going[stays]
    return share, high, low


def log_likelihood(owner: np.ndarray, count: np.ndarray, weight: np.ndarray, records: int, share: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Log-likelihood of each term's histogram under its mixture, without the factorials, which no parameter moves."""
    mixed = lambda o, c: np.logaddexp(np.log(share[o]) + c * np.log(high[o]) - high[o], np.log1p(-share[o]) + c * np.log(low[o]) - low[o])
    each = np.arange(len(share))
    zero = np.maximum(records - np.bincount(owner, weight, len(share)), 0)
    return np.bincount(owner, weight * mixed(owner, count), len(share)) + zero * mixed(each, 0.0)


def _fit(batches: Iterator[pa.RecordBatch], records: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        cells = b.column("cells")
        flat, sizes = cells.flatten(), np.diff(cells.offsets.to_numpy())
        owner = np.repeat(np.arange(b.num_rows), sizes)
        count, weight = flat.field("tf").to_numpy().astype(float), flat.field("n").to_numpy().astype(float)
        share, high, low = fit_two_poisson(owner, count, weight, records, b.num_rows)
        base = np.log(share) - np.log1p(-share) - (high - low)
        yield pa.RecordBatch.from_arrays(
            [b.column("term"), pa.array(np.bincount(owner, weight, b.num_rows).astype(np.int64)), pa.array(np.bincount(owner, weight * count, b.num_rows).astype(np.int64)), *map(pa.array, (share, high, low, base, np.log(high) - np.log(low)))],
            names=[f.split()[0] for f in MODEL.split(", ")],
        )


def term_models(counted: Counted) -> DataFrame:
    """One row per term: document frequency, occurrences and the fitted mixture. A term's cells are as many as its distinct counts."""
    cells = counted.pairs.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("term").agg(F.collect_list(F.struct("tf", "n")).alias("cells")).mapInArrow(partial(_fit, records=counted.records), MODEL)


def distinctive_terms(rows: DataFrame, **columns: str) -> DataFrame:
    """(docno, term, tf, total, df, records, score, log_odds): every term of every record with the posterior that the record is elite for it.

    total is the count of all terms of the record, records the number of records; log_odds is the
    score's logit, which still tells scores apart that are 1 in doubles. Rows count as counted_pairs
    says; an empty table gives no rows. Equal counts of a term get equal scores. The join on the term
    may meet very common terms: it is a shuffle join that AQE splits.
    """
    counted = counted_pairs(rows, **columns)
    pairs = with_record_totals(counted).drop("salt")
    odds = F.col("base") + F.col("slope") * F.col("tf")
    score = 1 / (1 + F.exp(-odds))
    return pairs.join(term_models(counted).select("term", "df", "base", "slope"), "term").select("docno", "term", "tf", "total", "df", F.lit(counted.records).cast("long").alias("records"), score.alias("score"), odds.alias("log_odds"))


def top_terms(scored: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """(docno, rank, term, score): the k terms each record is most likely elite for, at least with the posterior `least`; equal odds go to the lesser term.

    Records without such a term give no row. Tasks keep k rows a record before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("docno").orderBy(F.desc("log_odds"), "term"))
    kept = scored.filter(F.col("score") >= least).select("docno", "term", "score", "log_odds")
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).select("docno", "rank", "term", "score")
