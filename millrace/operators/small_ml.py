"""Small learners on few rows: perceptron, tanh unit, one-hidden-layer network.

They are sequential by definition (each row moves the weights the next row meets), so a task holds
the rows of one group; groups run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Cells (rows of groups, filled up to the longest of them) that are trained together.
CELLS = 1 << 18


def _trained(rows: list[np.ndarray], width: int, rate: float, epochs: int, out: Callable, slope: Callable) -> np.ndarray:
    """Weights per group. rows: per group the features with a constant 1, then the target. Groups go side by side, each row by row."""
    longest = max(len(r) for r in rows)
    x, y, here = np.zeros((longest, len(rows), width)), np.zeros((longest, len(rows))), np.zeros((longest, len(rows), 1))
    for g, r in enumerate(rows):
        x[: len(r), g], y[: len(r), g], here[: len(r), g] = r[:, :width], r[:, width], rate
    w = np.zeros((len(rows), width))
    for _ in range(epochs):
        for xi, yi, step in zip(x, y, here, strict=True):
            o = out((xi * w).sum(axis=1))
            w = w + step * ((yi - o) * slope(o))[:, None] * xi
    return w


def _sequential(df: DataFrame, group: str | list[str], features: list[str], target: str, order: str, rate: float, epochs: int, out: Callable, slope: Callable) -> DataFrame:
    """(group, weights): weights of the features and of a constant 1, moved row by row in order.

    Rows of a group stay in one task, since each moves the weights the next one meets; a task trains
    its groups side by side.
    """
    keys = [group] if isinstance(group, str) else group
    value = lambda c: F.col(c).cast("double").alias(c)
    together = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), F.array(*map(value, features), F.lit(1.0), value(target)).alias("_row")))).alias("_rows"))
    kinds = dict(df.dtypes)
    width = len(features) + 1

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [np.array(rows, float).reshape(-1, width + 1) for rows in b.column(len(keys)).to_pylist()]
            weights: list = [None] * len(flat)
            waiting = sorted(range(len(flat)), key=lambda g: len(flat[g]))
            while waiting:
                longest, chosen = len(flat[waiting[-1]]), []
                while waiting and (len(chosen) + 1) * longest <= max(CELLS, longest):
                    chosen.append(waiting.pop())
                for g, w in zip(chosen, _trained([flat[g] for g in chosen], width, rate, epochs, out, slope), strict=True):
                    weights[g] = w.tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(weights, pa.list_(pa.float64()))], names=[*keys, "weights"])

    rows = together.select(*keys, F.col("_rows._row").alias("_rows"))
    return rows.mapInArrow(train, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", weights array<double>")


def perceptron(df: DataFrame, group: str | list[str], features: list[str], target: str, order: str, rate: float = 0.05, epochs: int = 100) -> DataFrame:
    """A step unit; targets are 0 and 1."""
    return _sequential(df, group, features, target, order, rate, epochs, lambda a: (a >= 0).astype(float), np.ones_like)


def tanh_unit(df: DataFrame, group: str | list[str], features: list[str], target: str, order: str, rate: float = 0.05, epochs: int = 200) -> DataFrame:
    """A tanh unit with gradient steps; targets are -1 and 1."""
    return _sequential(df, group, features, target, order, rate, epochs, np.tanh, lambda o: 1 - o * o)


def network(df: DataFrame, features: list[str], target: str, hidden: int = 2, seed: int = 1):
    """A network with one hidden layer by Spark's own classifier; returns the fitted model for a `features` vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    net = MultilayerPerceptronClassifier(layers=[len(features), hidden, 2], maxIter=200, seed=seed, featuresCol="_x", labelCol=target)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), net]).fit(df)
