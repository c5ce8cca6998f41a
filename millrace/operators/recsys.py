"""Recommendation: parsed ratings, split by time digit, implicit ALS, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_ratings(lines: DataFrame, line: str = "value") -> DataFrame:
    """(user, item, rating, ts) from `user::item::rating::ts`."""
    part = lambda i, t: F.expr(f"try_cast(try_element_at(split({line}, '::'), {i}) AS {t})")
    return lines.select(part(1, "INT").alias("user"), part(2, "INT").alias("item"), part(3, "DOUBLE").alias("rating"), part(4, "BIGINT").alias("ts"))


def split_by_digit(ratings: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training (last digit below 6), validation (6 and 7) and test rows."""
    digit = F.pmod(F.col(ts), F.lit(10))
    return ratings.filter(digit < 6), ratings.filter((digit >= 6) & (digit < 8)), ratings.filter(digit >= 8)


def fit_implicit(ratings: DataFrame, rank: int = 8, rounds: int = 10, reg: float = 0.1, seed: int = 1):
    from pyspark.ml.recommendation import ALS

    return ALS(implicitPrefs=True, rank=rank, maxIter=rounds, regParam=reg, userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop", seed=seed).fit(ratings)


def best_of(train: DataFrame, validation: DataFrame, ranks: list[int], regs: list[float], rounds: int = 10):
    """The model with the lowest validation error over a grid."""
    fitted = [fit_implicit(train, rank, rounds, reg) for rank in ranks for reg in regs]
    return min(fitted, key=lambda m: rmse(m.transform(validation), "rating", "prediction").first()["rmse"] or float("inf"))


def rmse(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(guess), 2))).alias("rmse"))


def all_scores(model, users: DataFrame, items: DataFrame) -> DataFrame:
    """Every user with every item, scored: the full product is what is asked for."""
    return model.transform(users.select("user").distinct().crossJoin(items.select("item").distinct()))


def top_items(model, k: int) -> DataFrame:
    """The k best items of each user, blocked products with running top lists instead of the full product."""
    return model.recommendForAllUsers(k).select("user", F.posexplode("recommendations").alias("rank", "r")).select("user", "rank", "r.item", "r.rating")
