"""Scores by fixed weights, as column expressions, and their additive contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expressions import number
from riskweave.operators.filters import one_row

# fixed values: weights of the scores
SIMPLE = {"recency": 0.4, "kev_flag": 0.4, "cvss_norm": 0.2}
WEIGHTED = {"recency": 0.20, "kev_flag": 0.25, "cvss_norm": 0.10, "chpl_flag": 0.15, "is_healthcare": 0.05, "attack_flag": 0.10, "epss_score": 0.15}
HEURISTIC = {"kev_flag": 0.35, "epss_score": 0.30, "cvss_norm": 0.20, "is_healthcare": 0.10, "recency": 0.05}
LEAKAGE_FREE = {"cvss_norm": 0.50, "has_attack": 0.20, "is_healthcare": 0.15, "recency": 0.15}


def weighted(weights: dict[str, float]) -> Column:
    """Sum of weight times column; missing values count as 0."""
    return sum((number(c) * w for c, w in weights.items()), F.lit(0.0))


def cvss_only() -> Column:
    return number("cvss", 5.0) / 10.0


def epss_only() -> Column:
    return number("epss_score")


def risk_averse(scores: DataFrame, key: str, score: str, aversion: float) -> DataFrame:
    """Mean minus ``aversion`` times the population deviation of a key's scores."""
    return scores.groupBy(key).agg((F.avg(score) - aversion * F.stddev_pop(score)).alias("score"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("deviation"))


def normalised_average(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with ``score``: mean of both columns after each is moved to [0, 1] over the table."""
    ends = one_row(df, *[f(c).alias(f"_{n}{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: (F.col(c) - F.col(f"_lo{c}")) / F.when(F.col(f"_hi{c}") == F.col(f"_lo{c}"), 1.0).otherwise(F.col(f"_hi{c}") - F.col(f"_lo{c}"))
    return df.join(ends).withColumn("score", (part(a) + part(b)) / 2).drop(*[f"_{n}{c}" for c in (a, b) for n in ("lo", "hi")])


def contributions(df: DataFrame, weights: dict[str, float], key: str = "cve_id", top: int = 3) -> DataFrame:
    """(key, feature, contribution, place): the ``top`` largest parts ``w * (x - mean x)`` of each record's score, exact for weighted sums."""
    means = one_row(df, *[F.avg(number(c)).alias(f"_m_{c}") for c in weights])
    parts = df.join(means).select(key, *[((number(c) - F.col(f"_m_{c}")) * w).alias(c) for c, w in weights.items()])
    long = parts.unpivot([key], list(weights), "feature", "contribution")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.round("contribution", 9)).desc(), "feature"))
    return long.withColumn("place", place).where(F.col("place") <= top)


def mean_contributions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(feature, importance): mean absolute contribution over all records."""
    means = one_row(df, *[F.avg(number(c)).alias(f"_m_{c}") for c in weights])
    row = df.join(means).agg(*[F.avg(F.abs((number(c) - F.col(f"_m_{c}")) * w)).alias(c) for c, w in weights.items()])
    return row.unpivot([], list(weights), "feature", "importance")
