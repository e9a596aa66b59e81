"""Ensembles of score tables (key, model, score)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.filters import one_row
from riskweave.operators.ranking import global_rank
from riskweave.session import stage


def standardised(scores: DataFrame, model: str = "model") -> DataFrame:
    """scores with z: the score less its model's mean over its population deviation (1 where that is 0). Models are few rows."""
    stats = scores.groupBy(model).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    return scores.join(F.broadcast(stats), model).withColumn("z", (F.col("score") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def simple_average(scores: DataFrame, key: str = "cve_id") -> DataFrame:
    return standardised(scores).groupBy(key).agg(F.avg("z").alias("score"))


def weighted_average(scores: DataFrame, weights: DataFrame, key: str = "cve_id", model: str = "model") -> DataFrame:
    """Weighted mean of scores; a model without a weight gets the mean weight."""
    mean = F.broadcast(weights.agg(F.avg("weight").alias("_mean")))
    w = F.coalesce("weight", "_mean")
    joined = scores.join(F.broadcast(weights), model, "left").join(mean)
    return joined.groupBy(key).agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))


def model_ranks(scores: DataFrame, key: str = "cve_id", model: str = "model") -> DataFrame:
    """scores with rank, 1 for the best of a model: one range order over (model, score, key), so no model meets in one task."""
    ranked = global_rank(scores, [F.col(model).asc(), F.desc("score"), F.asc(key)], "_g")
    first = ranked.groupBy(model).agg((F.min("_g") - 1).alias("_before"))
    return ranked.join(F.broadcast(first), model).withColumn("rank", F.col("_g") - F.col("_before")).drop("_g", "_before")


def reciprocal_rank(scores: DataFrame, k: int = 60, key: str = "cve_id") -> DataFrame:
    return model_ranks(scores, key).groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def borda(scores: DataFrame, key: str = "cve_id", model: str = "model") -> DataFrame:
    """Sum over models of rows behind or at the rank."""
    sizes = F.broadcast(scores.groupBy(model).agg(F.count(F.lit(1)).alias("_n")))
    return model_ranks(scores, key, model).join(sizes, model).groupBy(key).agg(F.sum(F.col("_n") - F.col("rank") + 1).alias("score"))


def fitted_weights(scores: DataFrame, label: str = "label", model: str = "model", alpha: float = 1.0) -> DataFrame:
    """(model, weight): non-negative ridge without intercept on standardised scores, normalised to sum 1, uniform if all are 0.

    The products of models are sums over rows that Spark takes; only the small system is solved here.
    """
    names = [r[0] for r in scores.select(model).distinct().orderBy(model).collect()]
    row = _wide(scores, names, label, model).agg(*_products(names)).first()
    w = _solved(np.array(row, float), len(names), alpha)
    return scores.sparkSession.createDataFrame(list(zip(names, map(float, w))), f"{model} string, weight double")


def _wide(scores: DataFrame, names: list[str], label: str, model: str) -> DataFrame:
    """cve_id, y and the standardised score of each model as _z0, _z1, ...; missing ones 0."""
    parts = [F.coalesce(F.max(F.when(F.col(model) == n, F.col("z"))), F.lit(0.0)).alias(f"_z{i}") for i, n in enumerate(names)]
    return standardised(scores, model).groupBy("cve_id").agg(*parts, F.max(label).cast("double").alias("y"))


def _products(names: list[str], times: str | None = None) -> list:
    m, by = range(len(names)), F.col(times) if times else F.lit(1)
    return [F.sum(F.col(f"_z{a}") * F.col(f"_z{b}") * by) for a in m for b in m] + [F.sum(F.col(f"_z{a}") * F.col("y") * by) for a in m]


def _solved(sums: np.ndarray, m: int, alpha: float) -> np.ndarray:
    """Weights of the ridge from the sums of products, by coordinate descent on the m x m system."""
    gram, right = sums[: m * m].reshape(m, m) + alpha * np.eye(m), sums[m * m :]
    w = np.zeros(m)
    for _ in range(10_000):
        old = w.copy()
        for i in range(m):
            w[i] = max(0.0, (right[i] - gram[i] @ w + gram[i, i] * w[i]) / gram[i, i])
        if np.abs(w - old).max() < 1e-12:
            break
    return w / w.sum() if w.sum() > 0 else np.full(m, 1 / m)


def bootstrap_ensemble(scores: DataFrame, replicas: int, label: str = "label", model: str = "model", alpha: float = 1.0, uncertain: float = 0.1) -> DataFrame:
    """(cve_id, mean, deviation, uncertain) of weighted averages whose weights are fitted on bootstrap draws of the records; uncertain are the ``uncertain`` share with the largest deviations.

    The products of all draws come from one aggregation; a row for each draw is solved on the driver, and the scores of all draws are means over models in one join.
    """
    from riskweave.operators.splits import bootstrap

    names = [r[0] for r in scores.select(model).distinct().orderBy(model).collect()]
    wide = stage(_wide(scores, names, label, model), "ensemble-wide")
    sums = bootstrap(wide, replicas, "cve_id").groupBy("replica").agg(*_products(names, "times")).orderBy("replica").collect()
    weights = [_solved(np.array(r[1:], float), len(names), alpha) for r in sums]
    each = F.array(*[sum((F.col(f"_z{i}") * float(x) for i, x in enumerate(w)), F.lit(0.0)) for w in weights])
    n = len(weights)
    mean = F.aggregate("_each", F.lit(0.0), lambda a, x: a + x) / n
    out = wide.select("cve_id", each.alias("_each")).withColumn("mean", mean)
    out = out.withColumn("deviation", F.sqrt(F.aggregate("_each", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n)).drop("_each")
    rows = one_row(out, F.count(F.lit(1)).alias("_rows"))
    ranked = global_rank(out, [F.desc("deviation"), F.asc("cve_id")], "_rank").join(rows)
    return ranked.withColumn("uncertain", F.col("_rank") <= F.floor(F.col("_rows") * F.lit(uncertain))).drop("_rank", "_rows")


def common_tops(scores: DataFrame, k: int, key: str = "cve_id", model: str = "model") -> DataFrame:
    """(model_a, model_b, common, every) of each two models that share keys: keys in both first k, and in either."""
    place = F.row_number().over(Window.partitionBy(model).orderBy(F.desc("score"), F.asc(key)))
    tops = scores.select(model, key, "score").withColumn("_p", place).where(F.col("_p") <= k)
    sizes = F.broadcast(tops.groupBy(model).agg(F.count(F.lit(1)).alias("_n")))  # a row for each model
    tops = tops.join(sizes, model)
    a, b = (tops.select(F.col(model).alias(f"model_{s}"), key, F.col("_n").alias(f"_n{s}")) for s in "ab")
    both = a.join(b, key).where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("common"), F.first("_na").alias("_na"), F.first("_nb").alias("_nb"))
    return both.select("model_a", "model_b", "common", (F.col("_na") + F.col("_nb") - F.col("common")).alias("every"))


def diversity(scores: DataFrame, k: int, key: str = "cve_id", model: str = "model") -> DataFrame:
    """(model_a, model_b, jaccard, correlation) of each two models: of their first k keys, and of their scores."""
    place = F.row_number().over(Window.partitionBy(model).orderBy(F.desc("score"), F.asc(key)))
    tops = scores.select(model, key, "score").withColumn("_p", place).where(F.col("_p") <= k)
    a, b = tops.select(F.col(model).alias("model_a"), key), tops.select(F.col(model).alias("model_b"), key)
    common = a.join(b, key).where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("c"))
    x, y = scores.select(F.col(model).alias("model_a"), key, F.col("score").alias("_x")), scores.select(F.col(model).alias("model_b"), key, F.col("score").alias("_y"))
    r = x.join(y, key).where("model_a < model_b").groupBy("model_a", "model_b").agg(F.corr("_x", "_y").alias("correlation"))
    c = F.coalesce(F.col("c"), F.lit(0))
    return r.join(common, ["model_a", "model_b"], "left").select("model_a", "model_b", F.round(c / (2 * k - c), 6).alias("jaccard"), F.round("correlation", 6).alias("correlation"))
