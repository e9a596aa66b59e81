"""A linear ranker fitted on the change of NDCG that exchanging two rows of a group would make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expressions import number
from riskweave.operators.evaluate import ideal_gains
from riskweave.operators.ranking import global_rank
from riskweave.session import stage, unstage

#: Rows of a group that a task pairs together, besides the few of the next block that theirs meet.
BLOCK = 1000


def _gain(label: str) -> Column:
    return F.pow(F.lit(2.0), F.col(label)) - 1


def _discount(position: Column, k: int) -> Column:
    return F.when(position <= k, 1 / F.log2(position + 1)).otherwise(0.0)


def prepared(rows: DataFrame, features: list[str], k: int, key: str = "cve_id") -> DataFrame:
    """Staged rows with their group's ideal DCG and the rank before its first row when groups stand in order: neither changes between rounds. Groups without gain teach nothing and go."""
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).join(ideal_gains(rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("c")), ["group"], [k], _gain("label")).withColumnRenamed(f"ideal_{k}", "ideal").where("ideal > 0"), "group")
    ordered = global_rank(sizes, [F.col("group").asc()], "_g")
    parts = ordered.withColumn("_part", F.floor(F.col("_g") / BLOCK))
    # running sizes over groups: within blocks of groups, and over the blocks
    blocks = parts.groupBy("_part").agg(F.sum("_n").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("_inside", inside).join(blocks, "_part").select("group", "ideal", (F.col("_start") + F.col("_inside")).alias("_before"))
    return stage(rows.select(key, "group", "label", "weight", *[number(c).alias(c) for c in features]).join(starts, "group"), "listwise-rows")


def gradient(ready: DataFrame, weights: dict[str, float], k: int, near: int, key: str = "cve_id") -> tuple[dict[str, float], dict[str, float]]:
    """First and second derivatives of the loss at the weights, one of each for each feature, from one aggregation.

    Rows are ranked in their groups by their present scores (ties by key). Each row meets the ``near`` rows that follow it; a pair of different labels weighs the mean of its confidences times the
    change of NDCG at k if the two exchanged places. Ranks come from a range exchange over all groups, and rows meet in blocks, so one group may hold all rows.
    """
    features = list(weights)
    scored = ready.withColumn("_score", sum((F.col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0)))
    ranked = global_rank(scored, [F.col("group").asc(), F.desc("_score"), F.col(key).asc()], "_rank").withColumns({"_place": F.col("_rank") - F.col("_before"), "_block": F.floor(F.col("_rank") / BLOCK)})
    ahead = ranked.where(F.col("_rank") % BLOCK < near).withColumn("_block", F.col("_block") - 1).withColumn("_own", F.lit(False))
    dealt = ranked.withColumn("_own", F.lit(True)).unionByName(ahead)
    following = Window.partitionBy("group", "_block").orderBy("_rank").rowsBetween(1, near)
    carried = ["label", "weight", "_place", "_score", *features]
    met = dealt.withColumn("_next", F.collect_list(F.struct(*carried)).over(following)).where("_own").withColumn("o", F.explode("_next")).where("label <> o.label")
    sign = F.when(F.col("label") > F.col("o.label"), 1.0).otherwise(-1.0)
    change = F.abs((_gain("label") - _gain("o.label")) * (_discount(F.col("_place"), k) - _discount(F.col("o._place"), k))) / F.col("ideal")
    wrong = 1 / (1 + F.exp(sign * (F.col("_score") - F.col("o._score"))))
    pairs = met.withColumns({"_pull": (F.col("weight") + F.col("o.weight")) / 2 * change, "_wrong": wrong, "_sign": sign})
    difference = {c: (F.col(c) - F.col(f"o.{c}")) for c in features}
    row = pairs.agg(
        *[F.sum(-F.col("_pull") * F.col("_wrong") * F.col("_sign") * d).alias(f"g{i}") for i, d in enumerate(difference.values())],
        *[F.sum(F.col("_pull") * F.col("_wrong") * (1 - F.col("_wrong")) * d * d).alias(f"h{i}") for i, d in enumerate(difference.values())],
    ).first()
    return {c: float(row[f"g{i}"] or 0.0) for i, c in enumerate(features)}, {c: float(row[f"h{i}"] or 0.0) for i, c in enumerate(features)}


def fit(rows: DataFrame, features: list[str], k: int = 10, rounds: int = 15, near: int = 10, step: float = 0.3, regular: float = 1e-3, start: dict[str, float] | None = None, key: str = "cve_id") -> DataFrame:
    """(feature, weight) after ``rounds`` refittings: each ranks all groups by the scores so far and moves every weight by its own second-order step, clipped to 1. The first round
    ranks by ``start`` (zeros if none is given)."""
    ready = prepared(rows, features, k, key)
    weights = {c: float((start or {}).get(c, 0.0)) for c in features}
    for _ in range(rounds):
        first, second = gradient(ready, weights, k, near, key)
        whole = sum(second.values()) / len(features)
        for c in features:
            move = step * (first[c] + regular * weights[c]) / (second[c] + 0.1 * whole + regular)
            weights[c] -= max(-1.0, min(1.0, move))
    unstage(ready)
    return rows.sparkSession.createDataFrame(list(weights.items()), "feature string, weight double")
