"""Ranking measures of long score tables (group, label, model, score, key)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expressions import flag
from riskweave.operators.ranking import average_rank, global_rank, sums_before


def placed(scores: DataFrame, by: list[str], key: str = "cve_id") -> DataFrame:
    """scores with position (by score), ideal (by label), n, and hits (relevant ones up to the position)."""
    ranked = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(key))
    ideal = Window.partitionBy(*by).orderBy(F.desc("label"), F.asc(key))
    return scores.withColumns({"position": F.row_number().over(ranked), "ideal": F.row_number().over(ideal), "n": F.count(F.lit(1)).over(Window.partitionBy(*by))})


def ideal_gains(labels: DataFrame, by: list[str], ks: list[int], gain: Column) -> DataFrame:
    """(by, ideal_{k}): best discounted gains from counts of labels (by, label, c). Rows of one label take consecutive positions, so only the few labels of a group are put in order, not its rows."""
    above = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy(F.desc("label")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = [0.0]
    for i in range(1, max(ks) + 1):
        upto.append(upto[-1] + 1 / math.log2(i + 1))
    sums = F.array(*[F.lit(x) for x in upto])

    def discounts(k: int) -> Column:
        end, start = (F.element_at(sums, F.least(c, F.lit(k)).cast("int") + 1) for c in (F.col("_above") + F.col("c"), F.col("_above")))
        return end - start

    return labels.withColumn("_above", above).groupBy(*by).agg(*[F.sum(gain * discounts(k)).alias(f"ideal_{k}") for k in ks])


def _joined(a: DataFrame, b: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Summaries of one row for each group, joined by group; null groups meet."""
    named = b.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in b.columns if c not in by])
    met = F.lit(True)
    for c in by:
        met &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(named, met, how).drop(*[f"_{c}" for c in by])


def grouped_metrics(scores: DataFrame, group: str, ks: list[int], model: str = "model", key: str = "cve_id", relevant: float = 2.0, labels: DataFrame | None = None) -> DataFrame:
    """(model, group, n, and for each k ndcg, precision, recall, ap): exponential gain; precision over min(k, n); average precision over the relevant ones retrieved.

    Of a group only the first rows by score are put in order, which Spark limits before it shuffles; the rest are counts of labels. So a group may hold any share of the rows.
    With ``labels``, counts c of (model, group, label) that the caller has, scores need hold only rows that may be among the first of their group.
    """
    by, most = [model, group], max(ks)
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    labels = scores.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("c")) if labels is None else labels
    sizes = labels.groupBy(*by).agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("label") >= relevant, F.col("c"))), F.lit(0)).alias("_rel"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(key)))
    tops = scores.select(*by, key, "score", "label").withColumn("position", place).where(F.col("position") <= most).withColumn("rel", flag(F.col("label") >= relevant))
    running = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = tops.withColumn("hits", F.sum("rel").over(running))
    firsts = []
    for k in ks:
        top = F.col("position") <= k
        firsts += [
            F.sum(F.when(top, gain / F.log2(F.col("position") + 1)).otherwise(0.0)).alias(f"_dcg_{k}"),
            F.sum(F.when(top, F.col("rel")).otherwise(0)).alias(f"_found_{k}"),
            F.sum(F.when(top & (F.col("rel") == 1), F.col("hits") / F.col("position")).otherwise(0.0)).alias(f"_ap_{k}"),
        ]
    every = _joined(_joined(sizes, ideal_gains(labels, by, ks, gain), by), tops.groupBy(*by).agg(*firsts), by)
    parts = []
    for k in ks:
        found, ideal = F.col(f"_found_{k}"), F.col(f"ideal_{k}")
        parts += [
            F.when(ideal > 0, F.col(f"_dcg_{k}") / ideal).otherwise(0.0).alias(f"ndcg_{k}"),
            (found / F.least(F.lit(k), F.col("n"))).alias(f"precision_{k}"),
            F.when(F.col("_rel") > 0, found / F.col("_rel")).otherwise(0.0).alias(f"recall_{k}"),
            F.when(found > 0, F.col(f"_ap_{k}") / found).otherwise(0.0).alias(f"ap_{k}"),
        ]
    return every.select(*by, "n", *parts)


def macro(scores: DataFrame, group: str, ks: list[int], model: str = "model", key: str = "cve_id", relevant: float = 2.0, labels: DataFrame | None = None) -> DataFrame:
    """Means over groups of two rows or more; groups without a relevant row count as 0."""
    each = grouped_metrics(scores, group, ks, model, key, relevant, labels).where("n >= 2")
    names = [f"{m}_{k}" for k in ks for m in ("ndcg", "precision", "recall", "ap")]
    return each.groupBy(model).agg(F.count(F.lit(1)).alias("groups"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def linear_ndcg(scores: DataFrame, group: str, k: int, model: str = "model") -> DataFrame:
    """(model, group, ndcg) with gain equal to the label; equal scores share the mean gain of their block; groups without gain are left out.

    Rows are counted by score and by label; of a group's blocks only the first k are put in order.
    """
    by = [model, group]
    blocks = scores.groupBy(*by, "score").agg(F.avg("label").alias("_gain"), F.count(F.lit(1)).alias("_c"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score")))
    firsts = blocks.withColumn("_b", place).where(F.col("_b") <= k)
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = [0.0]
    for i in range(1, k + 1):
        upto.append(upto[-1] + 1 / math.log2(i + 1))
    sums = F.array(*[F.lit(x) for x in upto])
    at = lambda c: F.element_at(sums, F.least(c, F.lit(k)).cast("int") + 1)
    dcg = firsts.withColumn("_before", before).groupBy(*by).agg(F.sum(F.col("_gain") * (at(F.col("_before") + F.col("_c")) - at(F.col("_before")))).alias("dcg"))
    ideal = ideal_gains(scores.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("c")), by, [k], F.col("label"))
    return _joined(dcg, ideal, by).where(F.col(f"ideal_{k}") > 0).select(*by, (F.col("dcg") / F.col(f"ideal_{k}")).alias("ndcg"))


def flat_metrics(scores: DataFrame, k: int, model: str = "model", key: str = "cve_id", relevant: float = 2.0) -> DataFrame:
    """(model, precision, recall, ap): over all rows of a model; precision over k; average precision with one threshold for each distinct score.

    Counts of distinct scores are put in order by range, so a model with as many scores as rows doesn't meet in one task either.
    """
    rows = scores.withColumn("rel", flag(F.col("label") >= relevant))
    top = global_rank(rows.select(model, "score", key, "rel"), [F.col(model).asc(), F.desc("score"), F.asc(key)], "_g")
    first = top.groupBy(model).agg((F.min("_g") - 1).alias("_before"))
    found = top.join(F.broadcast(first), model).where(F.col("_g") - F.col("_before") <= k).groupBy(model).agg(F.sum("rel").alias("found"))
    cuts = rows.groupBy(model, "score").agg(F.sum("rel").alias("r"), F.count(F.lit(1)).alias("c"))
    steps = sums_before(cuts, [model], [F.desc("score")], {"_r": "r", "_c": "c"}).withColumns({"_r": F.col("_r") + F.col("r"), "_c": F.col("_c") + F.col("c")})
    ap = steps.groupBy(model).agg(F.sum(F.col("r") * F.col("_r") / F.col("_c")).alias("s"), F.sum("r").alias("total"))
    return ap.join(found, model).select(model, F.round(F.col("found") / k, 6).alias("precision"), F.round(F.try_divide(F.col("found"), F.col("total")), 6).alias("recall"), F.round(F.coalesce(F.try_divide(F.col("s"), F.col("total")), F.lit(0.0)), 6).alias("ap"))


def capture(scores: DataFrame, flagged: DataFrame, k: int, model: str = "model", key: str = "cve_id") -> DataFrame:
    """(model, captured, total): flagged keys among each model's first k, and in all."""
    place = F.row_number().over(Window.partitionBy(model).orderBy(F.desc("score"), F.asc(key)))
    tops = scores.select(model, key, "score").withColumn("_p", place).where(F.col("_p") <= k).join(flagged.select(key).distinct().withColumn("_f", F.lit(1)), key, "left")
    total = F.broadcast(flagged.agg(F.count_distinct(key).alias("total")))
    return tops.groupBy(model).agg(F.sum(F.coalesce("_f", F.lit(0))).alias("captured")).join(total)


def lift_table(metrics: DataFrame, model: str, value: str, base: str) -> DataFrame:
    """(model, value, lift_pct) against the base model."""
    b = F.broadcast(metrics.where(F.col(model) == base).select(F.col(value).alias("_b")))
    return metrics.join(b).select(model, value, F.round(100 * F.try_divide(F.col(value) - F.col("_b"), F.col("_b")), 4).alias("lift_pct"))


def spearman(scores: DataFrame, model: str = "model") -> DataFrame:
    """(model, rho) of score and label by mean ranks: ranks come from counts of values that are put in order by range, so no model's rows meet in one task."""
    out = scores
    for value in ("score", "label"):
        counts = sums_before(scores.groupBy(model, value).agg(F.count(F.lit(1)).alias("_c")), [model], [F.desc(value)], {"_b": "_c"})
        ranks = counts.withColumn(f"_r{value}", F.col("_b") + (F.col("_c") + 1) / 2).drop("_c", "_b")
        out = out.join(ranks, [model, value])
    return out.groupBy(model).agg(F.round(F.corr("_rscore", "_rlabel"), 6).alias("rho"))


def increments(variants: DataFrame, order: str, value: str) -> DataFrame:
    """variants with the change against the one before, absolute and in percent: a row for each variant."""
    before = F.lag(value).over(Window.orderBy(order))
    return variants.withColumn("change", F.round(F.col(value) - before, 6)).withColumn("change_pct", F.round(100 * F.try_divide(F.col(value) - before, before), 4))


def drops(variants: DataFrame, name: str, value: str, full: str) -> DataFrame:
    """variants with the drop against the full one, absolute and in percent of it."""
    whole = F.broadcast(variants.where(F.col(name) == full).select(F.col(value).alias("_full")))
    return variants.join(whole).withColumn("drop", F.round(F.col("_full") - F.col(value), 6)).withColumn("drop_pct", F.round(100 * F.try_divide(F.col("_full") - F.col(value), F.col("_full")), 4)).drop("_full")


def slice_metrics(scores: DataFrame, slices: dict, ks: list[int], model: str = "model", key: str = "cve_id", relevant: float = 0.5) -> DataFrame:
    """(model, slice, n, relevant, and for each k ndcg and precision) over all rows of each slice (name -> condition), exponential gain; precision over k.

    Only the first rows by score and by label are put in order, which Spark limits before it shuffles.
    """
    tags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in slices.items()]))
    rows = scores.select(model, key, "score", "label", F.explode(tags).alias("slice"))
    by, most = [model, "slice"], max(ks)
    gain = F.pow(F.lit(2.0), F.col("label")) - 1

    def firsts(order: str, name: str) -> DataFrame:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order), F.asc(key)))).where(F.col(name) <= most)

    tops, ideals = firsts("score", "_p"), firsts("label", "_i")
    dcg = [F.sum(F.when(F.col("_p") <= k, gain / F.log2(F.col("_p") + 1)).otherwise(0.0)).alias(f"_d{k}") for k in ks]
    found = [(F.count_if((F.col("_p") <= k) & (F.col("label") >= relevant)) / k).alias(f"precision_{k}") for k in ks]
    idcg = [F.sum(F.when(F.col("_i") <= k, gain / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias(f"_b{k}") for k in ks]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") >= relevant).alias("relevant"))
    out = counts.join(tops.groupBy(*by).agg(*dcg, *found), by).join(ideals.groupBy(*by).agg(*idcg), by)
    ndcg = [F.round(F.when(F.col(f"_b{k}") > 0, F.col(f"_d{k}") / F.col(f"_b{k}")).otherwise(0.0), 6).alias(f"ndcg_{k}") for k in ks]
    return out.select(*by, "n", "relevant", *ndcg, *[F.round(f"precision_{k}", 6).alias(f"precision_{k}") for k in ks])


def top_mix(scores: DataFrame, k: int, model: str = "model", key: str = "cve_id") -> DataFrame:
    """(model, label, n, share) of each model's first k rows."""
    place = F.row_number().over(Window.partitionBy(model).orderBy(F.desc("score"), F.asc(key)))
    tops = scores.select(model, key, "score", "label").withColumn("_p", place).where(F.col("_p") <= k)
    return tops.groupBy(model, "label").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / k, 6))


def precision_at(scores: DataFrame, ks: list[int], relevant: float, model: str = "model", key: str = "cve_id") -> DataFrame:
    """(model, k, found, precision) of each model's first rows over the whole table."""
    place = F.row_number().over(Window.partitionBy(model).orderBy(F.desc("score"), F.asc(key)))
    tops = scores.select(model, key, "score", "label").withColumn("_p", place).where(F.col("_p") <= max(ks))
    long = tops.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("_p") <= F.col("k"))
    return long.groupBy(model, "k").agg(F.count_if(F.col("label") >= relevant).alias("found")).withColumn("precision", F.round(F.col("found") / F.col("k"), 6))


def long_table(metrics: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(strategy, keys, metric, value) of wide metric tables by strategy, as one long table."""
    out = None
    for strategy, table in metrics.items():
        names = [c for c in table.columns if c not in keys]
        wide = table.select(F.lit(strategy).alias("strategy"), *keys, *[F.col(c).cast("double").alias(c) for c in names])
        part = wide.unpivot(["strategy", *keys], names, "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["average_rank", "capture", "drops", "flat_metrics", "grouped_metrics", "ideal_gains", "increments", "lift_table", "linear_ndcg", "long_table", "macro", "placed", "precision_at", "slice_metrics", "spearman", "top_mix"]
