"""Learned rankers with pyspark.ml, preference pairs, searches, ablations and importances."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expressions import hash_bucket, number
from riskweave.operators import pairwise
from riskweave.operators.evaluate import macro
from riskweave.operators.filters import by_ids
from riskweave.operators.ranking import global_rank, top
from riskweave.operators.splits import bootstrap, hash_sample
from riskweave.session import stage, unstage


def training_rows(df: DataFrame, features: list[str], label: str = "label", group: str = "week", weight: str | None = None, key: str = "cve_id") -> DataFrame:
    """key, group, label, weight and the numeric features; missing values 0, missing weights 1."""
    return df.select(key, F.col(group).alias("group"), F.col(label).cast("double").alias("label"), (number(weight, 1.0) if weight else F.lit(1.0)).alias("weight"), *[number(c).alias(c) for c in features])


def group_sizes(rows: DataFrame, group: str = "group") -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


#: Rows of a group that a task pairs together, besides the few of the next block that theirs meet.
BLOCK = 1000
#: Rows that follow a row in its group's order by hash and make pairs with it.
PER_ROW = 8


def by_hash(rows: DataFrame, features: list[str], key: str) -> tuple[DataFrame, list[Column]]:
    """(key, group, label, weight, features, _hash), and the order of rows by group and hash. The hash is a column, as a sort would take it anew whenever it compares two rows."""
    hashed = rows.select(key, "group", "label", "weight", *features, F.md5(F.col(key).cast("string")).alias("_hash"))
    return hashed, [F.col("group").asc(), F.col("_hash").asc(), F.col(key).asc()]


def preference_pairs(rows: DataFrame, features: list[str], per_row: int = PER_ROW, key: str = "cve_id", weights: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Differences of features of two rows of a group with different labels, better first, weighted by confidence and gain difference.

    Each row meets the ``per_row`` rows that follow it in its group's order by hash: a sampling of pairs, linear in rows and the same however large a group is.
    Rows are numbered by range and paired in blocks of bounded size; a block's first rows are dealt to the block before too.
    ``weights`` names columns of weights and says what each makes of a row's confidence (``pair_weight``: the confidence itself).
    """
    hashed, order = by_hash(rows, features, key)
    ranked = global_rank(hashed, order, "_rank")
    block = F.floor(F.col("_rank") / BLOCK)
    place = lambda b, own: F.struct(b.alias("_block"), F.lit(own).alias("_own"))
    ahead = F.when(F.col("_rank") % BLOCK < per_row, F.array(place(block, True), place(block - 1, False))).otherwise(F.array(place(block, True)))
    dealt = ranked.select(key, "group", "label", "weight", *features, "_rank", F.inline(ahead))
    w = Window.partitionBy("group", "_block").orderBy("_rank").rowsBetween(1, per_row)
    placed = dealt.withColumn("_next", F.collect_list(F.struct(key, "label", "weight", *features)).over(w)).where("_own")
    met = placed.select(key, "group", "label", "weight", *features, F.explode("_next").alias("o")).where("label <> o.label")
    sign = F.when(F.col("label") > F.col("o.label"), 1.0).otherwise(-1.0)
    gain = F.abs(F.pow(F.lit(2.0), F.col("label")) - F.pow(F.lit(2.0), F.col("o.label")))
    # which side is first is no feature: a hash of both keys says, as hash_bucket(.., 2) would, whose bucket is the last bit of the hash's eighth digit
    both = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.col(f"o.{key}").cast("string")))
    better = F.substring(both, 8, 1).isin(*"02468ace").cast("double")
    turn = F.when(better == 1.0, sign).otherwise(-sign)
    weighed = [(f(F.col("weight")) * f(F.col("o.weight")) * gain).alias(name) for name, f in (weights or {"pair_weight": lambda c: c}).items()]
    return met.select("group", better.alias("first"), *weighed, *[((F.col(c) - F.col(f"o.{c}")) * turn).alias(c) for c in features])


def fit_pairs(pairs: DataFrame, features: list[str], regular: float = 0.01, rounds: int = 30, weight: str = "pair_weight") -> DataFrame:
    """(feature, weight) of a linear ranker fitted on the given columns of preference pairs."""
    x = VectorAssembler(inputCols=features, outputCol="_vector").transform(pairs)
    model = LogisticRegression(featuresCol="_vector", labelCol="first", weightCol=weight, fitIntercept=False, regParam=regular, maxIter=rounds).fit(x)
    return pairs.sparkSession.createDataFrame(list(zip(features, map(float, model.coefficients))), "feature string, weight double")


def fit_pairwise(rows: DataFrame, features: list[str], per_row: int = 8, regular: float = 0.01, rounds: int = 30) -> DataFrame:
    """(feature, weight) of a linear ranker fitted on preference pairs, which are staged: each round of fitting reads them."""
    return fit_pairs(stage(preference_pairs(rows, features, per_row), "preference-pairs"), features, regular, rounds)


def linear_scores(rows: DataFrame, weights: DataFrame, key: str = "cve_id") -> DataFrame:
    """rows with score: the weighted sum of features; one weight for each feature comes to the driver."""
    w = {r["feature"]: r["weight"] for r in weights.collect()}
    return rows.withColumn("score", sum((number(c) * v for c, v in w.items()), F.lit(0.0)))


def fit_trees(rows: DataFrame, features: list[str], depth: int = 4, rounds: int = 20, step: float = 0.1, seed: int = 7) -> PipelineModel:
    """Boosted regression trees on the label, weighted by confidence."""
    trees = GBTRegressor(featuresCol="_vector", labelCol="label", weightCol="weight", predictionCol="score", maxDepth=depth, maxIter=rounds, stepSize=step, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_vector"), trees]).fit(rows)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).drop("_vector")


def quality(rows: DataFrame, k: int = 10) -> float:
    """Mean NDCG at k over groups."""
    table = rows.select("cve_id", F.col("group").alias("week"), "label", F.lit("m").alias("model"), "score")
    row = macro(table, "week", [k]).first()
    return float(row[f"ndcg_{k}"]) if row else 0.0


def grid_search(rows: DataFrame, features: list[str], grid: dict[str, list], folds: int = 3, k: int = 10) -> DataFrame:
    """(params, mean ndcg) of every combination, on folds of whole groups."""
    dealt = stage(rows.withColumn("_fold", hash_bucket("group", folds)), "grid-folds")
    names, out = list(grid), []
    for values in itertools.product(*grid.values()):
        scores = [quality(scored(fit_trees(dealt.where(F.col("_fold") != f), features, **dict(zip(names, values))), dealt.where(F.col("_fold") == f)), k) for f in range(folds)]
        out.append((str(dict(zip(names, values))), sum(scores) / folds))
    return rows.sparkSession.createDataFrame(out, "params string, ndcg double").orderBy(F.desc("ndcg"), "params")


def ablation(train: DataFrame, test: DataFrame, variants: dict[str, list[str]], k: int = 10, rounds: int = 30) -> DataFrame:
    """(place, variant, features, ndcg): a pairwise ranker fitted anew on each column list. All are fitted together on rows that are ranked once, as ``fit_pairs`` would fit each, and judged together."""
    from riskweave.operators.searches import firsts

    every = list(dict.fromkeys(c for columns in variants.values() for c in columns))
    frames = pairwise.packed(*by_hash(train, every, "cve_id"), every, PER_ROW)
    fits = pairwise.fitted(frames, every, list(variants.values()), PER_ROW, rounds=rounds)
    for frame in frames:
        unstage(frame)
    cleaned = test.select("cve_id", "group", "label", F.lit(0).alias("_fold"), *[number(c).alias(c) for c in every])
    held = cleaned.sortWithinPartitions("group")  # so that a batch holds many rows of few groups and can leave out those that are far from a group's first
    models = F.explode(F.sequence(F.lit(0), F.lit(len(fits) - 1)))
    labels = stage(test.groupBy("group", "label").agg(F.count(F.lit(1)).alias("c")), "ablation-labels")
    tops = firsts(held, every, [[w.get(c, 0.0) for c in every] for w in fits], 1, k, [[c in w for c in every] for w in fits])
    found = macro(tops, "week", [k], labels=labels.select(models.alias("model"), F.col("group").alias("week"), "label", "c"))
    ndcg = {r["model"]: float(r[f"ndcg_{k}"]) for r in found.collect()}  # one for each variant
    unstage(labels)
    out = [(i, name, len(columns), ndcg.get(i, 0.0)) for i, (name, columns) in enumerate(variants.items())]
    return train.sparkSession.createDataFrame(out, "place int, variant string, features int, ndcg double")


def confidence_scales(train: DataFrame, val: DataFrame, features: list[str], scales: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0), k: int = 10, rounds: int = 30) -> DataFrame:
    """(scale, ndcg) of rankers fitted with confidences times each scale, kept within 0.05 and 2. Pairs are made once, with a weight for each scale, and all rankers judged together."""
    clipped = {f"_w{i}": lambda c, s=s: F.least(F.lit(2.0), F.greatest(F.lit(0.05), c * s)) for i, s in enumerate(scales)}
    pairs, held = stage(preference_pairs(stage(train, "scale-train"), features, weights=clipped), "scale-pairs"), stage(val, "scale-val")
    fitted = [{r["feature"]: r["weight"] for r in fit_pairs(pairs.select("first", name, *features), features, rounds=rounds, weight=name).collect()} for name in clipped]  # one for each feature
    scores = [F.struct(F.lit(i).alias("model"), sum((number(c) * v for c, v in w.items()), F.lit(0.0)).alias("score")) for i, w in enumerate(fitted)]
    table = held.select("cve_id", F.col("group").alias("week"), "label", F.inline(F.array(*scores)))
    found = {r["model"]: float(r[f"ndcg_{k}"]) for r in macro(table, "week", [k]).collect()}  # one for each scale
    unstage(pairs), unstage(held)
    return train.sparkSession.createDataFrame([(float(s), found.get(i, 0.0)) for i, s in enumerate(scales)], "scale double, ndcg double").orderBy(F.desc("ndcg"), "scale")


def batch_scores(rows: DataFrame, weights: DataFrame, k: int, ids: DataFrame | None = None, key: str = "cve_id") -> DataFrame:
    """(key, score) of the k best rows, of those of an id table if one is given; features that the table lacks count as 0."""
    wanted = rows if ids is None else by_ids(rows, ids, key)
    missing = [r["feature"] for r in weights.select("feature").collect() if r["feature"] not in rows.columns]
    scored_rows = linear_scores(wanted.withColumns({c: F.lit(0.0) for c in missing}) if missing else wanted, weights, key)
    return top(scored_rows.select(key, "score"), [F.desc("score"), F.asc(key)], k)


def ensemble(train: DataFrame, test: DataFrame, features: list[str], replicas: int = 5) -> DataFrame:
    """(cve_id, mean, deviation) of rankers fitted on bootstrap draws of whole groups."""
    train, test = stage(train, "ensemble-train"), stage(test, "ensemble-test")
    groups = bootstrap(train.select("group").distinct(), replicas, "group").select("group", "replica", "times")
    out = None
    for r in range(replicas):
        drawn = train.join(groups.where(F.col("replica") == r), "group").withColumn("weight", F.col("weight") * F.col("times"))
        part = linear_scores(test, fit_pairwise(drawn, features)).select("cve_id", "score")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("cve_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))


def stacking(wide: DataFrame, models: list[str], kind: str = "ridge", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Scores of a second-stage model over the models' score columns, and its (model, weight) table."""
    x = VectorAssembler(inputCols=models, outputCol="_vector", handleInvalid="skip").transform(wide)
    if kind == "ridge":
        fitted = LinearRegression(featuresCol="_vector", labelCol=label, predictionCol="score", regParam=1.0, elasticNetParam=0.0).fit(x)
        out, weights = fitted.transform(x), fitted.coefficients
    elif kind == "logistic":
        relevant = x.withColumn("_y", (F.col(label) >= 2).cast("double"))
        fitted = LogisticRegression(featuresCol="_vector", labelCol="_y").fit(relevant)
        out, weights = fitted.transform(relevant).withColumn("score", vector_to_array("probability")[1]), fitted.coefficients
    else:
        fitted = RandomForestRegressor(featuresCol="_vector", labelCol=label, predictionCol="score", numTrees=100, maxDepth=5, seed=7).fit(x)
        out, weights = fitted.transform(x), fitted.featureImportances.toArray()
    return out.select("cve_id", "score"), wide.sparkSession.createDataFrame(list(zip(models, map(float, weights))), "model string, weight double")


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    return SparkSession.getActiveSession().createDataFrame(list(zip(features, map(float, values))), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(rows: DataFrame, weights: DataFrame, features: list[str], k: int = 10) -> DataFrame:
    """(feature, drop) of the mean NDCG when a feature's values are shifted among rows in hash order."""
    base, out = quality(linear_scores(rows, weights), k), []
    for c in features:
        w = Window.partitionBy(hash_bucket("cve_id", 64)).orderBy(F.md5("cve_id"))
        out.append((c, base - quality(linear_scores(rows.withColumn(c, F.coalesce(F.lag(c).over(w), F.col(c))), weights), k)))
    return rows.sparkSession.createDataFrame(out, "feature string, drop double").orderBy(F.desc("drop"), "feature")


def importance_runs(rows: DataFrame, features: list[str], shares: tuple[float, ...], seeds: tuple[str, ...], rounds: int = 20) -> DataFrame:
    """(run, feature, importance): mean absolute contribution of each feature under rankers fitted on hash samples of several sizes and seeds."""
    held, out = stage(rows, "runs-rows"), []
    for share in shares:
        for seed in seeds:
            part = hash_sample(held, share, salt=seed)
            w = {r["feature"]: r["weight"] for r in fit_pairwise(part, features, rounds=rounds).collect()}  # one for each feature
            means = part.agg(*[F.avg(F.abs(F.col(c) * v)).alias(c) for c, v in w.items()]).first()
            out += [(f"{share}/{seed}", c, float(means[c] or 0.0)) for c in features]
    return rows.sparkSession.createDataFrame(out, "run string, feature string, importance double")


def importance_table(importance: DataFrame, most: int) -> DataFrame:
    """The first ``most`` features with their share of the whole importance and place."""
    whole = F.sum("importance").over(Window.partitionBy())  # over features
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    return importance.withColumn("share", F.try_divide(F.col("importance"), whole)).withColumn("place", place).where(F.col("place") <= most)


def save(model: PipelineModel, path: str, features: list[str], metrics: dict[str, float], n_train: int) -> None:
    """The model and, beside it, a one-row card of features, metrics and training rows."""
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession

    card = [(features, metrics, n_train)]
    SparkSession.getActiveSession().createDataFrame(card, "features array<string>, metrics map<string,double>, n_train bigint").write.mode("overwrite").json(f"{path}/card")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
