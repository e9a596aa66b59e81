"""Grids, replicas and samples of linear rankers, fitted together: a round is one aggregation over the pairs of all models."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from riskweave.functions.expressions import hash_bucket
from riskweave.operators.evaluate import macro
from riskweave.operators.models import preference_pairs
from riskweave.operators.splits import draws
from riskweave.session import stage, unstage

#: How a model moves: share of the second-order step, penalty, and what the share is multiplied by after each round.
PLAIN = {"step": 0.5, "regular": 0.01, "decay": 1.0}


def weight_table(spark, weights: list[list[float]]) -> DataFrame:
    """(model, _w): a row for each model, known on the driver, to be broadcast."""
    schema = StructType([StructField("model", IntegerType(), False), StructField("_w", ArrayType(DoubleType(), False), False)])
    return spark.createDataFrame(list(enumerate(weights)), schema)


def _weighed(df: DataFrame, features: list[str], weights: list[list[float]], name: str) -> DataFrame:
    """df with the weighted sum of its features under its model."""
    joined = df.join(F.broadcast(weight_table(df.sparkSession, weights)), "model")
    return joined.withColumn(name, sum((F.col(c) * F.col("_w")[i] for i, c in enumerate(features)), F.lit(0.0)))


#: Pairs or rows that meet the models at once: what a task holds of them stays near a megabyte for a hundred models.
SLICE = 2048


def _matrix(batch: pa.RecordBatch, first: int, count: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, first + count)], axis=1).astype(float)


def packed(pairs: DataFrame, features: list[str], members: Column, samples: int) -> DataFrame:
    """Pairs as staged rows of about 2 KB, which cost a round little more than their reading: first, weight, features and how often each sample counts the pair, as one matrix of doubles.

    members: an array of (model, times) over the samples. Pairs that lack a number teach nothing and are left out.
    """
    d = len(features)
    width = 2 + d + samples
    most = max(1, 2048 // (8 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, listed = batch.num_rows, batch.column(2 + d)
            dealt = listed.flatten()
            at = np.repeat(np.arange(n), np.diff(listed.offsets.to_numpy())) * samples + dealt.field(0).to_numpy(zero_copy_only=False)
            times = np.bincount(at, weights=dealt.field(1).to_numpy(zero_copy_only=False), minlength=n * samples).reshape(n, samples)
            whole = np.hstack([_matrix(batch, 0, 2 + d), times])
            whole = whole[~np.isnan(whole).any(1)]  # here, as a filter before it would take the pairs' expressions twice
            yield pa.RecordBatch.from_arrays([pa.array([whole[i : i + most].tobytes() for i in range(0, len(whole), most)], pa.binary())], names=["pairs"])

    ready = pairs.select("first", "pair_weight", *features, members.alias("m"))
    return stage(ready.mapInArrow(run, "pairs binary"), "packed-pairs")


def sums(packs: DataFrame, weights: list[list[float]], samples: int) -> dict[int, tuple[float, list[float], list[float]]]:
    """For each model with pairs: their weight, and first and second derivatives of the logistic loss for each feature. Model m learns from sample ``m % samples``.

    A slice of pairs meets all models as matrices in the task that reads it and is summed there, so what is shuffled is one row for each model and task.
    """
    w = np.array(weights, dtype=float)
    models, d = w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, g, h, met = np.zeros(samples), np.zeros((models, d)), np.zeros((models, d)), np.zeros(samples, dtype=bool)
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, 2 + d + samples)
            for low in range(0, len(every), SLICE):
                part = every[low : low + SLICE]
                x, times = np.ascontiguousarray(part[:, 2 : 2 + d]), part[:, 2 + d :]
                pulls = times * part[:, 1:2]
                with np.errstate(over="ignore"):
                    won = 1 / (1 + np.exp(-(x @ w.T)))
                slope = won - part[:, :1]
                each = np.tile(pulls, (1, models // samples))
                n, met = n + pulls.sum(0), met | (times > 0).any(0)
                g += (each * slope).T @ x
                h += (each * won * (1 - won)).T @ (x * x)
        kept = [m for m in range(models) if met[m % samples]]
        if kept:
            columns = [pa.array(kept, pa.int32()), pa.array([n[m % samples] for m in kept], pa.float64()), *[pa.array([v[m].tolist() for m in kept], pa.list_(pa.float64())) for v in (g, h)]]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "n", "g", "h"])

    found = packs.mapInArrow(run, "model int, n double, g array<double>, h array<double>")
    out = found.groupBy("model").agg(F.sum("n").alias("n"), *[F.array(*[F.sum(F.col(c)[i]) for i in range(d)]).alias(c) for c in ("g", "h")])
    return {r["model"]: (r["n"], r["g"], r["h"]) for r in out.collect()}  # one row for each model


def moved(weights: list[float], found: tuple[float, list[float], list[float]], setting: dict[str, float], round_no: int) -> list[float]:
    """Weights after one second-order step of each by itself, clipped to 1."""
    n, first, second = found
    if n <= 0:
        return weights
    share, level = setting["step"] * setting["decay"] ** round_no, sum(second) / n / len(second)
    out = []
    for w, g, h in zip(weights, first, second):
        move = share * (g / n + setting["regular"] * w) / (h / n + 0.1 * level + setting["regular"])
        out.append(w - max(-1.0, min(1.0, move)))
    return out


def stepped(packs: DataFrame, weights: list[list[float]], settings: list[dict[str, float]], rounds: int, samples: int, done: int = 0) -> list[list[float]]:
    """Weights of each setting's ranker after ``rounds`` steps more on packed pairs; ``done`` went before, by which steps have decayed. A model without pairs stays as it was.
    On the driver are models x features numbers, nothing that grows with pairs."""
    for i in range(rounds):
        found = sums(packs, weights, samples)
        weights = [moved(w, found[m], settings[m], done + i) if m in found else w for m, w in enumerate(weights)]
    return weights


def fit_many(pairs: DataFrame, features: list[str], members: Column, settings: list[dict[str, float]], rounds: int, start: list[list[float]] | None = None, done: int = 0) -> list[list[float]]:
    """Weights of one linear ranker for each setting after ``rounds`` steps on preference pairs, which are packed and staged.

    members: an array of (model, times) for a pair, the models that learn from it and how often each counts it. A model without pairs stays as it was (zeros without ``start``).
    """
    packs = packed(pairs, features, members, len(settings))
    weights = stepped(packs, [list(w) for w in start] if start else [[0.0] * len(features) for _ in settings], settings, rounds, len(settings), done)
    unstage(packs)
    return weights


def _each(models: int) -> Column:
    return F.sequence(F.lit(0), F.lit(models - 1))


def _member(model: Column, times: Column) -> Column:
    return F.struct(model.cast("int").alias("model"), times.cast("double").alias("times"))


def firsts(judged: DataFrame, features: list[str], weights: list[list[float]], folds: int, k: int, used: list[list[bool]] | None = None) -> DataFrame:
    """(cve_id, week, label, model, score) of the rows that may be among a group's first ``k`` under the models of its fold (model m is of fold ``m % folds``): of each run of a
    group's rows in a batch those that come first, by score and key. The sums are in the order of the features, as in a plain expression, so equal rows have equal scores.
    ``used`` says which features a model looks at (all)."""
    w, d = np.array(weights, dtype=float), len(features)
    looks = np.ones(w.shape, dtype=bool) if used is None else np.array(used, dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = pc.fill_null(batch.column(1).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            by_key = np.lexsort((pc.rank(batch.column(0), tiebreaker="first").to_numpy(), code))
            cuts = np.flatnonzero(np.diff(code[by_key], prepend=-2))
            x = _matrix(batch, 4, d)
            for begin, end in zip(cuts, [*cuts[1:], len(by_key)]):
                at = by_key[begin:end]  # one group, by key
                fold = batch.column(3)[int(at[0])].as_py()
                models = np.arange(fold, len(w), folds)
                score = np.zeros((len(at), len(models)))
                for i in range(d):
                    score += np.where(looks[models, i], x[at, i][:, None] * w[models, i], 0.0)
                best = np.argsort(np.where(np.isnan(score), -np.inf, -score), axis=0, kind="stable")[:k]  # NaN first, as Spark sorts
                which = pa.array(at[best].ravel())
                columns = [batch.column(i).take(which) for i in range(3)]
                columns += [pa.array(np.broadcast_to(models.astype(np.int32), best.shape).ravel()), pa.array(np.take_along_axis(score, best, 0).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["cve_id", "week", "label", "model", "score"])

    ready = judged.select("cve_id", F.col("group").alias("week"), "label", "_fold", *features)
    kind = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    return ready.mapInArrow(run, f"cve_id {kind['cve_id']}, week {kind['week']}, label {kind['label']}, model int, score double")


def grid(rows: DataFrame, features: list[str], options: dict[str, list[float]], folds: int = 3, rounds: int = 12, every: int = 4, k: int = 20, per_row: int = 4) -> DataFrame:
    """(params, rounds, ndcg) of every combination of ``options`` (step, regular, decay; others as in PLAIN), best first: the mean over folds of the held-out NDCG at k, at the best of the rounds that were looked at.

    Folds are whole groups by hash. All combinations and folds are fitted together on pairs that are packed once; ndcg is looked at after every ``every`` rounds and after the last. Ties go to fewer rounds, then to params.
    An empty table gives 0 for each combination.
    """
    if unknown := options.keys() - PLAIN.keys():
        raise ValueError(f"no such options: {sorted(unknown)}")
    combos = [PLAIN | dict(zip(options, values)) for values in itertools.product(*options.values())]
    settings = [c for c in combos for _ in range(folds)]
    dealt = rows.withColumn("_fold", hash_bucket("group", folds))
    # rows of a group lie together, so that a batch holds many rows of few groups and can leave out those that are far from a group's first
    held = stage(dealt.repartitionByRange("group", F.md5(F.col("cve_id").cast("string"))).sortWithinPartitions("group"), "grid-rows")
    learns = F.filter(_each(folds), lambda f: f != F.coalesce("_fold", F.lit(-1)))
    pairs = preference_pairs(held, features, per_row).withColumn("_fold", hash_bucket("group", folds))
    packs = packed(pairs, features, F.transform(learns, lambda f: _member(f, F.lit(1.0))), folds)
    judged = held.where("_fold IS NOT NULL")
    labels = stage(judged.groupBy("_fold", "group", "label").agg(F.count(F.lit(1)).alias("c")), "grid-labels")
    every_model = labels.withColumn("_combo", F.explode(_each(len(combos)))).select((F.col("_combo") * folds + F.col("_fold")).alias("model"), F.col("group").alias("week"), "label", "c")
    weights, done, best = [[0.0] * len(features) for _ in settings], 0, {}
    while done < rounds:
        now = min(every, rounds - done)
        weights = stepped(packs, weights, settings, now, folds, done)
        done += now
        value = {r["model"]: r[f"ndcg_{k}"] or 0.0 for r in macro(firsts(judged, features, weights, folds, k), "week", [k], labels=every_model).collect()}  # one row for each model
        for c in range(len(combos)):
            mean = sum(value.get(c * folds + f, 0.0) for f in range(folds)) / folds
            if c not in best or mean > best[c][1]:
                best[c] = (done, mean)
    unstage(held), unstage(packs), unstage(labels)
    out = [(", ".join(f"{name}={combos[c][name]:g}" for name in options), *best[c]) for c in best]
    return rows.sparkSession.createDataFrame(out, "params string, rounds int, ndcg double").orderBy(F.desc("ndcg"), "rounds", "params")


def ensemble(train: DataFrame, test: DataFrame, features: list[str], replicas: int = 10, rounds: int = 12, per_row: int = 4, setting: dict[str, float] | None = None) -> DataFrame:
    """(cve_id, mean, deviation) of each row of test under rankers fitted on bootstrap draws of whole groups.

    A group's draws come from a hash of group and replica, so they need no join; a pair counts as often as its group is drawn. A row of test is scored where it is read.
    """
    drawn = F.transform(_each(replicas), lambda r: _member(r, draws(F.concat_ws("#", F.col("group"), r))))
    members = F.filter(drawn, lambda m: m["times"] > 0)
    weights = fit_many(preference_pairs(train, features, per_row), features, members, [setting or PLAIN] * replicas, rounds)
    w = np.array(weights, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, score = _matrix(batch, 1, len(features)), np.zeros((batch.num_rows, replicas))
            for i in range(len(features)):
                score += x[:, i : i + 1] * w[:, i][None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score.mean(1)), pa.array(score.std(1))], names=["cve_id", "mean", "deviation"])

    ready = test.select("cve_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    return ready.mapInArrow(run, f"cve_id {ready.schema['cve_id'].dataType.simpleString()}, mean double, deviation double")


def importance_runs(rows: DataFrame, features: list[str], shares: tuple[float, ...], seeds: tuple[str, ...], rounds: int = 12, per_row: int = 4, setting: dict[str, float] | None = None) -> DataFrame:
    """(run, feature, importance): mean absolute contribution of each feature over the rows of a sample, under a ranker fitted on it, for each size and seed; samples are whole groups by hash.

    A run is named ``share/seed``. A sample without rows has importances of 0.
    """
    runs = [(share, seed) for share in shares for seed in seeds]
    limits = {seed: [(int(share * 1_000_000), i) for i, (share, other) in enumerate(runs) if other == seed] for seed in seeds}

    def inside(seed: str) -> Column:  # as the one item of an array, the hash is taken once for all sizes
        taken = lambda u: F.array_compact(F.array(*[F.when(u < limit, F.lit(i)) for limit, i in limits[seed]]))
        return F.transform(F.array(hash_bucket("group", 1_000_000, seed)), taken)[0]

    chosen = F.concat(*[inside(seed) for seed in limits])
    held = stage(rows.withColumn("_runs", chosen), "runs-rows")
    members = F.transform(chosen, lambda m: _member(m, F.lit(1.0)))
    weights = fit_many(preference_pairs(held, features, per_row), features, members, [setting or PLAIN] * len(runs), rounds)
    d = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, known = np.zeros((len(runs), d)), np.zeros((len(runs), d))
        for batch in batches:
            x, listed = _matrix(batch, 0, d), batch.column(d)
            among = np.zeros((len(x), len(runs)))
            among[np.repeat(np.arange(len(x)), np.diff(listed.offsets.to_numpy())), listed.flatten().to_numpy(zero_copy_only=False)] = 1
            known += among.T @ ~np.isnan(x)
            sizes += among.T @ np.nan_to_num(np.abs(x), nan=0.0, posinf=np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(runs), dtype=np.int32)), pa.array(list(sizes)), pa.array(list(known))], names=["model", "s", "n"])

    summed = held.select(*features, "_runs").mapInArrow(run, "model int, s array<double>, n array<double>").groupBy("model")
    # a contribution is a value times its weight, so that means of sizes are enough: a row for each run and task
    totals = summed.agg(*[F.array(*[F.sum(F.col(c)[i]) for i in range(d)]).alias(c) for c in ("s", "n")]).collect()
    means = {r["model"]: [abs(w) * s / n if n else 0.0 for w, s, n in zip(weights[r["model"]], r["s"], r["n"])] for r in totals}
    unstage(held)
    out = [(f"{share}/{seed}", c, float(means[m][i] or 0.0) if m in means else 0.0) for m, (share, seed) in enumerate(runs) for i, c in enumerate(features)]
    return rows.sparkSession.createDataFrame(out, "run string, feature string, importance double")
