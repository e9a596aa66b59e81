"""Splits, folds and resampling. Random choices come from hashes of keys, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.expressions import hash_bucket
from riskweave.operators.filters import one_row
from riskweave.operators.ranking import global_rank, in_group


def by_date(df: DataFrame, cutoff: str, validation_weeks: int, when: str = "published") -> DataFrame:
    """split: test from the cutoff on, val in the weeks before it, else train."""
    at, day = F.lit(cutoff).cast("date"), F.to_date(when)
    return df.withColumn("split", F.when(day >= at, "test").when(day >= F.date_sub(at, 7 * validation_weeks), "val").otherwise("train"))


def by_share(df: DataFrame, train: float, val: float, when: str = "published", key: str = "cve_id") -> DataFrame:
    """split by position in time, ties by key: the first ``int(n * train)`` rows, then ``int(n * val)``, then the rest."""
    ranked = global_rank(df, [F.col(when).asc(), F.col(key).asc()], "_rank")
    n = one_row(df, F.count(F.lit(1)).alias("_rows"))
    first = F.floor(F.col("_rows") * F.lit(train))
    return ranked.join(n).withColumn("split", F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= first + F.floor(F.col("_rows") * F.lit(val)), "val").otherwise("test")).drop("_rank", "_rows")


def by_year(df: DataFrame, test_year: int, validation_weeks: int, when: str = "published") -> DataFrame:
    """split: the test year, the last weeks before its first day in the data's earlier years, the rest; later years are left out."""
    earlier = df.where(F.year(when) <= test_year)
    last = one_row(earlier.where(F.year(when) < test_year), F.max(F.to_date(when)).alias("_last"))
    return earlier.join(last, how="left").withColumn("split", F.when(F.year(when) == test_year, "test").when(F.to_date(when) > F.date_sub("_last", 7 * validation_weeks), "val").otherwise("train")).drop("_last")


def with_gap(df: DataFrame, train_end: str, days: int, when: str = "published") -> DataFrame:
    """split: train to the end date, test from ``days`` after it; rows between are left out."""
    end, day = F.lit(train_end).cast("date"), F.to_date(when)
    return df.where((day <= end) | (day >= F.date_add(end, days))).withColumn("split", F.when(day <= end, "train").otherwise("test"))


def by_cutoff(df: DataFrame, cutoff: str, val_share: float = 0.15, when: str = "published", key: str = "cve_id") -> DataFrame:
    """split: test after the cutoff; of the rest in time order, ties by key, the last ``int(n * val_share)`` rows, one at least, are val, the others train."""
    at = F.lit(cutoff).cast("timestamp")
    early = global_rank(df.where(F.col(when) <= at), [F.col(when).asc(), F.col(key).asc()], "_rank")
    n = one_row(df.where(F.col(when) <= at), F.count(F.lit(1)).alias("_rows"))
    val = F.greatest(F.lit(1), F.floor(F.col("_rows") * F.lit(val_share)))
    earlier = early.join(n).withColumn("split", F.when(F.col("_rank") > F.col("_rows") - val, "val").otherwise("train")).drop("_rank", "_rows")
    return earlier.unionByName(df.where(F.col(when) > at).withColumn("split", F.lit("test")))


def leakage(df: DataFrame, when: str = "published") -> DataFrame:
    """One row: last day of train, first of test, days of overlap, leaks."""
    day = F.to_date(when)
    out = df.agg(F.max(F.when(F.col("split") == "train", day)).alias("train_end"), F.min(F.when(F.col("split") == "test", day)).alias("test_start"))
    overlap = F.greatest(F.lit(0), F.datediff("train_end", "test_start") + 1)
    return out.select("train_end", "test_start", overlap.cast("bigint").alias("overlap_days"), (F.col("train_end") >= F.col("test_start")).alias("leaks"))


def random_split(df: DataFrame, test_share: float, key: str | Column = "cve_id", salt: str = "") -> DataFrame:
    """split by hash of the key: all rows of a key fall on one side."""
    return df.withColumn("split", F.when(hash_bucket(key, 10_000, salt) < int(test_share * 10_000), "test").otherwise("train"))


def stratified_folds(df: DataFrame, k: int, label: str, key: str = "cve_id") -> DataFrame:
    """fold: within each label, rows in hash order take folds in turn. The order within a label is a range order over (label, hash), so no label meets in one task."""
    order = [F.col(label).asc_nulls_first(), F.md5(F.col(key).cast("string")).asc(), F.col(key).asc()]
    return global_rank(df, order, "_rank").withColumn("fold", ((F.col("_rank") - 1) % k).cast("bigint")).drop("_rank")


def random_folds(df: DataFrame, k: int, key: str = "cve_id") -> DataFrame:
    return df.withColumn("fold", hash_bucket(key, k).cast("bigint"))


def group_folds(df: DataFrame, k: int, group: str) -> DataFrame:
    """fold: groups by falling size take folds forth and back, so folds are near in size and no group is split."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    place = global_rank(sizes, [F.desc("_n"), F.col(group).asc()], "_place").withColumn("_z", (F.col("_place") - 1) % (2 * k))
    folds = place.select(group, F.when(F.col("_z") < k, F.col("_z")).otherwise(2 * k - 1 - F.col("_z")).cast("bigint").alias("fold"))
    return df.join(folds, group)


def expanding_folds(df: DataFrame, k: int, when: str = "published", key: str = "cve_id") -> DataFrame:
    """(fold, role, ...) of k expanding windows: fold i trains on the first i of k + 1 blocks of time order and tests on the next."""
    ranked = global_rank(df, [F.col(when).asc(), F.col(key).asc()], "_rank")
    n = one_row(df, F.count(F.lit(1)).alias("_rows"))
    block = F.least(F.lit(k), F.floor((F.col("_rank") - 1) * (k + 1) / F.col("_rows")))
    blocked = ranked.join(n).withColumn("_block", block)
    folds = blocked.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).where(F.col("_block") <= F.col("fold"))
    return folds.withColumn("role", F.when(F.col("_block") == F.col("fold"), "test").otherwise("train")).withColumn("fold", F.col("fold").cast("bigint")).drop("_rank", "_rows", "_block")


def draws(key: Column) -> Column:
    """A Poisson(1) number of draws, 8 at most, from a hash of the key."""
    steps, total, p = [], 0.0, 0.36787944117144233
    for n in range(8):
        total += p
        steps.append((total, n))
        p /= n + 1

    def placed(u: Column) -> Column:
        times = F.when(u < steps[0][0], 0)
        for limit, n in steps[1:]:
            times = times.when(u < limit, n)
        return times.otherwise(8).cast("bigint")

    # as the one item of an array, the hash is taken once, not for each step
    return F.transform(F.array(hash_bucket(key, 1_000_000) / F.lit(1_000_000.0)), placed)[0]


def bootstrap(df: DataFrame, replicas: int, key: str = "cve_id") -> DataFrame:
    """(replica, times, ...): each row's Poisson(1) number of draws in each replica, from a hash; rows with none are left out."""
    every = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return every.withColumn("times", draws(F.concat_ws("#", F.col(key), F.col("replica")))).where("times > 0")


def hash_sample(df: DataFrame, share: float, key: str = "cve_id", salt: str = "sample") -> DataFrame:
    return df.where(hash_bucket(key, 1_000_000, salt) < int(share * 1_000_000))
