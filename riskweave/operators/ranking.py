"""Positions: within groups by windows, over whole tables without an unpartitioned window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import stage


def in_group(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with the position, from 1, of each row in the total order ``order`` (its last column must make it unique).

    Rows are dealt out by range and staged, so that numbers of partitions hold; each partition counts its rows, and the counts before it are added to
    positions within it. Only one count for each partition is broadcast.
    """
    dealt = df.repartitionByRange(*([partitions] if partitions else []), *order)
    kept = stage(dealt.withColumn("_gr_part", F.spark_partition_id()), "global-rank")
    counts = kept.groupBy("_gr_part").agg(F.count(F.lit(1)).alias("_gr_n"))
    before = F.sum("_gr_n").over(Window.orderBy("_gr_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("_gr_part", F.coalesce(before, F.lit(0)).alias("_gr_before")))
    place = F.row_number().over(Window.partitionBy("_gr_part").orderBy(*order))
    out = kept.withColumn("_gr_place", place).join(offsets, "_gr_part")
    return out.withColumn(name, (F.col("_gr_before") + F.col("_gr_place")).cast("bigint")).drop("_gr_part", "_gr_place", "_gr_before")


def sums_before(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each name -> column of ``sums``, the sum of the column over the rows of the group that come before the row; 0 for the first.

    Rows are dealt out by range of group and order, as in :func:`global_rank`, so a group's rows needn't meet in one task; sums of each group's ranges are added up.
    The order must be total within a group, and groups have no null.
    """
    kept = stage(df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_sb_part", F.spark_partition_id()), "sums-before")
    parts = kept.groupBy(*group, "_sb_part").agg(*[F.sum(c).alias(f"_sb_{n}") for n, c in sums.items()])
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_sb_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range that holds rows of a group: not above ranges plus groups
    offsets = parts.select(*[F.col(c).alias(f"_sb_{i}") for i, c in enumerate(group)], F.col("_sb_part").alias("_sb_in"), *[F.coalesce(F.sum(f"_sb_{n}").over(earlier), F.lit(0)).alias(f"_sb_{n}") for n in sums])
    within = Window.partitionBy(*group, "_sb_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    met = F.col("_sb_part") == F.col("_sb_in")
    for i, c in enumerate(group):
        met &= F.col(c) == F.col(f"_sb_{i}")
    return placed.join(offsets, met).select(*df.columns, *[(F.col(n) + F.col(f"_sb_{n}")).alias(n) for n in sums])


def average_rank(df: DataFrame, group: list[str], value: Column, name: str = "avg_rank") -> DataFrame:
    """Mean position of equal values, 1 for the largest."""
    ordered = Window.partitionBy(*group).orderBy(value.desc())
    ties = Window.partitionBy(*group, value)
    return df.withColumn(name, F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last in the order."""
    return in_group(df, key, order, "_n").where("_n = 1").drop("_n")


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): codes from 1 by sorted distinct value; the distinct values are ranked, not the rows."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return global_rank(values, [F.col(column).asc()], "code")


def best_then_fill(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The best row of each group, then the best of the other rows, k in all. The best are taken by a partial aggregation, the others by a bounded sort."""
    worst_first = F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("s"), F.col(key).alias("k"))
    best = df.groupBy(group).agg(F.min(worst_first).alias("_b")).orderBy("_b").limit(k).select(F.col("_b.k").alias("_best"))
    first = df.join(F.broadcast(best), F.col(key) == F.col("_best"), "left").withColumn("_first", F.col("_best").isNotNull())
    return first.orderBy(F.desc("_first"), F.desc_nulls_last(score), F.asc(key)).limit(k).drop("_best", "_first")
