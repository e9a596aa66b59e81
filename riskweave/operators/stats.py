"""Paired tests and effect sizes between models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskweave.functions.tails import normal_two_sided, signed_rank_two_sided, student_two_sided
from riskweave.operators.ranking import average_rank, sums_before

#: Differences up to which the signed-rank sum's own distribution is counted out, if no two are of one size.
EXACT = 50


def _tail(function: Callable[..., float], *columns: str) -> Column:
    """A tail of each row of a summary that has a row for each model pair; null where a value is missing."""

    def tail(*values: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None or x != x for x in row) else function(*row) for row in zip(*values)], dtype="float64")

    return F.pandas_udf(tail, DoubleType())(*columns)


def _signed_rank(w: float, n: float, ties: float, z: float) -> float:
    return signed_rank_two_sided(w, int(n)) if n <= EXACT and ties == 0 else normal_two_sided(z)


def wilcoxon(pairs: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """(by, n, w, p) of pairs (a, b): signed ranks of the differences other than 0. The tail is exact up to EXACT differences of different sizes, and the normal one with tie correction beyond; p is 1 under ``least`` differences."""
    d = pairs.withColumn("_d", F.round(F.col("a") - F.col("b"), 12)).where("_d <> 0")
    # mean ranks of |d| from counts of its distinct values
    sizes = d.groupBy(*by, F.abs("_d").alias("_m")).agg(F.count(F.lit(1)).alias("_c"), F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).alias("_plus"))
    ranked = sums_before(sizes, by, [F.asc("_m")], {"_b": "_c"}).withColumn("_r", F.col("_b") + (F.col("_c") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_plus") * F.col("_r")).alias("plus"), F.sum((F.col("_c") - F.col("_plus")) * F.col("_r")).alias("minus"), F.sum(F.pow("_c", F.lit(3)) - F.col("_c")).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.least("plus", "minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return sums.withColumns({"z": z, "w": F.least("plus", "minus")}).select(*by, "n", "w", F.when(F.col("n") < least, 1.0).otherwise(_tail(_signed_rank, "w", "n", "ties", "z")).alias("p"))


def paired_t(pairs: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """(by, n, t, p) by Student's t with n - 1 degrees of freedom; p is 1 under ``least`` pairs or without spread."""
    d = F.col("a") - F.col("b")
    s = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"))
    t = F.try_divide(F.col("_m"), F.col("_s") / F.sqrt("n"))
    tested = s.withColumns({"t": t, "_df": F.col("n") - 1})
    return tested.select(*by, "n", "t", F.when((F.col("n") < least) | F.col("t").isNull(), 1.0).otherwise(_tail(student_two_sided, "t", "_df")).alias("p"))


def bonferroni(tests: DataFrame, alpha: float, p: str = "p") -> DataFrame:
    m = F.count(F.lit(1)).over(Window.partitionBy())  # over the tests
    return tests.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * m)).withColumn("reject_bonferroni", F.col("p_bonferroni") < alpha)


def holm(tests: DataFrame, alpha: float, key: str, p: str = "p") -> DataFrame:
    """Step-down: adjusted values never fall, and rejection ends with the first test that is kept."""
    order = Window.orderBy(p, key)
    i, m = F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy())
    raw = tests.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * (m - i + 1)))
    adjusted = F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return raw.withColumn("p_holm", adjusted).withColumn("reject_holm", F.col("p_holm") < alpha).drop("_raw")


def cliffs_delta(values: DataFrame, side: Column, value: str) -> DataFrame:
    """One row: delta of the rows where ``side`` holds against the others, by rank sums over counts of values that are put in order by range, not over pairs."""
    counts = values.groupBy(value).agg(F.count_if(side).alias("_a"), F.count(F.lit(1)).alias("_c"))
    s = sums_before(counts, [], [F.asc(value)], {"_b": "_c"}).withColumn("_r", F.col("_b") + (F.col("_c") + 1) / 2).agg(F.sum(F.col("_a") * F.col("_r")).alias("r"), F.sum("_a").cast("double").alias("m"), (F.sum("_c") - F.sum("_a")).cast("double").alias("n"))
    return s.select(F.round(2 * (F.col("r") - F.col("m") * (F.col("m") + 1) / 2) / (F.col("m") * F.col("n")) - 1, 6).alias("delta"))


def stability(runs: DataFrame, run: str, feature: str, importance: str, k: int = 10) -> DataFrame:
    """(run_a, run_b, rho, overlap_pct) of each two runs' importances: correlation of mean ranks, and shared features among the first k."""
    ranked = average_rank(runs, [run], F.col(importance))
    place = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(importance), feature))
    ranked = ranked.withColumn("_top", place <= k)
    a = ranked.select(F.col(run).alias("run_a"), feature, F.col("avg_rank").alias("_ra"), F.col("_top").alias("_ta"))
    b = ranked.select(F.col(run).alias("run_b"), feature, F.col("avg_rank").alias("_rb"), F.col("_top").alias("_tb"))
    both = a.join(b, feature).where("run_a < run_b")
    return both.groupBy("run_a", "run_b").agg(F.round(F.corr("_ra", "_rb"), 6).alias("rho"), F.round(100.0 * F.count_if(F.col("_ta") & F.col("_tb")) / k, 4).alias("overlap_pct"))


def all_pairs(pairs: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """(by, n, w, p, p_bonferroni, p_holm, reject_bonferroni, reject_holm) of the signed-rank test of each two models, corrected for their number."""
    tests = wilcoxon(pairs, by).withColumn("_name", F.concat_ws("#", *by))
    return holm(bonferroni(tests, alpha), alpha, "_name").drop("_name")


def stable(pairs: DataFrame, least_rho: float = 0.9, least_overlap: float = 80.0) -> DataFrame:
    """One row of the table of :func:`stability`: its least correlation and overlap, and whether both reach their bounds."""
    out = pairs.agg(F.min("rho").alias("least_rho"), F.min("overlap_pct").alias("least_overlap"))
    return out.withColumn("stable", F.coalesce((F.col("least_rho") >= least_rho) & (F.col("least_overlap") >= least_overlap), F.lit(False)))


def interval(drawn: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: mean, low and high end of the weighted means of bootstrap draws (replica, times, value). A row for each replica is put in order."""
    each = drawn.groupBy("replica").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("_v"))
    return each.agg(F.avg("_v").alias("mean"), F.percentile("_v", F.lit(low)).alias("low"), F.percentile("_v", F.lit(high)).alias("high"))
