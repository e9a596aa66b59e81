"""Ranked answers for analysts: filter, score everything, take the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.features import record_features
from riskweave.operators.filters import one_row, select_records
from riskweave.operators.ranking import top
from riskweave.operators.scoring import WEIGHTED, weighted


def scored(df: DataFrame, reference: str) -> DataFrame:
    """Records with their weighted score, recency counted over the whole table."""
    return record_features(df, reference).withColumn("score", F.round(weighted(WEIGHTED), 9))


def recommendations(df: DataFrame, reference: str, k: int, **conditions) -> DataFrame:
    """The k best records that meet the conditions, with place and a short description. All are scored; none is left out beforehand."""
    best = top(select_records(scored(df.where("cvss IS NOT NULL"), reference), **conditions), [F.desc("score"), F.asc("cve_id")], k)
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.asc("cve_id")))  # of k rows
    return best.select(place.alias("place"), "cve_id", "score", "cvss", "kev_flag", "is_healthcare", F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("summary"))


def recent(df: DataFrame, now: str, days_back: int, k: int, min_cvss: float = 0.0) -> DataFrame:
    """The recommendations among the records published in the ``days_back`` days before ``now``."""
    start = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days_back))
    return recommendations(df.where(F.col("published").between(start, F.lit(now).cast("timestamp"))), now, k, min_cvss=min_cvss)


def healthcare_by_severity(df: DataFrame, k: int = 20) -> DataFrame:
    """The k most severe healthcare records, then by healthcare score, with a short description."""
    best = top(df.where("is_healthcare = 1"), [F.desc_nulls_last("cvss"), F.desc_nulls_last("healthcare_score"), F.asc("cve_id")], k)
    return best.select("cve_id", "published", "cvss", "epss_score", "healthcare_score", "chpl_flag", "kev_flag", F.substring("description", 1, 80).alias("summary"))


def certified_products(df: DataFrame, k: int = 20) -> DataFrame:
    """The k most severe records of certified products, then by exploit score, with a short description."""
    best = top(df.where("chpl_flag = 1"), [F.desc_nulls_last("cvss"), F.desc_nulls_last("epss_score"), F.asc("cve_id")], k)
    return best.select("cve_id", "published", "cvss", "epss_score", "healthcare_score", "kev_flag", F.substring("description", 1, 80).alias("summary"))


def top_records(df: DataFrame, reference: str, k: int, **conditions) -> DataFrame:
    """The same with the number of candidates on each row."""
    rows = select_records(scored(df, reference), **conditions)
    return top(rows, [F.desc("score"), F.asc("cve_id")], k).select("cve_id", "score", "cvss").join(one_row(rows, F.count(F.lit(1)).alias("candidates")))


def multi_signal(df: DataFrame, k: int) -> DataFrame:
    """Records by number of signals, then severity, with a priority."""
    n = F.col("kev_flag") + F.col("chpl_flag") + F.col("attack_flag")
    rows = df.where(n >= 1).withColumn("signals", n).withColumn("priority", F.when(n >= 3, "P1").when(n == 2, "P2").otherwise("P3"))
    return top(rows, [F.desc("signals"), F.desc_nulls_last("cvss"), F.asc("cve_id")], k).select("cve_id", "signals", "priority", "cvss")


def audit(tops: DataFrame) -> DataFrame:
    """One row on a list of first records: exploited, critical, health words, review priorities."""
    word = F.lower(F.coalesce("summary", F.lit(""))).rlike("patient|hospital|medical|health|clinical")
    review = F.when((F.col("kev_flag") == 1) | (F.col("cvss") >= 9), "HIGH").when((F.col("cvss") >= 7) | word, "MEDIUM").otherwise("LOW")
    return tops.withColumn("_r", review).agg(F.sum("kev_flag").alias("exploited"), F.count_if(F.col("cvss") >= 9).alias("critical"), F.count_if(word).alias("health_words"), *[F.count_if(F.col("_r") == x).alias(f"review_{x.lower()}") for x in ("HIGH", "MEDIUM", "LOW")])
