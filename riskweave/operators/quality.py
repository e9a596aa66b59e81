"""Data-quality reports: issues of each feed, consistency rules, schema contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.expressions import flag


def _long(row: DataFrame, feed: str, severities: dict[str, str]) -> DataFrame:
    names = list(severities)
    long = row.unpivot([], names, "issue", "n")
    level = F.element_at(F.create_map(*[F.lit(x) for pair in severities.items() for x in pair]), F.col("issue"))
    return long.select(F.lit(feed).alias("feed"), level.alias("severity"), "issue", F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("n"))


def record_issues(df: DataFrame, today: str) -> DataFrame:
    """(feed, severity, issue, n) of the main table, from one pass and one count of repeated keys."""
    text = F.coalesce("description", F.lit(""))
    day = F.to_date("published")
    counted = df.groupBy("cve_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = counted.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_id"))
    row = df.agg(
        F.count_if(~F.coalesce(F.col("cve_id").rlike(r"^CVE-\d{4}-\d{4,}$"), F.lit(False))).alias("bad_id"),
        F.count_if(F.col("cvss").isNull()).alias("missing_cvss"),
        F.count_if(~F.col("cvss").between(0, 10)).alias("bad_cvss"),
        F.count_if(day.isNull()).alias("missing_date"),
        F.count_if(day > F.lit(today).cast("date")).alias("future_date"),
        F.count_if(day < F.add_months(F.lit(today).cast("date"), -24)).alias("older_than_two_years"),
        F.count_if(F.trim(text) == "").alias("empty_description"),
        F.count_if((F.trim(text) != "") & (F.length(text) < 50)).alias("short_description"),
    )
    levels = {"repeated_id": "error", "bad_id": "error", "missing_cvss": "warning", "bad_cvss": "error", "missing_date": "error", "future_date": "error", "older_than_two_years": "info", "empty_description": "warning", "short_description": "info"}
    return _long(row.join(F.broadcast(repeated)), "records", levels)


def list_issues(df: DataFrame, feed: str, key: str, pattern: str | None = None) -> DataFrame:
    """(feed, severity, issue, n) of a side feed: repeated, missing and badly formed keys, distinct keys."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    row = counts.agg(
        F.sum(F.when(F.col(key).isNotNull(), F.col("_n") - 1).otherwise(0)).alias("repeated"),
        F.sum(F.when(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", F.col("_n")).otherwise(0)).alias("missing"),
        F.sum(F.when(F.col(key).isNotNull() & ~F.col(key).cast("string").rlike(pattern or ".*"), F.col("_n")).otherwise(0)).alias("format"),
        F.count_if(F.col(key).isNotNull()).alias("distinct"),
    )
    return _long(row, feed, {"repeated": "warning", "missing": "error", "format": "error", "distinct": "info"})


def combined(*reports: DataFrame) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def contract(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(table, column) that are required and missing; an empty column stands for the whole table. Looks at schemas alone."""
    return [(t, "") for t in required if t not in tables] + [(t, c) for t, columns in required.items() if t in tables for c in columns if c not in tables[t].columns]


def consistency(df: DataFrame) -> DataFrame:
    """(rule, broken, share): rules between enrichment columns."""
    rules = {
        "score_without_date": (F.col("epss_score") > 0) & F.col("epss_date").isNull(),
        "score_range": ~F.col("epss_score").between(0, 1) | ~F.col("epss_percentile").between(0, 1),
        "missing_healthcare_score": F.col("healthcare_score").isNull(),
        "flag_against_score": (F.col("is_healthcare") == 1) != (F.col("healthcare_score") > 0.3),
        "curated_without_severity": (F.col("is_curated") == 1) & F.col("curated_severity").isNull(),
        "technique_without_flag": (F.col("attack_technique_count") > 0) != (F.col("attack_flag") == 1),
    }
    row = df.agg(*[F.sum(flag(F.coalesce(t, F.lit(False)))).alias(n) for n, t in rules.items()], F.count(F.lit(1)).alias("_n"))
    return row.unpivot(["_n"], list(rules), "rule", "broken").select("rule", F.col("broken").cast("bigint").alias("broken"), F.round(F.col("broken") / F.col("_n"), 6).alias("share"))


def health(df: DataFrame, least_rows: int) -> DataFrame:
    """One row: counts, last day, status."""
    return df.agg(F.count(F.lit(1)).alias("records"), F.sum("kev_flag").alias("exploited"), F.sum("is_healthcare").alias("healthcare"), F.max(F.to_date("published")).alias("last_day")).withColumn("status", F.when(F.col("records") >= least_rows, "healthy").otherwise("degraded"))


def column_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nonzero, total) of score columns."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.count_if(F.col("value") != 0).alias("nonzero"), F.round(F.sum("value"), 4).alias("total"))
