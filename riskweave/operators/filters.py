"""Cleaning, filters, validation and schema-fit projections of record tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.expressions import flag, number
from riskweave.operators.quantiles import medians


def one_row(df: DataFrame, *aggregates) -> DataFrame:
    """A single row of aggregates, safe to broadcast to every row."""
    return F.broadcast(df.agg(*aggregates))


def clean(df: DataFrame, date_col: str = "published") -> DataFrame:
    """Missing severities become the global median, missing exploit scores 0; rows without a readable date go. Nothing is clipped or deduplicated."""
    dated = df.withColumn(date_col, F.col(date_col).try_cast("timestamp")).where(F.col(date_col).isNotNull()) if dict(df.dtypes)[date_col] == "string" else df.where(F.col(date_col).isNotNull())
    middle = F.lit(medians(df, {"cvss": F.col("cvss")})["cvss"]).cast("double")
    return dated.withColumn("cvss", F.coalesce("cvss", middle)).withColumn("epss_score", F.coalesce("epss_score", F.lit(0.0)))


def select_records(df: DataFrame, min_cvss: float | None = None, max_cvss: float | None = None, start: datetime | str | None = None, end: datetime | str | None = None, kev_only: bool = False, healthcare_only: bool = False) -> DataFrame:
    """All given conditions at once; one on a column that the table lacks is ignored."""
    have = set(df.columns)
    tests = [
        ("cvss", min_cvss is not None, lambda: F.col("cvss") >= min_cvss),
        ("cvss", max_cvss is not None, lambda: F.col("cvss") <= max_cvss),
        ("published", start is not None, lambda: F.col("published") >= F.lit(start).cast("timestamp")),
        ("published", end is not None, lambda: F.col("published") <= F.lit(end).cast("timestamp")),
        ("kev_flag", kev_only, lambda: F.col("kev_flag") == 1),
        ("is_healthcare", healthcare_only, lambda: F.col("is_healthcare") == 1),
    ]
    for column, asked, test in tests:
        if asked and column in have:
            df = df.where(test())
    return df


def by_ids(df: DataFrame, ids: DataFrame, key: str = "cve_id") -> DataFrame:
    """Rows whose key is in the id table, letter case aside."""
    wanted = ids.select(F.upper(F.col(key)).alias("_id")).distinct()
    return df.join(wanted, F.upper(df[key]) == wanted["_id"], "left_semi")


def violations(df: DataFrame) -> DataFrame:
    """df with the array ``violations``: names of the rules that a row breaks."""
    text = F.trim(F.coalesce("description", F.lit("")))
    holder = F.upper(text)
    rules = {
        "bad_id": ~F.coalesce(F.col("cve_id").rlike(r"^CVE-\d{4}-\d{4,}$"), F.lit(False)),
        "cvss_range": F.col("cvss").isNotNull() & ~F.col("cvss").between(0, 10),
        "epss_range": F.col("epss_score").isNotNull() & ~F.col("epss_score").between(0, 1),
        "label_range": F.col("label").isNotNull() & ~F.col("label").between(0, 5),
        "short_description": F.length(text) < 10,
        "placeholder": holder.startswith("** RESERVED **") | holder.startswith("** REJECT **") | holder.startswith("*** UNSUPPORTED WHEN"),
    }
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])))


def fit_columns(df: DataFrame, columns: list[str], key: str = "cve_id") -> DataFrame:
    """The key and exactly the given numeric columns: what is missing or no number becomes 0."""
    have = set(df.columns)
    return df.select(key, *[(number(c) if c in have else F.lit(0.0)).alias(c) for c in columns])


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def coercible(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, share): the share of present values that read as numbers."""
    parts = [F.avg(F.when(F.col(c).isNotNull(), flag(F.col(c).cast("string").try_cast("double").isNotNull()))).alias(c) for c in columns]
    return df.agg(*parts).unpivot([], columns, "column", "share")


def coerce_pair(train: DataFrame, other: DataFrame, column: str, least_share: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The column of both tables as numbers if over ``least_share`` of the first reads so, else as codes of its sorted values; unknown and missing ones 0."""
    share = coercible(train, [column]).first()["share"]
    if share is None or share > least_share:
        return tuple(df.withColumn(column, number(F.col(column).cast("string"))) for df in (train, other))
    from riskweave.operators.ranking import dense_codes

    codes = dense_codes(train.select(column), column)
    return tuple(df.join(codes, column, "left").withColumn(column, F.coalesce(F.col("code").cast("double"), F.lit(0.0))).drop("code") for df in (train, other))
