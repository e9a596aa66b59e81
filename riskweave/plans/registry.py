"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.operators import analyst
from riskweave.plans import analytics, further, landing, relational, texts, upkeep  # noqa: F401  registration
from riskweave.plans.base import QUERIES, REFERENCE, SQL, Query
from riskweave.sources import projection


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty records to look at first."""
    return analyst.recommendations(projection.records(spark, sf_dir), REFERENCE, 50)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
