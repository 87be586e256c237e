"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import flows, learning, matching, profiles, records, retrieval, texts  # noqa: F401  they register their queries
from tessera.plans.base import QUERIES, SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_names(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
