"""All queries of the engine by name, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkquill.plans import oracles
from sparkquill.plans import queries as q


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in q.ALL}


def oracle_sql() -> dict[str, str]:
    return oracles.all_of()
