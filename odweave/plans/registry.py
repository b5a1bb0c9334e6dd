"""All queries of the engine by name, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from odweave.plans import basic_queries, flow_queries, space_queries, system_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return basic_queries.QUERIES | flow_queries.QUERIES | system_queries.QUERIES | space_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return basic_queries.SQL | flow_queries.SQL | system_queries.SQL | space_queries.SQL
