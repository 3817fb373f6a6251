"""All queries outside the llm subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewake.plans import flow_queries, general, store_queries, text_queries

GROUPS = (general, store_queries, text_queries, flow_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for g in GROUPS for k, f in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for g in GROUPS for k, s in g.SQL.items()}
