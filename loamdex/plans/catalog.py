"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamdex.plans import registry
from loamdex.plans import q_flow, q_graph, q_hygiene, q_maintain, q_search, q_status, q_text  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
