"""Registry of the reference operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import corpus, graph, merge, models, questions, registry, retrieval, reviews, sources  # noqa: F401  the plans register themselves

FLAGSHIP = "I5_hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
