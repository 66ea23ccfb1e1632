"""The registered queries of the engine's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.plans.fixtures import Tables

FLAGSHIP = "retrieve_hybrid"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(tables)`` under its name, with SQL where it has an equivalent."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


# the modules below register their queries as they are imported
from lumenfold.plans import agent_queries, chat_queries, page_queries, retrieval_queries, service_queries, text_queries  # noqa: E402, F401
