"""Registry that pairs each table-level query with its SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.plans.bindings import Bindings, sql_with_bindings

_QUERIES: dict[str, Callable[[Bindings], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(bindings)``; ``sql`` is the same question over the bound tables."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql_with_bindings(sql)
        return fn

    return register


def sql_of(name: str) -> str:
    """Whole statement of a query that is registered already, to build another on."""
    return _SQL[name]


def _load() -> None:
    from evigraph.plans import (  # noqa: F401
        discovery_queries, evidence_queries, exploration_queries, graph_queries,
        ingest_queries, linkage_queries, merge_queries, model_queries, quality_queries,
        review_queries, thread_queries,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bound(fn):
        return lambda spark, sf_dir: fn(Bindings(spark, sf_dir))

    return {name: bound(fn) for name, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
