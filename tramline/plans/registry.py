"""Registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.plans.derived import Derived, sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(tables: str = "", body: str | None = None) -> Callable:
    """Registers a function of the derived timetable; body is its SQL over these derived tables."""

    def add(build: Callable[[Derived], DataFrame]) -> Callable[[Derived], DataFrame]:
        name = build.__name__
        if name in _QUERIES:
            raise ValueError(f"two queries {name}")
        _QUERIES[name] = lambda spark, sf_dir: build(Derived(spark, sf_dir))
        if body is not None:
            _SQL[name] = sql(tables, body)
        return build

    return add


def _load() -> None:
    from tramline.plans import etl, fare_queries, journey_queries, lookups, realtime_queries, request_queries, scalars  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
