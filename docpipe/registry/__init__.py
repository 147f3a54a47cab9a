"""Queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docpipe.fixtures import Inputs, with_views

Query = Callable[[Inputs], DataFrame]

_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL (None where SQL cannot say it)."""

    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query: {name}")
        _QUERIES[name] = (function, sql)
        return function

    return register


def _load() -> None:
    from docpipe.registry import (  # noqa: F401
        collections, conversion, credentials, files, jobs, limits, rendering, streams, tokens,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(function: Query):
        return lambda spark, sf_dir: function(Inputs(spark, sf_dir))

    return {name: bind(function) for name, (function, _) in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql, "duckdb") for name, (_, sql) in _QUERIES.items() if sql is not None}
