"""Registry of the named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``ctes`` are ``name AS (...)`` texts put in front of ``sql``."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = ("WITH RECURSIVE " + ctes[0] + "".join(ctes[1:]) if ctes else "") + "\n" + sql
        return fn

    return register
