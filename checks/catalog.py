"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def with_tables(body: str, **ctes: str) -> str:
    """SQL with named sub-queries before the body."""
    parts = ",\n".join(f"{name} as ({sql.strip()})" for name, sql in ctes.items())
    return f"with {parts}\n{body}"


def plain(expression: str) -> str:
    """SQL text of a number without trailing zeros."""
    return f"rtrim(rtrim(cast(cast({expression} as decimal(28,8)) as varchar), '0'), '.')"
