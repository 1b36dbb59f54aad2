"""Named queries and, beside each, the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def six_sql(x: str) -> str:
    """Six significant digits, exact ties away from zero (printf alone would send them to the even digit)."""
    m = f"printf('%.60e', abs({x}))"
    up = f"cast((cast(replace(substr({m}, 1, 7), '.', '') AS bigint) + 1) || 'e' || (cast(split_part({m}, 'e', 2) AS int) - 5) AS double)"
    return f"CASE WHEN regexp_matches({m}, '^[0-9][.][0-9]{{5}}50*e') THEN sign({x}) * {up} ELSE cast(printf('%.5e', {x}) AS double) END"
