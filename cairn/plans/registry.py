"""The table of registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


# SQL fragments
def r1(x: str) -> str:
    return f"floor(({x}) * 10e0 + 0.5e0) / 10e0"


def r3(x: str) -> str:
    return f"floor(({x}) * 1000e0 + 0.5e0) / 1000e0"


def half(x: str) -> str:
    return f"cast(floor(({x}) + 0.5e0) as bigint)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"case when {lat1} is not null and {lat2} is not null then 2e0 * 3958.8e0 * asin(least(1e0, sqrt(power(sin(radians({lat2} - {lat1}) / 2e0), 2) "
        f"+ cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2e0), 2)))) end"
    )
