"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans import aggregated, extras, files, graphs, joined, patches, scalars, scores, services, simulations, windowed

FLAGSHIP = "score_findings"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (scores, joined, aggregated, windowed, scalars, graphs, services, extras, files, simulations, patches):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
