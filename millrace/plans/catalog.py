"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import history, relational, runs, scalars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "e3_history"

for _module in (history, scalars, relational, runs):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
