"""All queries of the core, by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.plans import core_oracles, core_problems, reference_oracles, reference_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**core_problems.QUERIES, **reference_queries.QUERIES}
ORACLES: dict[str, str] = {**core_oracles.ORACLES, **reference_oracles.ORACLES}
