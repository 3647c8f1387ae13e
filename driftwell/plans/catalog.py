"""All registered queries of the library proper and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwell.plans import drift_queries, model_queries, record_queries, tensor_queries

_PARTS = (drift_queries, model_queries, record_queries, tensor_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for part in _PARTS for k, s in part.ORACLE_SQL.items()}
