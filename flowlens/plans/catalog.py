"""Every query of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import activity_queries, destination_queries, flow_queries, machine_queries, mining_queries, naming_queries, ordered_queries, owner_queries, periodic_queries

_PARTS = (flow_queries, periodic_queries, activity_queries, machine_queries, destination_queries, naming_queries, mining_queries, ordered_queries, owner_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
