"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanloom.plans import code, dashboards, dataflow, lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**dashboards.QUERIES, **dataflow.QUERIES, **code.QUERIES, **lists.QUERIES}
ORACLE_SQL: dict[str, str] = {**dashboards.ORACLE_SQL, **dataflow.ORACLE_SQL, **code.ORACLE_SQL, **lists.ORACLE_SQL}
