"""All named queries of the library over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import ingest, research, trading, upkeep, worklists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (research, trading, ingest, worklists, upkeep):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
