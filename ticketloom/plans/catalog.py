"""Every named query of the engine with the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketloom.plans import assist, evaluation, ingestion, reports, retrieval, rules, serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for part in (retrieval, evaluation, ingestion, rules, serving, assist, reports):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
