"""Registry of the engine's queries and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import answers, batch_metrics, curation, equality, extras, grading, rollouts, stateful, truthfulness

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (truthfulness, answers, rollouts, batch_metrics, curation, extras, grading, equality, stateful):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
