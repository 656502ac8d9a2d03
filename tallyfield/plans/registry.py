"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfield.plans import backtest, entities, history, lookups, models, outlook, payloads, prices, profiling, reconcile, refinement, sources, state, summaries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (history, backtest, prices, models, reconcile, profiling, lookups, refinement, payloads, entities, state, summaries, outlook, sources):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.SQL

flagship = backtest.flagship
