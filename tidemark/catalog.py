"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import aggregates, clusters, dedup, fold, landed, lifecycle, outlines, pages, ranking, relational, scalars, search, texts
from tidemark.plans import commits
from tidemark.plans.run import both
from tidemark.sources import landed_source
from tidemark.streaming import ingest, queue, refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (relational, aggregates, texts, scalars, dedup, clusters, fold, ranking, search, lifecycle, pages, landed, ingest, queue, landed_source, refresh, commits, outlines):
    _queries, _sql = both(getattr(_module, "QUERIES", {}))
    QUERIES |= _queries | getattr(_module, "SPARK_QUERIES", {})
    ORACLE_SQL |= _sql | getattr(_module, "ORACLES", {})
