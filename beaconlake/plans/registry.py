"""Registry of queries and of the DuckDB text that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def r6(column: str | Column, name: str | None = None) -> Column:
    """Floats rounded for comparison."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col.cast("double"), 6).alias(name or (column if isinstance(column, str) else "value"))


# DuckDB: readers of the flat mapped events, written against the a_* columns.
_INST = r"""COALESCE(NULLIF(p_instance_id, ''), CASE WHEN regexp_extract(event_id, '^(.+)-(\d+)$', 2) = CAST(sequence AS STRING)
 THEN regexp_extract(event_id, '^(.+)-(\d+)$', 1) END)"""
DUCK_STREAM = f"""CASE WHEN {_INST} IS NOT NULL THEN CAST(to_json(['stream-instance', p_name, p_node_id, {_INST}]) AS STRING)
 ELSE CAST(to_json(['stream-session', session_id, p_name, p_node_id]) AS STRING) END"""
DUCK_INSTANCE = _INST
DUCK_ERROR = """(event_type LIKE '%.failed' OR event_type LIKE '%.error' OR event_type IN ('retry.scheduled', 'recovery.action') OR event_type LIKE 'guard.%')"""
DUCK_CLASS = f"""CASE WHEN {DUCK_ERROR} THEN 'error' ELSE CASE split_part(event_type, '.', 1) WHEN 'session' THEN 'session' WHEN 'engine' THEN 'session'
 WHEN 'request' THEN 'request' WHEN 'inference' THEN 'inference' WHEN 'model' THEN 'inference' WHEN 'backend' THEN 'inference' WHEN 'context' THEN 'inference'
 WHEN 'agent' THEN 'agent' WHEN 'route' THEN 'agent' WHEN 'memory' THEN 'agent' WHEN 'tool' THEN 'tool' WHEN 'device' THEN 'resource' WHEN 'kv' THEN 'resource'
 WHEN 'scheduler' THEN 'resource' WHEN 'telemetry' THEN 'telemetry' WHEN 'recording' THEN 'telemetry' ELSE 'other' END END"""
