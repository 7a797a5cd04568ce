"""Small hand-made recordings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.session import cut_lineage
from beaconlake.sources.ndjson import parse_lines


def event(ms: int, event_type: str, attributes: dict | None = None, **fields) -> dict:
    return {
        "schema": "beacon.telemetry.event/1", "event_id": f"e_{event_type}_{ms}", "sequence": ms, "event_type": event_type, "wall_time": "2024-01-01T00:00:00.000Z",
        "mono_ns": ms * 1_000_000, "session_id": "s1", "producer": {"name": "p", "version": "1", "node_id": "n"}, "attributes": attributes or {}, **fields,
    }


def lines(spark: SparkSession, values: list[str], recording: str = "rec") -> DataFrame:
    rows = [(recording, "mem", i + 1, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "recording_id string, path string, line bigint, value string")


def load(spark: SparkSession, events: list[dict], recording: str = "rec") -> DataFrame:
    parsed = parse_lines(lines(spark, [json.dumps(e) for e in events], recording))
    assert parsed.rejected.isEmpty()
    return cut_lineage(parsed.events)


def flat(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(recording, ns, id, key, value) rows with the envelope columns scans need."""
    df = spark.createDataFrame(rows, "recording_id string, mono_ns bigint, event_id string, k string, v bigint")
    return df.withColumn("sequence", F.lit(0).cast("bigint"))
