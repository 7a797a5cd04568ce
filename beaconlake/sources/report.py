"""Report of a recording: the tables behind it, written by recording, and the gate for sensitive data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.dialect import DEFAULT, Dialect
from beaconlake.functions.classify import event_class
from beaconlake.operators import detectors, manifests, metrics, replay, series, topology
from beaconlake.operators.spans import request_spans
from beaconlake.schema import ord_col

REC = "recording_id"


class SensitiveDataError(RuntimeError):
    """Writing was refused: the selection holds full text or tool payloads. Nothing was written."""


def require_acknowledged(events: DataFrame, acknowledge_sensitive: bool, dialect: Dialect = DEFAULT, **selection) -> None:
    if not acknowledge_sensitive and not manifests.sensitivity(events, dialect, **selection).where("sensitive").isEmpty():
        raise SensitiveDataError("the selection contains sensitive data (full text or tool payloads); acknowledge it to write it")


def report_source(events: DataFrame) -> DataFrame:
    """Facts of the exported range of each recording."""
    # Sessions and producers are counted over their distinct rows, not over all events.
    listed = lambda c: events.select(REC, c.alias("v")).distinct().groupBy(REC).agg(F.count("v").alias("n"))
    sessions = listed(F.col("session_id")).withColumnRenamed("n", "sessions")
    producers = listed(F.concat_ws(" ", "producer.name", "producer.version")).withColumnRenamed("n", "producers")
    facts = events.groupBy(REC).agg(
        F.count(F.lit(1)).alias("exported_events"), F.max(F.coalesce("producer.synthetic", F.lit(False))).alias("synthetic"), F.min_by("wall_time", ord_col()).alias("first_wall_time"),
        F.max_by("wall_time", ord_col()).alias("last_wall_time"), F.min("mono_ns").alias("origin_mono_ns"),
        (F.round((F.max("mono_ns") - F.min("mono_ns")) / 1e6) / 1e3).alias("duration_s"),
    )
    return facts.join(sessions, REC).join(producers, REC)


def report_tables(
    events: DataFrame, config: detectors.Config = detectors.Config(), columns: int = 96, tables: tuple[str, ...] | None = None, **selection
) -> dict[str, DataFrame]:
    """The tables of a report over the selected range; only the named ones are planned."""
    chosen = replay.filter_range(events, **selection)
    parts: dict[str, object] = {}

    def once(name: str, make):
        if name not in parts:
            parts[name] = make()
        return parts[name]

    spans = lambda: once("spans", lambda: request_spans(chosen))
    found = lambda: once("found", lambda: detectors.run_all(chosen, config))
    stated = lambda: once("stated", lambda: topology.mentions(chosen))
    makers = {
        "source": lambda: report_source(chosen),
        "request_spans": spans,
        "request_latency": lambda: metrics.latency_stats(spans()),
        "time_to_first_token": lambda: metrics.ttft_stats(spans()),
        "tokens": lambda: metrics.token_totals(chosen, spans()),
        "errors": lambda: metrics.errors_by_type(chosen),
        "agents": lambda: metrics.agent_counters(chosen),
        "tools": lambda: metrics.tool_counters(chosen),
        "resources": lambda: metrics.resource_counters(chosen),
        "findings": lambda: found().findings,
        "finding_evidence": lambda: detectors.resolve_evidence(found().evidence, chosen, event_class()),
        "topology_nodes": lambda: topology.topology_nodes(stated()),
        "topology_edges": lambda: topology.topology_edges(stated()),
        "timeline": lambda: series.timeline_buckets(chosen, columns),
    }
    return {name: makers[name]() for name in tables or makers}


def write_report(
    events: DataFrame, path: str, format: str = "parquet", acknowledge_sensitive: bool = False, dialect: Dialect = DEFAULT,
    tables: tuple[str, ...] | None = None, config: detectors.Config = detectors.Config(), **selection,
) -> list[str]:
    """Write the report tables under ``path``, one folder per table, partitioned by recording."""
    require_acknowledged(events, acknowledge_sensitive, dialect, **selection)
    made = report_tables(events, config, tables=tables, **selection)
    for name, table in made.items():
        table.write.mode("overwrite").partitionBy(REC).format(format).save(f"{path}/{name}")
    return list(made)
