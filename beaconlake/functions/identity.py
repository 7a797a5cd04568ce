"""Producer streams, request and session scopes.

Keys are JSON arrays of the original strings: no delimiter can collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def producer_instance() -> Column:
    """Instance named by the producer, else the prefix of an id ``<instance>-<sequence>``."""
    shape = r"^(.+)-(\d+)$"
    suffix = F.regexp_extract("event_id", shape, 2)
    inferred = F.when(suffix == F.col("sequence").cast("string"), F.regexp_extract("event_id", shape, 1))
    return F.coalesce(F.nullif(F.col("producer.instance_id"), F.lit("")), inferred)


def _key(*parts: Column) -> Column:
    return F.to_json(F.array(*parts))


def stream_key() -> Column:
    """A known instance spans sessions; an unknown one is scoped to its session."""
    instance = producer_instance()
    name, node = F.col("producer.name"), F.col("producer.node_id")
    return F.when(instance.isNotNull(), _key(F.lit("stream-instance"), name, node, instance)).otherwise(
        _key(F.lit("stream-session"), F.col("session_id"), name, node)
    )


def request_key(stream: Column | None = None) -> Column:
    rid = F.nullif(F.col("request_id"), F.lit(""))
    return F.when(rid.isNotNull(), _key(F.lit("request"), stream if stream is not None else stream_key(), rid))


def session_key(stream: Column | None = None) -> Column:
    return _key(F.lit("stream-session-scope"), stream if stream is not None else stream_key(), F.col("session_id"))


def stream_label(key: Column) -> Column:
    """``name @ node`` of a stream key."""
    parts = F.from_json(key, "array<string>")
    start = F.when(parts[0] == "stream-instance", 1).when(parts[0] == "stream-session", 2)
    return F.when(
        start.isNotNull() & (F.size(parts) == 4),
        F.concat(F.element_at(parts, start + 1), F.lit(" @ "), F.element_at(parts, start + 2)),
    ).otherwise(F.lit("unknown producer stream"))


def with_stream(df: DataFrame) -> DataFrame:
    return df if "stream" in df.columns else df.withColumn("stream", stream_key())
