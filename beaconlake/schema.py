"""Envelope of an event row.

One recording is one ``recording_id``; the events of a recording in ``ORD``
order are its replay order. ``attributes`` is a VARIANT (as read from JSON) or
a STRUCT (columnar tables whose attributes are already shredded); operators
accept both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORD = ("mono_ns", "sequence", "event_id")
ID_FIELDS = ("run_id", "request_id", "agent_id", "task_id", "model_instance_id", "device_id")
SAMPLING_LEVELS = ("off", "metrics", "standard", "deep")

PRODUCER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("instance_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("synthetic", T.BooleanType()),
    ]
)
SAMPLING = T.StructType([T.StructField("level", T.StringType()), T.StructField("sampled", T.BooleanType())])


def envelope(attributes: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("recording_id", T.StringType()),
            T.StructField("schema", T.StringType()),
            T.StructField("event_id", T.StringType()),
            T.StructField("sequence", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("wall_time", T.StringType()),
            T.StructField("mono_ns", T.LongType()),
            T.StructField("session_id", T.StringType()),
            *[T.StructField(name, T.StringType()) for name in ID_FIELDS],
            T.StructField("producer", PRODUCER),
            T.StructField("sampling", SAMPLING),
            T.StructField("attributes", attributes),
        ]
    )


def ord_col(prefix: str = "") -> Column:
    """Replay position of a row as one comparable struct."""
    return F.struct(*[F.col(f"{prefix}{name}").alias(name) for name in ORD])
