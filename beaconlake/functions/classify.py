"""Event classes and predicates on the event type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event classes in track order and the type prefix of each class.
EVENT_CLASSES = ("session", "request", "inference", "agent", "tool", "resource", "error", "telemetry", "other")
CLASS_PREFIXES = {
    "session": ("session", "engine"),
    "request": ("request",),
    "inference": ("inference", "model", "backend", "context"),
    "agent": ("agent", "route", "memory"),
    "tool": ("tool",),
    "resource": ("device", "kv", "scheduler"),
    "telemetry": ("telemetry", "recording"),
}


def is_failure() -> Column:
    t = F.col("event_type")
    return t.endswith(".failed") | t.endswith(".error")


def is_error() -> Column:
    t = F.col("event_type")
    return is_failure() | t.isin("retry.scheduled", "recovery.action") | t.startswith("guard.")


def event_class() -> Column:
    prefix = F.substring_index("event_type", ".", 1)
    out = F.when(is_error(), "error")
    for name, prefixes in CLASS_PREFIXES.items():
        out = out.when(prefix.isin(*prefixes), name)
    return out.otherwise("other")
