"""Replay order, duplicates, gaps, cursors and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.functions.classify import event_class, is_error
from beaconlake.functions.identity import with_stream
from beaconlake.functions.readings import export_search_text, table_search_text
from beaconlake.operators.scans import Scan, lagged, running
from beaconlake.schema import ORD, ord_col

SEQUENCES_PER_SLICE = 1_000_000


def dedupe_events(deliveries: DataFrame, arrival: tuple[str, ...]) -> DataFrame:
    """First delivery of every event id, with the number of repeats.

    ``arrival`` names the columns that order deliveries (file, line). The minimum
    is combined map-side, so a mass of copies of one id stays cheap.
    """
    row = F.struct(*[F.col(c) for c in deliveries.columns])
    first = F.min_by(row, F.struct(*arrival)).alias("first")
    grouped = deliveries.groupBy("recording_id", "event_id").agg(first, (F.count(F.lit(1)) - 1).alias("duplicates"))
    return grouped.select("first.*", "duplicates")


def replay_order(events: DataFrame) -> DataFrame:
    """Range-partitioned, sorted by recording and replay position."""
    return events.orderBy("recording_id", *ORD)


def merge_batches(history: DataFrame, batch: DataFrame, arrival: tuple[str, ...]) -> DataFrame:
    """History plus the events of the batch it does not hold yet."""
    fresh = dedupe_events(batch, arrival).drop("duplicates")
    known = history.select("recording_id", "event_id")
    return history.unionByName(fresh.join(known, ["recording_id", "event_id"], "left_anti"), allowMissingColumns=True)


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Missing sequence numbers per producer stream as (from_seq, to_seq), both inclusive."""
    seen = with_stream(events).select("recording_id", "stream", "sequence").distinct()
    pairs = lagged(
        seen, ["recording_id", "stream"], {"previous": F.col("sequence")}, order=("sequence",), slice_by="sequence", width=SEQUENCES_PER_SLICE
    )
    return pairs.where(F.col("sequence") > F.col("previous") + 1).select(
        "recording_id", "stream", (F.col("previous") + 1).alias("from_seq"), (F.col("sequence") - 1).alias("to_seq")
    )


def bounds(events: DataFrame) -> DataFrame:
    """First and last time of every recording."""
    return events.groupBy("recording_id").agg(F.min("mono_ns").alias("first_ns"), F.max("mono_ns").alias("last_ns"))


def as_of(events: DataFrame, position_ns: Column | int) -> DataFrame:
    """Events at or before a cursor ``position_ns`` after the start of their recording (clamped to it)."""
    position = F.lit(position_ns) if isinstance(position_ns, int) else position_ns
    limits = bounds(events).select(
        "recording_id",
        (F.col("first_ns") + F.least(F.greatest(F.lit(0), position), F.col("last_ns") - F.col("first_ns"))).alias("__until"),
    )
    return events.join(limits, "recording_id").where(F.col("mono_ns") <= F.col("__until")).select(*events.columns)


def at_cursors(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """The prefix of a recording at each of its cursors (``recording_id, cursor_id, at_ns``).

    Every prefix becomes a recording of its own, ``<recording>@<cursor>``, so that
    all operators give the state at each cursor unchanged.
    """
    prefixes = events.join(cursors, "recording_id").where(F.col("mono_ns") <= F.col("at_ns"))
    return prefixes.withColumn("recording_id", F.concat("recording_id", F.lit("@"), "cursor_id")).select(*events.columns)


def neighbours(events: DataFrame, predicate: Column) -> DataFrame:
    """Ids of the matching events just before and just after every event."""
    hit = F.when(predicate, F.col("event_id"))
    return running(
        events, ["recording_id"], [Scan("previous_id", "last", hit, inclusive=False), Scan("next_id", "next", hit, inclusive=False)]
    )


def next_matching(events: DataFrame, predicate: Column, after_ns: Column | int) -> DataFrame:
    """First matching event of each recording strictly after a time."""
    found = events.where(predicate & (F.col("mono_ns") > after_ns))
    return found.groupBy("recording_id").agg(F.min_by("event_id", ord_col()).alias("event_id"))


def nearest_events(events: DataFrame, targets: DataFrame, max_distance_ns: int | None = None) -> DataFrame:
    """Nearest event of every target time (``recording_id, target_ns``); a tie goes to the earlier event."""
    columns = ["recording_id", "mono_ns", "side", "sequence", "event_id"]
    marks = targets.distinct().select(
        "recording_id", F.col("target_ns").alias("mono_ns"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("sequence"), F.lit("").alias("event_id")
    )
    rows = events.withColumn("side", F.lit(1)).select(*columns).unionByName(marks)
    event = F.when(F.col("side") == 1, F.struct("mono_ns", "event_id"))
    found = running(
        rows, ["recording_id"], [Scan("left", "last", event), Scan("right", "next", event)], order=("mono_ns", "side", "sequence", "event_id")
    ).where("side = 0")
    to_left, to_right = F.col("mono_ns") - F.col("left.mono_ns"), F.col("right.mono_ns") - F.col("mono_ns")
    take_left = F.coalesce(to_left <= to_right, to_right.isNull())
    out = found.select(
        "recording_id",
        F.col("mono_ns").alias("target_ns"),
        F.when(take_left, F.col("left.event_id")).otherwise(F.col("right.event_id")).alias("event_id"),
        F.when(take_left, to_left).otherwise(to_right).alias("distance_ns"),
    )
    return out if max_distance_ns is None else out.where(F.col("distance_ns") <= max_distance_ns)


def _contains(haystack: Column, text: str) -> Column:
    return F.contains(haystack, F.lit(text))


def filter_range(
    events: DataFrame, cls: str = "all", text: str = "", from_ns: int | None = None, to_ns: int | None = None
) -> DataFrame:
    """Export range: class, trimmed case-insensitive text, inclusive times. A full range is the input."""
    out, needle = events, text.strip().lower()
    if from_ns is not None:
        out = out.where(F.col("mono_ns") >= from_ns)
    if to_ns is not None:
        out = out.where(F.col("mono_ns") <= to_ns)
    if cls != "all":
        out = out.where(event_class() == cls)
    return out.where(_contains(export_search_text(), needle)) if needle else out


def filter_table(events: DataFrame, cls: str = "all", text: str = "") -> DataFrame:
    """Rows of the event table matching class and (already lower-case) text."""
    out = events if cls == "all" else events.where(event_class() == cls)
    return out.where(_contains(table_search_text(), text)) if text else out


def class_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("recording_id", event_class().alias("cls")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(is_error()).alias("errors")
    )
