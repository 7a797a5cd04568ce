"""What a recording holds: manifest, capture policy, producers, sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.dialect import DEFAULT, Dialect
from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.operators.metrics import dropped_total
from beaconlake.operators.replay import filter_range
from beaconlake.schema import ord_col

REC = "recording_id"
SESSION_END = ("session.ended", "session.closed", "engine.stopped")


def capture_policy(events: DataFrame) -> DataFrame:
    """Declared text capture policies in first-seen order, comma-joined; "unspecified" without one."""
    declared = events.where(F.col("event_type").isin("session.started", "session.created")).select(
        REC, Readers(events).text("text_capture").alias("policy"), ord_col().alias("o")
    ).where("policy IS NOT NULL")
    first = declared.groupBy(REC, "policy").agg(F.min("o").alias("o"))
    joined = first.groupBy(REC).agg(F.array_sort(F.collect_list(F.struct("o", "policy"))).alias("p")).select(
        REC, F.array_join(F.transform("p", lambda x: x["policy"]), ",").alias("capture_policy")
    )
    return events.select(REC).distinct().join(joined, REC, "left").fillna("unspecified", ["capture_policy"])


def manifest(events: DataFrame) -> DataFrame:
    """One row of facts per recording; its lists are the rows of :func:`manifest_members`."""
    t = F.col("event_type")
    sessions = events.groupBy(REC, "session_id").agg(
        F.max(~t.startswith("telemetry.")).alias("judged"), F.max(t.isin(*SESSION_END)).alias("ended"), F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("wall_time", "mono_ns"), ord_col()).alias("origin"), F.min(ord_col()).alias("o"), F.max(F.coalesce("producer.synthetic", F.lit(False))).alias("synthetic"),
    )
    facts = sessions.groupBy(REC).agg(
        F.sum("n").alias("event_count"), F.count(F.lit(1)).alias("session_count"),
        ((F.count_if("judged") > 0) & (F.count_if(F.col("judged") & ~F.col("ended")) == 0)).alias("complete"),
        F.min_by("origin", "o").alias("origin"), F.max("synthetic").alias("synthetic"),
    )
    return facts.join(capture_policy(events), REC).join(dropped_total(events), REC, "left").select(
        REC, "event_count", "session_count", "complete", "capture_policy", F.coalesce("dropped_events", F.lit(0.0)).alias("dropped_events"),
        F.col("origin.wall_time").alias("origin_wall_time"), F.col("origin.mono_ns").alias("origin_mono_ns"), "synthetic",
    )


def manifest_members(events: DataFrame) -> DataFrame:
    """Distinct sessions, runs, sampling levels and schemas with the place of their first event."""
    named = F.array(
        *[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in (
            ("session", F.col("session_id")), ("run", F.col("run_id")), ("level", F.col("sampling.level")),
            ("schema", F.col("schema") if "schema" in events.columns else F.lit(None)),
        )]
    )
    rows = events.select(REC, ord_col().alias("o"), F.explode(named).alias("m")).where("m.value IS NOT NULL")
    return rows.groupBy(REC, "m.kind", "m.value").agg(F.min("o").alias("first_ord"))


def producers(events: DataFrame, by: tuple[str, ...] = ("name", "version", "node_id")) -> DataFrame:
    """Producers of a recording: events, first stated role, any synthetic."""
    role = F.col("producer.role")
    return events.groupBy(REC, *[F.col(f"producer.{c}").alias(c) for c in by]).agg(
        F.count(F.lit(1)).alias("events"), F.min_by(role, F.when(role.isNotNull(), ord_col())).alias("role"),
        F.max(F.coalesce("producer.synthetic", F.lit(False))).alias("synthetic"),
    )


def sensitivity(events: DataFrame, dialect: Dialect = DEFAULT, **selection) -> DataFrame:
    """Whether the selected events carry full text or tool payloads; the policy is that of the whole recording."""
    r = Readers(events)
    chosen = filter_range(events, **selection).groupBy(REC).agg(
        F.max(R.carries_text(r, dialect)).alias("text"), F.count_if(R.has_tool_payload(r)).alias("tool_payload_events")
    )
    policy = capture_policy(events)
    full = R.capture_allows_text(F.col("capture_policy")) | F.coalesce("text", F.lit(False))
    tools = F.coalesce("tool_payload_events", F.lit(0))
    return policy.join(chosen, REC, "left").select(
        REC, (full | (tools > 0)).alias("sensitive"), full.alias("full_text"), (tools > 0).alias("tool_payloads"), "capture_policy", tools.alias("tool_payload_events")
    )
