"""Time series over the span of a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.classify import event_class
from beaconlake.operators.replay import bounds
from beaconlake.operators.scans import Scan, clamped_sum, positioned, row_blocks, running
from beaconlake.schema import ord_col
from beaconlake.session import cut_lineage

BUCKETS = 24
LATENCY_WINDOW = 8
REC = "recording_id"


def _extent(events: DataFrame, buckets: int) -> DataFrame:
    span = F.greatest(F.lit(1), F.col("last_ns") - F.col("first_ns"))
    return bounds(events).select(REC, F.col("first_ns").alias("__first"), (span / F.lit(buckets)).alias("__width"))


def _bucket(ns: Column, buckets: int) -> Column:
    at = F.floor((ns - F.col("__first")) / F.col("__width")).cast("bigint")
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), at)).cast("bigint")


def _grid(recordings: DataFrame, buckets: int) -> DataFrame:
    return recordings.select(REC).distinct().select(REC, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket"))


def timeline_buckets(events: DataFrame, width: int = 96, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """Events per class and column of the relative time range [t0, t1] (the whole recording by default)."""
    limits = bounds(events)
    rel = events.select(REC, "mono_ns", event_class().alias("cls")).join(limits, REC).withColumn("rel", F.col("mono_ns") - F.col("first_ns"))
    start = F.lit(t0 or 0)
    stop = F.lit(t1) if t1 is not None else F.col("last_ns") - F.col("first_ns")
    scale = F.lit(float(width)) / F.greatest(stop - start, F.lit(1))
    column = F.least(F.floor((F.col("rel") - start) * scale).cast("bigint"), F.lit(width - 1).cast("bigint"))
    return rel.where((F.col("rel") >= start) & (F.col("rel") <= stop)).groupBy(REC, "cls", column.alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


def timeline_peaks(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy(REC, "cls").agg(F.max("events").alias("max_events"), F.sum("events").alias("events"))


def decode_bucket_overlap(events: DataFrame, spans: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Share of the tokens of every decode window in each bucket it overlaps."""
    windows = spans.where("decode.ns > 0").join(_extent(events, buckets), REC)
    first, last = _bucket(F.col("decode.start_ns"), buckets), _bucket(F.col("decode.end_ns"), buckets)
    cut = windows.select("*", F.explode(F.sequence(first, last)).alias("bucket"))
    low = F.col("__first") + F.col("bucket") * F.col("__width")
    overlap = F.greatest(F.lit(0.0), F.least(F.col("decode.end_ns"), low + F.col("__width")) - F.greatest(F.col("decode.start_ns"), low))
    return cut.select(REC, "stream", "request_id", "bucket", "__width", (F.col("decode.tokens") * overlap / F.col("decode.ns")).alias("tokens"))


def strip_tokens_per_sec(events: DataFrame, spans: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    per = decode_bucket_overlap(events, spans, buckets).groupBy(REC, "bucket").agg(
        (F.sum("tokens") / (F.first("__width") / 1e9)).alias("tokens_per_sec")
    )
    return _grid(per, buckets).join(per, [REC, "bucket"], "left").fillna(0.0, ["tokens_per_sec"])


def strip_agent_activity(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    t = F.col("event_type")
    acts = events.where(t.startswith("agent.") | t.startswith("route.") | t.startswith("tool.")).join(_extent(events, buckets), REC)
    per = acts.groupBy(REC, _bucket(F.col("mono_ns"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
    return _grid(per, buckets).join(per, [REC, "bucket"], "left").fillna(0, ["events"])


def active_model(events: DataFrame) -> DataFrame:
    """Latest model named by a route, a session or a load, and the number of distinct models."""
    t = F.col("event_type")
    source = F.when(t.isin("route.selected", "session.created"), t).when(t.startswith("model.load."), "model.load")
    named = events.select(
        REC, "mono_ns", "sequence", "event_id", source.alias("source"), Readers(events).name("model").alias("model"),
        F.col("producer.name").alias("producer"), F.col("producer.node_id").alias("node_id"),
    ).where("source IS NOT NULL AND model IS NOT NULL")
    # One row per model first, so the distinct count needs no second shuffle of all rows.
    per_model = named.groupBy(REC, "model").agg(F.max_by(F.struct("source", "producer", "node_id"), ord_col()).alias("at"), F.max(ord_col()).alias("o"))
    return per_model.groupBy(REC).agg(
        F.max_by("model", "o").alias("model"), F.max_by("at", "o").alias("at"), F.count(F.lit(1)).alias("distinct_models")
    ).select(REC, "model", "at.source", "at.producer", "at.node_id", "distinct_models")


def rolling_latency(spans: DataFrame, window: int = LATENCY_WINDOW) -> DataFrame:
    """Nearest-rank p50 and p95 over the last finished requests, in end order."""
    done = spans.where("end_ns IS NOT NULL").select(
        REC, "stream", "request_id", "end_ns", "first_start", ((F.col("end_ns") - F.col("start_ns")) / 1e6).alias("ms")
    )
    numbered = positioned(done, [REC], order=("end_ns", "first_start"), slice_by="end_ns")
    w = Window.partitionBy(REC, "__block").orderBy("pos").rowsBetween(1 - window, 0)
    held = row_blocks(numbered, [REC], window - 1).withColumn("base", F.sort_array(F.collect_list("ms").over(w))).where("__home")
    rank = lambda p: F.element_at("base", F.greatest(F.ceil(F.lit(p) * F.size("base")), F.lit(1)).cast("int"))
    return held.select(REC, "stream", "request_id", "end_ns", "pos", rank(0.5).alias("p50_ms"), rank(0.95).alias("p95_ms"))


def _kv_states(events: DataFrame) -> DataFrame:
    """KV events with the state of their producer: clamped blocks in use, total blocks, occupancy."""
    r, t = Readers(events), F.col("event_type")
    blocks = F.coalesce(r.whole("blocks"), F.lit(0))
    step = F.when(t == "kv.allocated", blocks).when(t == "kv.freed", -blocks)
    configured, stated = r.whole("kv_num_blocks"), r.whole("total_blocks")
    total = F.when(t == "scheduler.configured", configured).when(t == "kv.pressure", stated)
    occupancy = F.when(t == "kv.pressure", r.num("occupancy", "utilization"))
    who = F.to_json(F.array("producer.name", "producer.node_id", F.coalesce("producer.instance_id", "session_id")))
    rows = events.where(t.isin("scheduler.configured", "kv.allocated", "kv.freed", "kv.pressure")).select(
        REC, "mono_ns", "sequence", "event_id", "event_type", who.alias("who"), step.alias("step"), F.when(total > 0, total).alias("set_total"), occupancy.alias("set_occ")
    ).where("event_type <> 'scheduler.configured' OR set_total IS NOT NULL")
    keys = [REC, "who"]
    scans = [Scan(c, "last", F.col(f"set_{c}")) for c in ("total", "occ")]
    earlier = [Scan(f"{c}_before", "last", F.col(f"set_{c}"), inclusive=False) for c in ("total", "occ")]
    return running(clamped_sum(rows, keys, F.col("step"), "used", before="used_before"), keys, [*scans, *earlier])


def kv_snapshots(events: DataFrame) -> DataFrame:
    """Recording-wide KV state right after every KV event.

    ``fraction`` is known from blocks when every listed producer reports blocks and a
    total. The recording's sums follow from the change each event makes to its producer.
    """
    states = _kv_states(events)

    def share(used: str, total: str, occ: str) -> dict[str, Column]:
        known = F.col(used).isNotNull() & F.col(total).isNotNull()
        listed = F.col(used).isNotNull() | F.col(occ).isNotNull()
        zero = F.lit(0).cast("bigint")
        return {
            "used": F.when(known, F.col(used)).otherwise(zero), "total": F.when(known, F.col(total)).otherwise(zero),
            "known": known.cast("bigint"), "producers": listed.cast("bigint"),
        }

    now, past = share("used", "total", "occ"), share("used_before", "total_before", "occ_before")
    changes = states.select(REC, "who", "mono_ns", "sequence", "event_id", "occ", *[(now[c] - past[c]).alias(f"d_{c}") for c in now])
    steps = [Scan(f"all_{c}", "sum", F.col(f"d_{c}")) for c in now]
    rows = running(changes, [REC], [*steps, Scan("occ_seen", "max", F.col("occ").isNotNull().cast("int"))]).where("all_producers > 0")
    exact = F.when((F.col("all_known") == F.col("all_producers")) & (F.col("all_total") > 0), F.col("all_used") / F.nullif("all_total", F.lit(0)))
    return rows.select(
        REC, "who", "mono_ns", "sequence", "event_id", "occ", F.col("all_used").alias("used_blocks"), F.col("all_total").alias("total_blocks"),
        F.col("all_producers").alias("producers"), (F.col("occ_seen") == 1).alias("occ_seen"), exact.alias("fraction"),
    )


def kv_series(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """KV fraction at the end of every bucket, carried forward; buckets before the first report are left out.

    While blocks are not known for all producers the highest latest occupancy stands
    in; before any occupancy was reported the last known block fraction stays.
    """
    rows = cut_lineage(kv_snapshots(events)).join(_extent(events, buckets), REC).withColumn("bucket", _bucket(F.col("mono_ns"), buckets))
    last = rows.groupBy(REC, "bucket").agg(
        F.max_by(F.struct("fraction", "occ_seen"), ord_col()).alias("at"), F.max_by("fraction", F.when(F.col("fraction").isNotNull(), ord_col())).alias("known")
    )
    w = Window.partitionBy(REC).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("known", F.last("known", True).over(w))
    per_who = rows.where("occ IS NOT NULL").groupBy(REC, "who", "bucket").agg(F.max_by("occ", ord_col()).alias("occ"))
    until = F.lead("bucket", 1, buckets).over(Window.partitionBy(REC, "who").orderBy("bucket"))
    held = per_who.withColumn("until", until - 1).select(REC, "occ", F.explode(F.sequence("bucket", "until")).alias("bucket"))
    highest = held.groupBy(REC, "bucket").agg(F.greatest(F.max("occ"), F.lit(0.0)).alias("occupancy"))
    value = F.coalesce("at.fraction", F.when(F.col("at.occ_seen"), F.col("occupancy")), F.col("known"))
    filled = last.join(highest, [REC, "bucket"], "left").select(REC, "bucket", value.alias("v"))
    return _grid(filled, buckets).join(filled, [REC, "bucket"], "left").select(REC, "bucket", F.last("v", True).over(w).alias("kv")).where("kv IS NOT NULL")
