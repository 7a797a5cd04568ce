"""GPU memory samples and backend warnings per backend of a producer instance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.identity import producer_instance
from beaconlake.operators.scans import Scan, lagged, running
from beaconlake.schema import ord_col

KEY = ["recording_id", "backend_key"]
_ROW = [*KEY, "mono_ns", "sequence", "event_id"]


def gpu_rows(events: DataFrame) -> DataFrame:
    """GPU samples and coded warnings with the key of their backend."""
    r, t = Readers(events), F.col("event_type")
    instance = producer_instance()
    code = F.when(t == "backend.warning", r.name("code"))
    chosen = events.where(t.isin("backend.gpu_memory.sample", "backend.warning"))
    key = F.to_json(
        F.array("producer.name", "producer.node_id", instance, F.when(instance.isNull(), F.col("session_id")), r.name("backend"))
    )
    return chosen.select(
        "recording_id", key.alias("backend_key"), "mono_ns", "sequence", "event_id", "wall_time", R.gpu_memory_sample(r).alias("sample"), code.alias("code"),
        r.name("backend").alias("backend"), instance.alias("instance_id"), F.coalesce("producer.synthetic", F.lit(False)).alias("synthetic"),
        r.has("fitted_ctx").alias("has_context"), r.name("fit_outcome").alias("fit_outcome"), r.name("message").alias("message"),
        r.name("severity").alias("severity"), r.name("source").alias("source"), r.count("count").alias("reported"),
    ).where("sample IS NOT NULL OR code IS NOT NULL")


def gpu_samples(events: DataFrame) -> DataFrame:
    """Samples with their epoch: one more whenever the sample counter falls below its last known value."""
    rows = gpu_rows(events).where("sample IS NOT NULL")
    n = F.col("sample.sample_count")
    previous = running(rows, KEY, [Scan("previous", "last", n, inclusive=False)])
    reset = F.when(n < F.col("previous"), 1).otherwise(0).cast("bigint")
    return running(previous.withColumn("reset", reset), KEY, [Scan("epoch", "sum", F.col("reset"))]).select(*_ROW, "wall_time", "sample.*", "epoch")


def gpu_context_changes(events: DataFrame) -> DataFrame:
    """Samples whose fitted context differs from the one before (only samples that state it)."""
    rows = gpu_rows(events).where("sample IS NOT NULL AND has_context").withColumn("fitted_ctx", F.col("sample.fitted_ctx"))
    before = lagged(rows, KEY, {"known": F.lit(True), "was": F.col("fitted_ctx")})
    return before.where(F.col("known").isNull() | ~F.col("was").eqNullSafe(F.col("fitted_ctx"))).select(*_ROW, "fitted_ctx", "fit_outcome")


def gpu_warnings(events: DataFrame) -> DataFrame:
    """Warnings per code: first and last seen, latest stated text, occurrences.

    A signature (code, source, message) counts up by one per unreported repeat and
    jumps to a reported count that is higher, so its final count is the largest of
    "all repeats" and "a report plus the repeats after it".
    """
    rows = gpu_rows(events).where("code IS NOT NULL").withColumn("signature", F.to_json(F.array("code", "source", "message")))
    report = F.when(F.col("reported") > 0, F.col("reported"))
    plus = F.when(report.isNull(), 1).otherwise(0).cast("bigint")
    upto = running(rows.withColumn("plus", plus), [*KEY, "signature"], [Scan("upto", "sum", F.col("plus"))])
    per_signature = upto.groupBy(*KEY, "code", "signature").agg(
        F.sum("plus").alias("repeats"), F.max(report - F.col("upto")).alias("best"), F.min(ord_col()).alias("first"), F.max(ord_col()).alias("last")
    )
    counts = per_signature.groupBy(*KEY, "code").agg(
        F.sum(F.greatest(F.col("repeats"), F.col("repeats") + F.col("best"))).alias("count"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), ord_col())).alias(c)
    texts = rows.groupBy(*KEY, "code").agg(
        latest("message"), latest("severity"), latest("source"), F.min_by("wall_time", ord_col()).alias("first_wall"), F.max_by("wall_time", ord_col()).alias("last_wall")
    )
    return counts.join(texts, [*KEY, "code"]).select(
        *KEY, "code", "count", "message", "severity", "source", F.col("first.mono_ns").alias("first_ns"), F.col("last.mono_ns").alias("last_ns"),
        F.col("first.event_id").alias("first_event_id"), F.col("last.event_id").alias("last_event_id"), "first_wall", "last_wall",
    )


def gpu_backends(events: DataFrame) -> DataFrame:
    """One row per backend: samples, latest sample and fitted context, synthetic flag, number of warning codes."""
    rows = gpu_rows(events)
    is_sample = F.col("sample").isNotNull()
    latest = F.struct("event_id", "sample.dedicated_bytes", "sample.shared_bytes", "sample.spilled")
    context = F.when(is_sample & F.col("has_context"), ord_col())
    folded = rows.groupBy(*KEY).agg(
        F.max("backend").alias("backend"), F.max("instance_id").alias("instance_id"), F.max("synthetic").alias("synthetic"),
        F.count_if(is_sample).alias("samples"), F.max_by(latest, F.when(is_sample, ord_col())).alias("latest"),
        F.max_by(F.struct("sample.fitted_ctx"), context).alias("context"),
    )
    codes = rows.where("code IS NOT NULL").select(*KEY, "code").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("warning_codes"))
    return folded.join(codes, KEY, "left").select(
        *KEY, "backend", "instance_id", "synthetic", "samples", F.col("latest.event_id").alias("latest_event_id"), "latest.dedicated_bytes",
        "latest.shared_bytes", "latest.spilled", F.col("context.fitted_ctx").alias("fitted_ctx"), F.coalesce("warning_codes", F.lit(0)).alias("warning_codes"),
    )
