"""Request spans: the latest started instance of every request, with its evidence.

The latest start of a request is an aggregate over start events alone; the
events after it are then folded with algebraic aggregates only, so partial
sums are combined before the shuffle and a request holding a large share of
all rows does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.identity import with_stream
from beaconlake.schema import ord_col

KEY = ["recording_id", "stream", "request_id"]
UNKNOWN_MODEL = "(model not reported)"


def _ord_struct(ns: str, seq: str, event: str) -> Column:
    return F.struct(F.col(ns).alias("mono_ns"), F.col(seq).alias("sequence"), F.col(event).alias("event_id"))


def request_starts(events: DataFrame) -> DataFrame:
    """First and last start of every request key."""
    started = with_stream(events.where((F.col("event_type") == "request.started") & R.filled("request_id").isNotNull()))
    return started.groupBy(*KEY).agg(F.min(ord_col()).alias("first_start"), F.max(ord_col()).alias("start_ord"))


def session_models(events: DataFrame) -> DataFrame:
    """Model of the first ``session.created`` that names one, per stream and session."""
    model = Readers(events).name("model")
    created = with_stream(events.where(F.col("event_type") == "session.created").withColumn("model", model)).where("model IS NOT NULL")
    return created.groupBy("recording_id", "stream", "session_id").agg(F.min_by("model", ord_col()).alias("session_model"))


def _facts(events: DataFrame) -> DataFrame:
    """The narrow columns spans are folded from."""
    r = Readers(events)
    output = F.col("event_type") == "inference.token.generated"
    ends = F.col("event_type").isin(*R.OUTCOMES)
    rows = with_stream(events).where(R.filled("request_id").isNotNull())
    return rows.select(
        *KEY, "mono_ns", "sequence", "event_id",
        F.when(
            F.col("event_type") == "request.started",
            F.struct(F.col("producer.name").alias("producer"), "session_id", R.filled("model_instance_id").alias("model_instance_id")),
        ).alias("start"),
        F.when(ends, F.substring_index("event_type", ".", -1)).alias("outcome"),
        F.when(ends, R.backend_token_count(r)).alias("backend_tokens"),
        F.when(ends, r.num("total_ms")).alias("total_ms"),
        F.when(ends, r.num("ttft_ms")).alias("ttft_ms"),
        R.backend_eval_ms(r).alias("eval_ms"),
        output.alias("is_output"),
        F.when(output, R.output_token_count(r)).alias("n_tokens"),
        F.when(~output, r.name("model")).alias("model"),
        F.when(~output, R.prompt_cache_report(r)).alias("cache"),
        F.when(~output, R.speculation_report(r)).alias("spec"),
    )


def request_spans(events: DataFrame) -> DataFrame:
    """One row per request key that started, for its latest start."""
    rows = _facts(events).join(request_starts(events), KEY).where(ord_col() >= F.col("start_ord"))
    at = ord_col()
    has = lambda c: F.when(F.col(c).isNotNull(), at)
    folded = rows.groupBy(*KEY, "start_ord", "first_start").agg(
        F.min_by("start", at).alias("start"),
        F.min_by(F.struct("mono_ns", "outcome", "backend_tokens", "total_ms", "ttft_ms"), has("outcome")).alias("end"),
        F.max_by(F.struct("eval_ms", "mono_ns"), has("eval_ms")).alias("eval"),
        F.min(F.when(F.col("is_output"), F.col("mono_ns"))).alias("first_token_ns"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
        F.count("n_tokens").alias("token_events"),
        F.max(F.when(F.col("n_tokens").isNotNull(), F.col("mono_ns"))).alias("last_token_ns"),
        F.count_if(F.col("is_output") & F.col("n_tokens").isNull()).alias("chunks"),
        F.min_by("model", has("model")).alias("attr_model"),
        F.max_by(F.struct("cache.*", "event_id"), has("cache")).alias("cache"),
        F.max_by(F.struct("spec.*", "event_id"), has("spec")).alias("spec"),
    )
    spans = folded.withColumn("session_id", F.col("start.session_id"))
    spans = spans.join(session_models(events), ["recording_id", "stream", "session_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    flat = spans.select(
        *KEY, F.col("start.producer").alias("producer"), "session_id",
        F.col("start_ord.mono_ns").alias("start_ns"), "start_ord", "first_start",
        F.col("end.mono_ns").alias("end_ns"), F.coalesce("end.outcome", F.lit("open")).alias("outcome"),
        "first_token_ns", "last_token_ns", zero("tokens"), zero("token_events"), zero("chunks"),
        F.col("end.backend_tokens").alias("backend_tokens"), F.col("end.total_ms").alias("total_ms"), F.col("end.ttft_ms").alias("ttft_ms"),
        F.col("eval.eval_ms").alias("eval_ms"), F.col("eval.mono_ns").alias("eval_end_ns"),
        F.coalesce("attr_model", "session_model", "start.model_instance_id").alias("model"),
        F.col("cache.prompt").alias("cache_prompt_tokens"), F.col("cache.cached").alias("cache_cached_tokens"),
        F.col("cache.evaluated").alias("cache_evaluated_tokens"), F.col("cache.source").alias("cache_source"), F.col("cache.event_id").alias("cache_event_id"),
        F.col("spec.drafted").alias("spec_draft_tokens"), F.col("spec.accepted").alias("spec_accepted_tokens"),
        F.col("spec.source").alias("spec_source"), F.col("spec.event_id").alias("spec_event_id"),
    )
    count = (
        F.when(F.col("backend_tokens").isNotNull(), F.col("backend_tokens"))
        .when((F.col("chunks") > 0) & (F.col("tokens") == 0), F.lit(None).cast("bigint"))
        .otherwise(F.col("tokens"))
    )
    return with_decode_window(flat.withColumn("token_count", count))


def with_decode_window(spans: DataFrame) -> DataFrame:
    """Best decode window of a span with a known token count: start, length, tokens in it and its source."""
    n, end, first = F.col("token_count"), F.col("end_ns"), F.col("first_token_ns")
    reported = (F.col("total_ms") - F.col("ttft_ms")) * 1e6
    has_reported = end.isNotNull() & (F.col("ttft_ms") >= 0) & (F.col("total_ms") > F.col("ttft_ms"))
    until = F.coalesce(end, F.col("last_token_ns"))

    def window(start, ns, tokens, source):
        return F.struct(
            start.cast("double").alias("start_ns"), (start + ns).cast("double").alias("end_ns"), ns.cast("double").alias("ns"),
            tokens.alias("tokens"), F.lit(source).alias("source"),
        )

    eval_ns = F.col("eval_ms") * 1e6
    decode = (
        F.when(F.coalesce(n <= 0, F.lit(True)), F.lit(None))
        .when(F.col("eval_ms").isNotNull(), window(F.col("eval_end_ns") - eval_ns, eval_ns, n, "backend-eval"))
        .when(n < 2, F.lit(None))
        .when(has_reported, window(end - reported, reported, n - 1, "reported-total-minus-ttft"))
        .when((until > first) & end.isNotNull(), window(first, end - first, n - 1, "first-output-to-end"))
        .when(until > first, window(first, F.col("last_token_ns") - first, n - 1, "first-to-last-token"))
    )
    return spans.withColumn("decode", decode)


def token_rows(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Output events with ``place``: span (of its latest instance), loose (no request running yet) or old (superseded)."""
    r = Readers(events)
    output = with_stream(events.where(F.col("event_type") == "inference.token.generated"))
    rows = output.select(
        "recording_id", "stream", R.filled("request_id").alias("request_id"), "mono_ns", "sequence", "event_id", R.output_token_count(r).alias("n_tokens")
    )
    joined = rows.join(spans.select(*KEY, "first_start", "start_ord", "backend_tokens"), KEY, "left")
    place = (
        F.when(F.col("first_start").isNull() | (ord_col() < F.col("first_start")), "loose")
        .when(ord_col() > F.col("start_ord"), "span")
        .otherwise("old")
    )
    return joined.withColumn("place", place).drop("first_start", "start_ord")
