"""Session metrics: latency, tokens, errors, counters, resources and reuse totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.classify import is_error
from beaconlake.functions.identity import with_stream
from beaconlake.operators.replay import bounds
from beaconlake.operators.scans import Scan, running
from beaconlake.operators.spans import UNKNOWN_MODEL, token_rows
from beaconlake.schema import ord_col

RECENT_WINDOW_NS = 5_000_000_000
RECENT_NS = float(RECENT_WINDOW_NS)


OCTAVE_BUCKETS = 1024
FINE_BUCKETS = 4096


def _pick_bucket(buckets: DataFrame, keys: list[str], bucket: str, ranks: dict[str, Column]) -> DataFrame:
    """Per key and rank the first bucket that reaches it, as a struct: rows before it, its smallest and largest value."""
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(bucket))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    rows = buckets.withColumn("__upto", upto).withColumn("__all", total)
    at = F.struct(F.col(bucket).alias("b"), (F.col("__upto") - F.col("__n")).alias("before"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"))
    picks = [F.min(F.when(F.col("__upto") >= rank, at)).alias(name) for name, rank in ranks.items()]
    return rows.groupBy(*keys).agg(F.max("__all").alias("count"), F.max("__hi").alias("max"), *picks)


def nearest_ranks(df: DataFrame, keys: list[str], value: Column, percentiles: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Exact nearest-rank percentiles: count, p50, p95 and max of ``value``.

    Ranks are found by refining histograms. Values are counted into buckets of 1/1024 octave (combined map-side); the bucket that
    holds the rank is chosen; its values are cut into 4096 equal parts of its own range, and only the part that holds the rank is ordered. So
    no task holds the values of a group, however close together they lie.
    """
    values = df.where(value.isNotNull()).groupBy(*keys, value.alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    size = F.floor(F.log2(F.abs(F.col("__d")).cast("double") + 1) * OCTAVE_BUCKETS)
    counts = [F.sum("__n").alias("__n"), F.min("__d").alias("__lo"), F.max("__d").alias("__hi")]
    coarse = values.groupBy(*keys, F.when(F.col("__d") < 0, -size - 1).otherwise(size).cast("bigint").alias("__b")).agg(*counts)
    ranks = {f"__p{p}": F.greatest(F.ceil(F.lit(p / 100.0) * F.col("__all")), F.lit(1)) for p in percentiles}
    chosen = _pick_bucket(coarse, keys, "__b", ranks)

    wanted = F.array(*(F.struct(F.lit(p).alias("p"), F.greatest(F.ceil(F.lit(p / 100.0) * F.col("count")), F.lit(1)).cast("bigint").alias("rank"), F.col(f"__p{p}").alias("at")) for p in percentiles))
    near = values.join(chosen.select(*keys, F.explode(wanted).alias("__w")), keys).where((F.col("__d") >= F.col("__w.at.lo")) & (F.col("__d") <= F.col("__w.at.hi")))
    width = (F.col("__w.at.hi") - F.col("__w.at.lo")).cast("double")
    part = F.coalesce(F.floor(F.try_divide((F.col("__d") - F.col("__w.at.lo")).cast("double"), width) * (FINE_BUCKETS - 1)), F.lit(0)).cast("bigint")
    near = near.select(*keys, F.col("__w.p").alias("__p"), (F.col("__w.rank") - F.col("__w.at.before")).alias("__rank"), part.alias("__part"), "__d", "__n")
    fine = _pick_bucket(near.groupBy(*keys, "__p", "__rank", "__part").agg(*counts), [*keys, "__p", "__rank"], "__part", {"__at": F.col("__rank")})
    fine = fine.select(*keys, "__p", F.col("__at.b").alias("__part"), (F.col("__rank") - F.col("__at.before")).alias("__left"))
    last = near.join(fine, [*keys, "__p", "__part"])
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__p").orderBy("__d"))
    found = last.withColumn("__upto", upto).groupBy(*keys).agg(*(F.min(F.when((F.col("__p") == p) & (F.col("__upto") >= F.col("__left")), F.col("__d"))).alias(f"p{p}") for p in percentiles))
    return chosen.select(*keys, "count", "max").join(found, keys).select(*keys, "count", *(f"p{p}" for p in percentiles), "max")


def _latency(df: DataFrame, keys: list[str], duration_ns: str) -> DataFrame:
    ranks = nearest_ranks(df, keys, F.col(duration_ns))
    return ranks.select(*keys, "count", *[(F.col(c) / 1e6).alias(f"{c}_ms") for c in ("p50", "p95", "max")])


def latency_stats(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Finished-request latency per recording (and, for example, producer)."""
    done = spans.where("end_ns IS NOT NULL").withColumn("__ns", F.col("end_ns") - F.col("start_ns"))
    return _latency(done, ["recording_id", *(by or [])], "__ns")


def ttft_stats(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    seen = spans.where("first_token_ns IS NOT NULL").withColumn("__ns", F.col("first_token_ns") - F.col("start_ns"))
    return _latency(seen, ["recording_id", *(by or [])], "__ns")


def token_totals(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Token totals, provenance and the overall decode rate of each recording."""
    counted = F.col("backend_tokens").isNull() & F.col("token_count").isNotNull()
    per_span = spans.groupBy("recording_id").agg(
        F.coalesce(F.sum("backend_tokens"), F.lit(0)).alias("from_backend"),
        F.count("backend_tokens").alias("backend_spans"),
        F.coalesce(F.sum(F.when(counted, F.col("tokens"))), F.lit(0)).alias("span_tokens"),
        F.coalesce(F.sum(F.when(counted, F.col("token_events"))), F.lit(0)).alias("span_token_events"),
        F.count_if(F.col("token_count").isNull()).alias("uncounted_requests"),
        F.coalesce(F.sum("decode.tokens"), F.lit(0)).alias("decode_tokens"),
        F.coalesce(F.sum("decode.ns"), F.lit(0.0)).alias("decode_ns"),
    )
    rows = token_rows(events, spans)
    loose = F.col("n_tokens").isNotNull() & (F.col("place") == "loose")
    per_event = rows.groupBy("recording_id").agg(
        F.count_if(F.col("n_tokens").isNull()).alias("chunks"),
        F.coalesce(F.sum(F.when(loose, F.col("n_tokens"))), F.lit(0)).alias("loose_tokens"),
        F.count_if(loose).alias("loose_events"),
        F.min_by("n_tokens", F.when(loose, ord_col())).alias("loose_first"),
        (F.max(F.when(loose, F.col("mono_ns"))) - F.min(F.when(loose, F.col("mono_ns")))).alias("loose_ns"),
    )
    all_ = events.select("recording_id").distinct().join(per_span, "recording_id", "left").join(per_event, "recording_id", "left")
    ints = [c for c in all_.columns if c not in ("recording_id", "loose_first", "loose_ns", "decode_ns")]
    t = all_.fillna(0, subset=ints).fillna(0.0, subset=["decode_ns"])
    bounded = F.coalesce((F.col("loose_events") >= 2) & (F.col("loose_ns") > 0), F.lit(False))
    tokens = F.col("decode_tokens") + F.when(bounded, F.col("loose_tokens") - F.col("loose_first")).otherwise(0)
    ns = F.col("decode_ns") + F.when(bounded, F.col("loose_ns")).otherwise(0)
    events_counted = F.col("span_token_events") + F.col("loose_events")
    provenance = (
        F.when((F.col("backend_spans") > 0) & (events_counted > 0), "mixed").when(F.col("backend_spans") > 0, "backend-reported")
        .when(events_counted > 0, "derived").otherwise("unavailable")
    )
    from_events = F.col("span_tokens") + F.col("loose_tokens")
    return t.select(
        "recording_id", (F.col("from_backend") + from_events).alias("total"), provenance.alias("provenance"), "from_backend",
        from_events.alias("from_events"), "chunks", "uncounted_requests",
        F.when(ns > 0, tokens / (ns / 1e9)).alias("overall_rate"), F.when(ns > 0, ns / 1e6).alias("active_decode_ms"),
        F.when(F.col("backend_spans") > 0, F.col("from_backend")).alias("backend_reported"),
    )


def recent_rate(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens per second over the trailing window that ends at the last event."""
    limits = bounds(events).select(
        "recording_id", "last_ns", F.least(F.lit(RECENT_NS), (F.col("last_ns") - F.col("first_ns")).cast("double")).alias("window_ns")
    )
    begin = F.col("last_ns") - F.col("window_ns")
    rows = token_rows(events, spans).where("n_tokens IS NOT NULL")
    counted = rows.where((F.col("place") == "loose") | ((F.col("place") == "span") & F.col("backend_tokens").isNull()))
    measured = counted.join(limits, "recording_id").groupBy("recording_id").agg(
        F.sum(F.when(F.col("mono_ns") > begin, F.col("n_tokens"))).cast("double").alias("tokens"), F.count(F.lit(1)).alias("evidence")
    )
    backend = spans.where("backend_tokens IS NOT NULL").join(limits, "recording_id")
    overlap = F.greatest(F.lit(0.0), F.least("decode.end_ns", F.col("last_ns").cast("double")) - F.greatest(F.col("decode.start_ns"), begin))
    spread = backend.groupBy("recording_id").agg(
        F.sum(F.when(F.col("decode.ns") > 0, F.col("decode.tokens") * overlap / F.col("decode.ns"))).alias("tokens"), F.count(F.lit(1)).alias("evidence")
    )
    total = measured.unionByName(spread).groupBy("recording_id").agg(F.sum("tokens").alias("tokens"), F.sum("evidence").alias("evidence"))
    known = (F.col("evidence") > 0) & (F.col("window_ns") > 0)
    return limits.join(total, "recording_id", "left").select(
        "recording_id",
        F.when(known, F.coalesce("tokens", F.lit(0.0)) / (F.col("window_ns") / 1e9)).alias("recent_rate"),
        (F.col("window_ns") / 1e6).alias("window_ms"),
    )


def errors_by_type(events: DataFrame) -> DataFrame:
    return events.where(is_error()).groupBy("recording_id", "event_type").agg(
        F.count(F.lit(1)).alias("errors"), F.min_by("event_id", ord_col()).alias("first_event_id"), F.max_by("event_id", ord_col()).alias("last_event_id")
    )


def error_ids(events: DataFrame) -> DataFrame:
    """The error events themselves, with the columns that put them in replay order."""
    return events.where(is_error()).select("recording_id", "event_id", "event_type", "mono_ns", "sequence")


_AGENT_ON = ("agent.spawned", "agent.started")
_AGENT_OFF = ("agent.completed", "agent.cancelled")


def active_agents(events: DataFrame) -> DataFrame:
    """Agents whose latest lifecycle event started them."""
    life = events.where(F.col("event_type").isin(*_AGENT_ON, *_AGENT_OFF) & R.filled("agent_id").isNotNull())
    last = life.groupBy("recording_id", "agent_id").agg(F.max_by("event_type", ord_col()).alias("state"))
    return last.where(F.col("state").isin(*_AGENT_ON)).select("recording_id", "agent_id")


def agent_counters(events: DataFrame) -> DataFrame:
    t, named = F.col("event_type"), R.filled("agent_id").isNotNull()
    moves = events.where(t.startswith("agent.") | t.startswith("route."))
    counts = moves.groupBy("recording_id").agg(
        F.count_if(named & (t == "agent.spawned")).alias("spawned"), F.count_if(named & (t == "agent.completed")).alias("completed"),
        F.count(F.lit(1)).alias("transitions"),
    )
    active = active_agents(events).groupBy("recording_id").agg(F.count(F.lit(1)).alias("active"))
    return counts.join(active, "recording_id", "left").fillna(0, ["active"])


def call_id(r: Readers) -> Column:
    """Call id of a tool event: the attribute (even when empty) before the envelope field."""
    return F.nullif(F.coalesce(r.text("tool_call_id"), r.extra_text("tool_call_id")), F.lit(""))


def active_tools(events: DataFrame) -> DataFrame:
    calls = events.where(F.col("event_type").isin("tool.called", "tool.completed", "tool.failed")).withColumn("call_id", call_id(Readers(events)))
    last = calls.where("call_id IS NOT NULL").groupBy("recording_id", "call_id").agg(F.max_by("event_type", ord_col()).alias("state"))
    return last.where("state = 'tool.called'").select("recording_id", "call_id")


def tool_counters(events: DataFrame) -> DataFrame:
    t = F.col("event_type")
    counts = events.where(t.isin("tool.called", "tool.completed", "tool.failed")).groupBy("recording_id").agg(
        *[F.count_if(t == f"tool.{name}").alias(name) for name in ("called", "completed", "failed")]
    )
    active = active_tools(events).groupBy("recording_id").agg(F.count(F.lit(1)).alias("active"))
    return counts.join(active, "recording_id", "left").fillna(0, ["active"])


def resource_counters(events: DataFrame) -> DataFrame:
    """Latest and first-highest memory sample, latest compute utilisation, pressure events."""
    r, t = Readers(events), F.col("event_type")
    used = events.where(t.isin("device.memory.sample", "device.compute.sample", "kv.pressure", "guard.budget_pressure"))
    usage = F.when(t == "device.memory.sample", R.memory_usage(r))
    load = F.when(t == "device.compute.sample", r.num("utilization"))
    read = used.select("recording_id", "mono_ns", "sequence", "event_id", "event_type", "device_id", usage.alias("u"), load.alias("load"))
    rows = read.select("*", F.when(F.col("u.used").isNotNull(), F.col("u.fraction")).alias("fraction"))
    sample = F.struct("event_id", "device_id", "u")
    usable = F.col("fraction").isNotNull()
    folded = rows.groupBy("recording_id").agg(
        F.max_by(sample, F.when(usable, ord_col())).alias("latest"),
        F.max("fraction").alias("peak_fraction"),
        F.max_by("load", F.when(F.col("load").isNotNull(), ord_col())).alias("latest_compute_utilization"),
        F.count_if(F.col("event_type").isin("kv.pressure", "guard.budget_pressure")).alias("pressure_events"),
    )
    highest = rows.where(usable).join(folded.select("recording_id", "peak_fraction"), "recording_id").where(F.col("fraction") == F.col("peak_fraction"))
    peak = highest.groupBy("recording_id").agg(F.min_by("event_id", ord_col()).alias("peak_event_id"))
    return folded.join(peak, "recording_id", "left").select(
        "recording_id", F.col("latest.event_id").alias("latest_event_id"), F.col("latest.u.fraction").alias("latest_fraction"),
        F.col("latest.u.used").alias("latest_used_bytes"), F.col("latest.device_id").alias("latest_device_id"),
        "peak_event_id", "peak_fraction", "latest_compute_utilization", "pressure_events",
    )


def dropped_by_stream(events: DataFrame) -> DataFrame:
    """Latest positive cumulative drop report of every producer stream."""
    n = R.dropped_count(Readers(events))
    reports = with_stream(events.where(F.col("event_type") == "telemetry.dropped").withColumn("n", n)).where("n IS NOT NULL")
    return reports.groupBy("recording_id", "stream").agg(F.max_by("n", ord_col()).alias("dropped"))


def dropped_total(events: DataFrame) -> DataFrame:
    return dropped_by_stream(events).groupBy("recording_id").agg(F.sum("dropped").alias("dropped_events"))


_SETS = "((recording_id), (recording_id, model_name), (recording_id, session_id))"
_LEVELS = "CASE grouping_id() WHEN 3 THEN 'all' WHEN 1 THEN 'model' ELSE 'session' END AS level"


def _grouping(spans: DataFrame, aggregates: str, reported: str) -> DataFrame:
    named = spans.withColumn("model_name", F.coalesce("model", F.lit(UNKNOWN_MODEL)))
    return spans.sparkSession.sql(
        f"""SELECT recording_id, {_LEVELS}, CASE WHEN grouping_id() = 3 THEN 'all' ELSE coalesce(model_name, session_id) END AS grp, {aggregates}
        FROM {{spans}} GROUP BY GROUPING SETS {_SETS} HAVING grouping_id() = 3 OR count({reported}) > 0""",
        spans=named,
    )


def prompt_cache_totals(spans: DataFrame) -> DataFrame:
    """Cache reuse of each recording, model and session; requests without a report are counted apart."""
    return _grouping(
        spans,
        """count(cache_prompt_tokens) AS requests, coalesce(sum(cache_prompt_tokens), 0) AS prompt_tokens,
        coalesce(sum(cache_cached_tokens), 0) AS cached_tokens, coalesce(sum(cache_evaluated_tokens), 0) AS evaluated_tokens,
        CASE WHEN sum(cache_prompt_tokens) > 0 THEN sum(cache_cached_tokens) / sum(cache_prompt_tokens) END AS hit_ratio,
        count_if(cache_prompt_tokens IS NULL AND outcome <> 'open') AS unreported_requests""",
        "cache_prompt_tokens",
    )


def speculation_totals(spans: DataFrame) -> DataFrame:
    return _grouping(
        spans,
        """count(spec_draft_tokens) AS requests, coalesce(sum(spec_draft_tokens), 0) AS draft_tokens,
        coalesce(sum(spec_accepted_tokens), 0) AS accepted_tokens,
        CASE WHEN sum(spec_draft_tokens) > 0 THEN sum(spec_accepted_tokens) / sum(spec_draft_tokens) END AS acceptance_rate,
        CASE WHEN count(spec_draft_tokens) > 0 THEN sum(spec_accepted_tokens) / count(spec_draft_tokens) END AS accepted_per_request""",
        "spec_draft_tokens",
    )


def cursor_counters(events: DataFrame) -> DataFrame:
    """Counter state right after every event that changes one."""
    t, named = F.col("event_type"), R.filled("agent_id").isNotNull()
    rows = events.where(
        t.startswith("agent.") | t.startswith("route.") | t.isin("tool.called", "tool.completed", "tool.failed", "kv.pressure", "guard.budget_pressure")
    ).select("recording_id", "mono_ns", "sequence", "event_id", "event_type", "agent_id")
    on = F.when(t.isin(*_AGENT_ON) & named, 1).when(t.isin(*_AGENT_OFF) & named, 0)
    held = rows.withColumn("on", on).withColumn("who", F.coalesce(R.filled("agent_id"), F.lit("")))
    prior = running(held, ["recording_id", "who"], [Scan("was", "last", F.col("on"), inclusive=False)])
    step = prior.withColumn("active_step", F.coalesce(F.col("on") - F.coalesce("was", F.lit(0)), F.lit(0)))
    one = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return running(
        step,
        ["recording_id"],
        [
            Scan("transitions", "sum", one(t.startswith("agent.") | t.startswith("route."))),
            Scan("spawned", "sum", one(named & (t == "agent.spawned"))),
            Scan("completed", "sum", one(named & (t == "agent.completed"))),
            Scan("active", "sum", F.col("active_step").cast("bigint")),
            *[Scan(f"tools_{n}", "sum", one(t == f"tool.{n}")) for n in ("called", "completed", "failed")],
            Scan("pressure_events", "sum", one(t.isin("kv.pressure", "guard.budget_pressure"))),
        ],
    ).drop("on", "was", "who", "active_step", "agent_id")
