"""Core view: identity, readers, spans, metrics, replay and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconlake.functions import classify, identity
from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.operators import metrics as M
from beaconlake.operators import replay
from beaconlake.operators.spans import request_spans
from beaconlake.plans import driver_tables as dt
from beaconlake.plans import oracle_core as O
from beaconlake.plans.registry import DUCK_CLASS, DUCK_ERROR, DUCK_INSTANCE, query, r6

core = dt.core_events
EV, BASE, SPANS = O.EV, O.BASE, O.SPANS


@query("src_parquet_events", f"{EV} SELECT recording_id, event_id, sequence, event_type, mono_ns, session_id, p_name AS producer_name, request_id FROM ev")
def src_parquet_events(spark, d):
    return core(spark, d).select("recording_id", "event_id", "sequence", "event_type", "mono_ns", "session_id", F.col("producer.name").alias("producer_name"), "request_id")


@query("classify_event", f"{EV} SELECT event_id, {DUCK_CLASS} AS cls FROM ev")
def classify_event(spark, d):
    return core(spark, d).select("event_id", classify.event_class().alias("cls"))


@query("is_error", f"{EV} SELECT event_id, {DUCK_ERROR} AS is_error FROM ev")
def is_error(spark, d):
    return core(spark, d).select("event_id", classify.is_error().alias("is_error"))


@query("producer_instance", f"{EV} SELECT event_id, {DUCK_INSTANCE} AS instance FROM ev")
def producer_instance(spark, d):
    return core(spark, d).select("event_id", identity.producer_instance().alias("instance"))


@query("stream_key", f"{BASE} SELECT event_id, stream FROM y")
def stream_key(spark, d):
    return core(spark, d).select("event_id", identity.stream_key().alias("stream"))


@query("request_key", f"{BASE} SELECT event_id, CASE WHEN request_id IS NOT NULL THEN CAST(to_json(['request', stream, request_id]) AS STRING) END AS request_key FROM y")
def request_key(spark, d):
    return core(spark, d).select("event_id", identity.request_key().alias("request_key"))


@query("session_key", f"{BASE} SELECT event_id, CAST(to_json(['stream-session-scope', stream, session_id]) AS STRING) AS session_key FROM y")
def session_key(spark, d):
    return core(spark, d).select("event_id", identity.session_key().alias("session_key"))


@query("stream_label", f"{EV} SELECT event_id, p_name || ' @ ' || p_node_id AS label FROM ev")
def stream_label(spark, d):
    return core(spark, d).select("event_id", identity.stream_label(identity.stream_key()).alias("label"))


@query(
    "memory_usage",
    f"""{EV}, m AS (SELECT event_id, CASE WHEN a_used_bytes IS NOT NULL AND a_total_bytes > 0 THEN 'used_bytes'
 WHEN a_total_bytes > 0 AND a_available_bytes BETWEEN 0 AND a_total_bytes THEN 'available_bytes' WHEN a_used_fraction IS NOT NULL THEN 'used_fraction' END AS source,
 a_used_bytes AS u, a_total_bytes AS t, a_available_bytes AS a, a_used_fraction AS f FROM ev)
 SELECT event_id, source, ROUND(CASE source WHEN 'used_bytes' THEN u WHEN 'available_bytes' THEN t - a END, 6) AS used,
 ROUND(CASE source WHEN 'used_bytes' THEN u / t WHEN 'available_bytes' THEN (t - a) / t ELSE f END, 6) AS fraction FROM m""",
)
def memory_usage(spark, d):
    ev = core(spark, d)
    return ev.select("event_id", R.memory_usage(Readers(ev)).alias("u")).select("event_id", "u.source", r6("u.used", "used"), r6("u.fraction", "fraction"))


@query(
    "token_readers",
    f"""{BASE} SELECT event_id, CAST(CASE WHEN COALESCE(a_dropped_count, a_dropped_events) > 0 THEN COALESCE(a_dropped_count, a_dropped_events) END AS DOUBLE) AS dropped,
 backend_n AS backend_tokens, n_tok AS output_tokens, ROUND(eval_ms, 6) AS eval_ms, event_type = 'model.load.completed' AND request_id IS NOT NULL AS scoped_load FROM y""",
)
def token_readers(spark, d):
    ev = core(spark, d)
    r = Readers(ev)
    output = F.when(F.col("event_type") == "inference.token.generated", R.output_token_count(r))
    return ev.select(
        "event_id", R.dropped_count(r).alias("dropped"), R.backend_token_count(r).alias("backend_tokens"), output.alias("output_tokens"),
        r6(R.backend_eval_ms(r), "eval_ms"), R.is_request_scoped_load().alias("scoped_load"),
    )


@query("prompt_cache_report", f"{BASE} SELECT event_id, c_prompt AS prompt, c_cached AS cached, c_prompt - c_cached AS evaluated, c_source AS source FROM y WHERE cache_k IS NOT NULL")
def prompt_cache_report(spark, d):
    ev = core(spark, d)
    return ev.select("event_id", R.prompt_cache_report(Readers(ev)).alias("c")).where("c IS NOT NULL").select("event_id", "c.*")


@query("speculation_report", f"{BASE} SELECT event_id, s_draft AS drafted, s_acc AS accepted, s_source AS source FROM y WHERE spec_k IS NOT NULL")
def speculation_report(spark, d):
    ev = core(spark, d)
    return ev.select("event_id", R.speculation_report(Readers(ev)).alias("s")).where("s IS NOT NULL").select("event_id", "s.*")


@query(
    "compare_readers",
    f"""{BASE} SELECT event_id, turn_id, CAST(COALESCE(a_prompt_tokens, a_prompt_eval_count) AS DOUBLE) AS prompt_tokens,
 CAST(a_completion_tokens AS DOUBLE) AS completion_tokens,
 CASE WHEN event_type = 'inference.decode.completed' AND a_decode_tokens_per_sec > 0 THEN a_decode_tokens_per_sec END AS decode_rate,
 a_cost_usd AS cost_usd, CASE WHEN a_cost_budget_usd > 0 THEN a_cost_budget_usd END AS cost_budget_usd,
 ROUND(CASE WHEN event_type = 'guard.budget_pressure' AND a_used_fraction >= 0 THEN a_used_fraction END, 6) AS budget_fraction,
 CASE event_type WHEN 'kv.reused' THEN 'hit' WHEN 'kv.allocated' THEN 'miss' END AS cache_lookup FROM y""",
)
def compare_readers(spark, d):
    ev = core(spark, d)
    r = Readers(ev)
    return ev.select(
        "event_id", R.turn_id(r).alias("turn_id"), R.prompt_tokens(r).alias("prompt_tokens"), R.reported_completion_tokens(r).alias("completion_tokens"),
        R.reported_decode_rate(r).alias("decode_rate"), R.cost_usd(r).alias("cost_usd"), R.cost_budget_usd(r).alias("cost_budget_usd"),
        r6(R.budget_pressure_fraction(r), "budget_fraction"), R.cache_lookup().alias("cache_lookup"),
    )


@query(
    "search_text",
    f"""{EV} SELECT event_id, lower(event_type || ' ' || event_id || ' ' || COALESCE(request_id, '') || ' ' || COALESCE(run_id, '') || ' ' || COALESCE(agent_id, '') || ' ' || p_name) AS table_text,
 lower(event_type || ' ' || event_id || ' ' || COALESCE(request_id, '') || ' ' || COALESCE(agent_id, '')) AS export_text FROM ev""",
)
def search_text(spark, d):
    return core(spark, d).select("event_id", R.table_search_text().alias("table_text"), R.export_search_text().alias("export_text"))


@query(
    "request_spans",
    f"""{SPANS} SELECT recording_id, stream, request_id, producer, session_id, start_ns, end_ns, outcome, first_token_ns, last_token_ns, tokens, token_events, chunks,
 backend_tokens, token_count, ROUND(total_ms, 6) AS total_ms, ROUND(ttft_ms, 6) AS ttft_ms, ROUND(eval_ms, 6) AS eval_ms, model, c_prompt AS cache_prompt_tokens,
 c_cached AS cache_cached_tokens, c_source AS cache_source, c_event AS cache_event_id, s_draft AS spec_draft_tokens, s_acc AS spec_accepted_tokens, s_event AS spec_event_id FROM spans""",
)
def spans_query(spark, d):
    return request_spans(core(spark, d)).select(
        "recording_id", "stream", "request_id", "producer", "session_id", "start_ns", "end_ns", "outcome", "first_token_ns", "last_token_ns", "tokens",
        "token_events", "chunks", "backend_tokens", "token_count", r6("total_ms"), r6("ttft_ms"), r6("eval_ms"), "model", "cache_prompt_tokens",
        "cache_cached_tokens", "cache_source", "cache_event_id", "spec_draft_tokens", "spec_accepted_tokens", "spec_event_id",
    )


@query("decode_windows", f"{SPANS} SELECT recording_id, stream, request_id, dsrc AS source, d_tokens AS tokens, ROUND(d_ns, 6) AS ns, ROUND(d_end, 6) AS end_ns FROM spans WHERE dsrc IS NOT NULL")
def decode_windows(spark, d):
    spans = request_spans(core(spark, d)).where("decode IS NOT NULL")
    return spans.select("recording_id", "stream", "request_id", "decode.source", "decode.tokens", r6("decode.ns", "ns"), r6(F.round("decode.end_ns", 3), "end_ns"))


def _latency_sql(frm: str, keys: str, ns: str) -> str:
    return f""", d AS (SELECT {keys}, {ns} AS ns FROM {frm} WHERE {ns} IS NOT NULL), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY ns) AS i, COUNT(*) OVER (PARTITION BY {keys}) AS n FROM d)
 SELECT {keys}, COUNT(*) AS count, ROUND(MIN(CASE WHEN i >= ceil(0.5::DOUBLE * n) THEN ns END) / 1000000.0::DOUBLE, 6) AS p50_ms,
 ROUND(MIN(CASE WHEN i >= ceil(0.95::DOUBLE * n) THEN ns END) / 1000000.0::DOUBLE, 6) AS p95_ms, ROUND(MAX(ns) / 1000000.0::DOUBLE, 6) AS max_ms FROM rk GROUP BY {keys}"""


def _latency_cols(df, *keys):
    return df.select(*keys, "count", r6("p50_ms"), r6("p95_ms"), r6("max_ms"))


@query("latency_stats", SPANS + _latency_sql("spans", "recording_id", "(end_ns - start_ns)"))
def latency_stats(spark, d):
    return _latency_cols(M.latency_stats(request_spans(core(spark, d))), "recording_id")


@query("latency_stats_by_producer", SPANS + _latency_sql("spans", "recording_id, producer", "(end_ns - start_ns)"))
def latency_stats_by_producer(spark, d):
    return _latency_cols(M.latency_stats(request_spans(core(spark, d)), ["producer"]), "recording_id", "producer")


@query("ttft_stats", SPANS + _latency_sql("spans", "recording_id", "(first_token_ns - start_ns)"))
def ttft_stats(spark, d):
    return _latency_cols(M.ttft_stats(request_spans(core(spark, d))), "recording_id")


@query(
    "token_totals",
    f"""{SPANS}{O.LOOSE}, a AS (SELECT recording_id, COALESCE(SUM(backend_tokens), 0) AS fb, COUNT(backend_tokens) AS bs,
 COALESCE(SUM(CASE WHEN backend_tokens IS NULL AND token_count IS NOT NULL THEN tokens END), 0) AS st, COALESCE(SUM(CASE WHEN backend_tokens IS NULL AND token_count IS NOT NULL THEN token_events END), 0) AS se,
 COUNT(*) FILTER (token_count IS NULL) AS uncounted, COALESCE(SUM(d_tokens), 0) AS dt, COALESCE(SUM(d_ns), 0) AS dn FROM spans GROUP BY 1),
 b AS (SELECT recording_id, COUNT(*) AS le, SUM(n_tok) AS lt, arg_min(n_tok, mono_ns) AS lf, MAX(mono_ns) - MIN(mono_ns) AS ln FROM loose GROUP BY 1),
 c AS (SELECT recording_id, COUNT(*) FILTER (is_out AND n_tok IS NULL) AS chunks FROM y GROUP BY 1),
 j AS (SELECT c.recording_id, chunks, COALESCE(fb, 0) AS fb, COALESCE(bs, 0) AS bs, COALESCE(st, 0) AS st, COALESCE(se, 0) AS se, COALESCE(uncounted, 0) AS un,
  COALESCE(dt, 0) + CASE WHEN le >= 2 AND ln > 0 THEN lt - lf ELSE 0 END AS dt, COALESCE(dn, 0) + CASE WHEN le >= 2 AND ln > 0 THEN ln ELSE 0 END AS dn, COALESCE(le, 0) AS le, COALESCE(lt, 0) AS lt
  FROM c LEFT JOIN a USING (recording_id) LEFT JOIN b USING (recording_id))
 SELECT recording_id, CAST(fb + st + lt AS BIGINT) AS total, CASE WHEN bs > 0 AND se + le > 0 THEN 'mixed' WHEN bs > 0 THEN 'backend-reported' WHEN se + le > 0 THEN 'derived' ELSE 'unavailable' END AS provenance,
 CAST(fb AS BIGINT) AS from_backend, CAST(st + lt AS BIGINT) AS from_events, CAST(chunks AS BIGINT) AS chunks, CAST(un AS BIGINT) AS uncounted_requests,
 ROUND(CASE WHEN dn > 0 THEN dt / (dn / 1000000000.0::DOUBLE) END, 6) AS overall_rate, ROUND(CASE WHEN dn > 0 THEN dn / 1000000.0::DOUBLE END, 4) AS active_decode_ms,
 CAST(CASE WHEN bs > 0 THEN fb END AS BIGINT) AS backend_reported FROM j""",
)
def token_totals(spark, d):
    ev = core(spark, d)
    out = M.token_totals(ev, request_spans(ev))
    return out.withColumn("overall_rate", r6("overall_rate")).withColumn("active_decode_ms", F.round("active_decode_ms", 4))


@query(
    "recent_rate",
    f"""{SPANS}{O.LOOSE}, lim AS (SELECT recording_id, MAX(mono_ns) AS hi, LEAST(5000000000.0::DOUBLE, CAST(MAX(mono_ns) - MIN(mono_ns) AS DOUBLE)) AS w FROM y GROUP BY 1),
 tok AS (SELECT recording_id, mono_ns, n_tok FROM loose UNION ALL SELECT c.recording_id, c.mono_ns, c.n_tok FROM cur c JOIN spans s USING (recording_id, stream, request_id)
  WHERE c.n_tok IS NOT NULL AND s.backend_tokens IS NULL),
 a AS (SELECT recording_id, SUM(CASE WHEN mono_ns > hi - w THEN n_tok END) AS t, COUNT(*) AS n FROM tok JOIN lim USING (recording_id) GROUP BY 1),
 b AS (SELECT recording_id, SUM(CASE WHEN d_ns > 0 THEN d_tokens * GREATEST(0.0::DOUBLE, LEAST(d_end, hi) - GREATEST(d_end - d_ns, hi - w)) / d_ns END) AS t, COUNT(*) AS n
  FROM spans JOIN lim USING (recording_id) WHERE backend_tokens IS NOT NULL GROUP BY 1)
 SELECT recording_id, ROUND(CASE WHEN COALESCE(a.n, 0) + COALESCE(b.n, 0) > 0 AND w > 0 THEN (COALESCE(a.t, 0) + COALESCE(b.t, 0)) / (w / 1000000000.0::DOUBLE) END, 5) AS recent_rate, w / 1000000.0::DOUBLE AS window_ms
 FROM lim LEFT JOIN a USING (recording_id) LEFT JOIN b USING (recording_id)""",
)
def recent_rate(spark, d):
    ev = core(spark, d)
    return M.recent_rate(ev, request_spans(ev)).withColumn("recent_rate", F.round("recent_rate", 5))


@query(
    "errors_summary",
    f"{EV} SELECT recording_id, event_type, COUNT(*) AS errors, arg_min(event_id, mono_ns) AS first_event_id, arg_max(event_id, mono_ns) AS last_event_id FROM ev WHERE {DUCK_ERROR} GROUP BY 1, 2",
)
def errors_summary(spark, d):
    return M.errors_by_type(core(spark, d))


_AGENT_STATE = """st AS (SELECT recording_id, agent_id, arg_max(event_type, mono_ns) AS s FROM ev WHERE agent_id IS NOT NULL
 AND event_type IN ('agent.spawned', 'agent.started', 'agent.completed', 'agent.cancelled') GROUP BY 1, 2)"""


@query(
    "agent_counters",
    f"""{EV}, {_AGENT_STATE} SELECT e.recording_id, COUNT(*) FILTER (event_type = 'agent.spawned' AND agent_id IS NOT NULL) AS spawned,
 COUNT(*) FILTER (event_type = 'agent.completed' AND agent_id IS NOT NULL) AS completed, COUNT(*) AS transitions,
 (SELECT COUNT(*) FROM st WHERE st.recording_id = e.recording_id AND s IN ('agent.spawned', 'agent.started')) AS active
 FROM ev e WHERE event_type LIKE 'agent.%' OR event_type LIKE 'route.%' GROUP BY e.recording_id""",
)
def agent_counters(spark, d):
    return M.agent_counters(core(spark, d))


@query(
    "tool_counters",
    f"""{EV}, st AS (SELECT recording_id, a_tool_call_id, arg_max(event_type, mono_ns) AS s FROM ev WHERE a_tool_call_id IS NOT NULL AND event_type IN ('tool.called', 'tool.completed', 'tool.failed') GROUP BY 1, 2)
 SELECT e.recording_id, COUNT(*) FILTER (event_type = 'tool.called') AS called, COUNT(*) FILTER (event_type = 'tool.completed') AS completed, COUNT(*) FILTER (event_type = 'tool.failed') AS failed,
 (SELECT COUNT(*) FROM st WHERE st.recording_id = e.recording_id AND s = 'tool.called') AS active FROM ev e WHERE event_type IN ('tool.called', 'tool.completed', 'tool.failed') GROUP BY e.recording_id""",
)
def tool_counters(spark, d):
    return M.tool_counters(core(spark, d))


@query(
    "resource_counters",
    f"""{EV}, m AS (SELECT *, CASE WHEN a_used_bytes IS NOT NULL AND a_total_bytes > 0 THEN a_used_bytes WHEN a_total_bytes > 0 AND a_available_bytes BETWEEN 0 AND a_total_bytes THEN a_total_bytes - a_available_bytes END AS u FROM ev),
 s AS (SELECT *, u / a_total_bytes AS f FROM m WHERE event_type = 'device.memory.sample' AND u IS NOT NULL),
 l AS (SELECT recording_id, arg_max(event_id, mono_ns) AS latest_event_id, ROUND(arg_max(f, mono_ns), 6) AS latest_fraction, ROUND(arg_max(u, mono_ns), 6) AS latest_used_bytes,
  NULLIF(arg_max(COALESCE(device_id, ''), mono_ns), '') AS latest_device_id, MAX(f) AS peak FROM s GROUP BY 1),
 p AS (SELECT s.recording_id, arg_min(event_id, mono_ns) AS peak_event_id FROM s JOIN l ON l.recording_id = s.recording_id AND s.f = l.peak GROUP BY 1),
 c AS (SELECT recording_id, arg_max(a_utilization, mono_ns) AS cu FROM ev WHERE event_type = 'device.compute.sample' AND a_utilization IS NOT NULL GROUP BY 1),
 n AS (SELECT recording_id, COUNT(*) FILTER (event_type IN ('kv.pressure', 'guard.budget_pressure')) AS pressure_events FROM ev
  WHERE event_type IN ('device.memory.sample', 'device.compute.sample', 'kv.pressure', 'guard.budget_pressure') GROUP BY 1)
 SELECT recording_id, latest_event_id, latest_fraction, latest_used_bytes, latest_device_id, peak_event_id, ROUND(peak, 6) AS peak_fraction, ROUND(cu, 6) AS latest_compute_utilization, pressure_events
 FROM n LEFT JOIN l USING (recording_id) LEFT JOIN p USING (recording_id) LEFT JOIN c USING (recording_id)""",
)
def resource_counters(spark, d):
    out = M.resource_counters(core(spark, d))
    return out.select(
        "recording_id", "latest_event_id", r6("latest_fraction"), r6("latest_used_bytes"), "latest_device_id", "peak_event_id", r6("peak_fraction"),
        r6("latest_compute_utilization"), "pressure_events",
    )


@query(
    "dropped_total",
    f"""{BASE}, r AS (SELECT recording_id, stream, mono_ns, COALESCE(a_dropped_count, a_dropped_events) AS n FROM y WHERE event_type = 'telemetry.dropped'),
 l AS (SELECT recording_id, stream, arg_max(n, mono_ns) AS n FROM r WHERE n > 0 GROUP BY 1, 2) SELECT recording_id, CAST(SUM(n) AS DOUBLE) AS dropped_events FROM l GROUP BY 1""",
)
def dropped_total(spark, d):
    return M.dropped_total(core(spark, d))


def _sets(aggregates: str, reported: str) -> str:
    cols = "recording_id, model_name, session_id"
    return f""", g AS (SELECT *, COALESCE(model, '(model not reported)') AS model_name FROM spans)
 SELECT recording_id, 'all' AS level, 'all' AS grp, {aggregates} FROM g GROUP BY recording_id
 UNION ALL SELECT recording_id, 'model', model_name, {aggregates} FROM g GROUP BY recording_id, model_name HAVING COUNT({reported}) > 0
 UNION ALL SELECT recording_id, 'session', session_id, {aggregates} FROM g GROUP BY recording_id, session_id HAVING COUNT({reported}) > 0"""


@query(
    "prompt_cache_totals",
    SPANS
    + _sets(
        """COUNT(c_prompt) AS requests, CAST(COALESCE(SUM(c_prompt), 0) AS BIGINT) AS prompt_tokens, CAST(COALESCE(SUM(c_cached), 0) AS BIGINT) AS cached_tokens,
 CAST(COALESCE(SUM(c_prompt - c_cached), 0) AS BIGINT) AS evaluated_tokens, ROUND(CASE WHEN SUM(c_prompt) > 0 THEN SUM(c_cached) / SUM(c_prompt) END, 6) AS hit_ratio,
 COUNT(*) FILTER (c_prompt IS NULL AND outcome <> 'open') AS unreported_requests""",
        "c_prompt",
    ),
)
def prompt_cache_totals(spark, d):
    return M.prompt_cache_totals(request_spans(core(spark, d))).withColumn("hit_ratio", r6("hit_ratio"))


@query(
    "speculation_totals",
    SPANS
    + _sets(
        """COUNT(s_draft) AS requests, CAST(COALESCE(SUM(s_draft), 0) AS BIGINT) AS draft_tokens, CAST(COALESCE(SUM(s_acc), 0) AS BIGINT) AS accepted_tokens,
 ROUND(CASE WHEN SUM(s_draft) > 0 THEN SUM(s_acc) / SUM(s_draft) END, 6) AS acceptance_rate, ROUND(CASE WHEN COUNT(s_draft) > 0 THEN SUM(s_acc) / COUNT(s_draft) END, 6) AS accepted_per_request""",
        "s_draft",
    ),
)
def speculation_totals(spark, d):
    return M.speculation_totals(request_spans(core(spark, d))).withColumn("acceptance_rate", r6("acceptance_rate")).withColumn("accepted_per_request", r6("accepted_per_request"))


@query(
    "cursor_counters",
    f"""{EV}, f AS (SELECT *, event_type LIKE 'agent.%' OR event_type LIKE 'route.%' AS tr, CASE WHEN agent_id IS NULL THEN NULL WHEN event_type IN ('agent.spawned', 'agent.started') THEN 1
  WHEN event_type IN ('agent.completed', 'agent.cancelled') THEN 0 END AS live FROM ev),
 g AS (SELECT *, COALESCE(live - COALESCE(LAG(live) OVER (PARTITION BY recording_id, agent_id, live IS NULL ORDER BY mono_ns), 0), 0) AS step FROM f
  WHERE tr OR event_type IN ('tool.called', 'tool.completed', 'tool.failed', 'kv.pressure', 'guard.budget_pressure'))
 SELECT recording_id, mono_ns, sequence, event_id, event_type, CAST(SUM(CASE WHEN tr THEN 1 ELSE 0 END) OVER w AS BIGINT) AS transitions,
 CAST(SUM(CASE WHEN event_type = 'agent.spawned' AND agent_id IS NOT NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS spawned,
 CAST(SUM(CASE WHEN event_type = 'agent.completed' AND agent_id IS NOT NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS completed, CAST(SUM(step) OVER w AS BIGINT) AS active,
 CAST(SUM(CASE WHEN event_type = 'tool.called' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tools_called, CAST(SUM(CASE WHEN event_type = 'tool.completed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tools_completed,
 CAST(SUM(CASE WHEN event_type = 'tool.failed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tools_failed,
 CAST(SUM(CASE WHEN event_type IN ('kv.pressure', 'guard.budget_pressure') THEN 1 ELSE 0 END) OVER w AS BIGINT) AS pressure_events
 FROM g WINDOW w AS (PARTITION BY recording_id ORDER BY mono_ns)""",
)
def cursor_counters(spark, d):
    return M.cursor_counters(core(spark, d))


# -- replay -------------------------------------------------------------------


def _deliveries(spark, d):
    """The events, and once more those of the error rows as a later delivery."""
    ev = core(spark, d).withColumn("delivery", F.lit(0))
    again = ev.where(classify.is_error()).withColumn("delivery", F.lit(1)).withColumn("wall_time", F.lit("again"))
    return ev.unionByName(again)


@query("dedupe_events", f"{EV} SELECT recording_id, event_id, wall_time, 0 AS delivery, CASE WHEN {DUCK_ERROR} THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS duplicates FROM ev")
def dedupe_events(spark, d):
    return replay.dedupe_events(_deliveries(spark, d), ("delivery", "sequence")).select("recording_id", "event_id", "wall_time", "delivery", "duplicates")


@query("sequence_gaps", f"""{BASE}, g AS (SELECT recording_id, stream, sequence, LAG(sequence) OVER (PARTITION BY recording_id, stream ORDER BY sequence) AS p FROM (SELECT DISTINCT recording_id, stream, sequence FROM y))
 SELECT recording_id, stream, p + 1 AS from_seq, sequence - 1 AS to_seq FROM g WHERE sequence > p + 1""")
def sequence_gaps(spark, d):
    return replay.sequence_gaps(core(spark, d))


@query("replay_order", f"{EV} SELECT recording_id, event_id, mono_ns, sequence FROM ev ORDER BY recording_id, mono_ns, sequence, event_id")
def replay_order(spark, d):
    return replay.replay_order(core(spark, d).select("recording_id", "event_id", "mono_ns", "sequence"))


@query("merge_batches", f"{EV} SELECT recording_id, event_id, mono_ns FROM ev")
def merge_batches(spark, d):
    all_ = _deliveries(spark, d)
    half = F.lit(1_296_000_000_000)
    history = all_.where((F.col("mono_ns") < half) & (F.col("delivery") == 0))
    return replay.merge_batches(history, all_.where((F.col("mono_ns") >= half) | (F.col("delivery") == 1)), ("delivery", "sequence")).select("recording_id", "event_id", "mono_ns")


@query("as_of", f"""{EV} SELECT e.recording_id, event_id FROM ev e JOIN (SELECT recording_id, MIN(mono_ns) AS lo, MAX(mono_ns) AS hi FROM ev GROUP BY 1) b USING (recording_id)
 WHERE mono_ns <= lo + LEAST(GREATEST(0, 1000000000000), hi - lo)""")
def as_of(spark, d):
    return replay.as_of(core(spark, d), 1_000_000_000_000).select("recording_id", "event_id")


@query("next_matching", f"""{EV} SELECT recording_id, event_id, LAST_VALUE(CASE WHEN {DUCK_ERROR} THEN event_id END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY mono_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_id,
 FIRST_VALUE(CASE WHEN {DUCK_ERROR} THEN event_id END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY mono_ns ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM ev""")
def next_matching(spark, d):
    return replay.neighbours(core(spark, d), classify.is_error()).select("recording_id", "event_id", "previous_id", "next_id")


@query("next_matching_at", f"{EV} SELECT recording_id, arg_min(event_id, mono_ns) AS event_id FROM ev WHERE {DUCK_ERROR} AND mono_ns > 1000000000000 GROUP BY 1")
def next_matching_at(spark, d):
    return replay.next_matching(core(spark, d), classify.is_error(), 1_000_000_000_000)


@query("nearest_event", f"""{EV}, t AS (SELECT recording_id, CAST(floor(mono_ns / 20000000000.0::DOUBLE) AS BIGINT) * 20000000000 AS target_ns FROM ev GROUP BY 1, 2), e AS (SELECT * FROM ev WHERE {DUCK_CLASS} = 'error'),
 l AS (SELECT t.recording_id, target_ns, e.event_id AS li, e.mono_ns AS ln FROM t ASOF LEFT JOIN e ON e.recording_id = t.recording_id AND e.mono_ns < t.target_ns),
 r AS (SELECT t.recording_id, target_ns, e.event_id AS ri, e.mono_ns AS rn FROM t ASOF LEFT JOIN e ON e.recording_id = t.recording_id AND e.mono_ns >= t.target_ns)
 SELECT recording_id, target_ns, CASE WHEN rn IS NULL OR target_ns - ln <= rn - target_ns THEN li ELSE ri END AS event_id,
 CASE WHEN rn IS NULL OR target_ns - ln <= rn - target_ns THEN target_ns - ln ELSE rn - target_ns END AS distance_ns FROM l JOIN r USING (recording_id, target_ns)""")
def nearest_event(spark, d):
    ev = core(spark, d)
    marks = ev.select("recording_id", (F.floor(F.col("mono_ns") / F.lit(20_000_000_000)) * F.lit(20_000_000_000)).cast("bigint").alias("target_ns"))
    return replay.nearest_events(ev.where(classify.event_class() == "error"), marks)


@query("filter_range", f"""{EV} SELECT recording_id, event_id FROM ev WHERE {DUCK_CLASS} = 'error' AND contains(lower(event_type || ' ' || event_id || ' ' || COALESCE(request_id, '') || ' ' || COALESCE(agent_id, '')), 'tool')
 AND mono_ns BETWEEN 200000000000 AND 2000000000000""")
def filter_range(spark, d):
    return replay.filter_range(core(spark, d), "error", "  Tool ", 200_000_000_000, 2_000_000_000_000).select("recording_id", "event_id")


@query("filter_table", f"""{EV} SELECT recording_id, event_id FROM ev WHERE {DUCK_CLASS} = 'request' AND contains(lower(event_type || ' ' || event_id || ' ' || COALESCE(request_id, '') || ' ' || COALESCE(run_id, '') || ' ' || COALESCE(agent_id, '') || ' ' || p_name), 'run3')""")
def filter_table(spark, d):
    return replay.filter_table(core(spark, d), "request", "run3").select("recording_id", "event_id")


@query("class_counts", f"{EV} SELECT recording_id, {DUCK_CLASS} AS cls, COUNT(*) AS events, COUNT(*) FILTER ({DUCK_ERROR}) AS errors FROM ev GROUP BY 1, 2")
def class_counts(spark, d):
    return replay.class_counts(core(spark, d))
