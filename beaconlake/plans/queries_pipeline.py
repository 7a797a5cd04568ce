"""Request pipeline over the pipe view."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconlake.operators import pipeline as P
from beaconlake.plans import driver_tables as dt
from beaconlake.plans.registry import DUCK_STREAM, query, r6

pipe = dt.pipe_events

# Roles stated by a producer are the same on all its events in this view; a stream belongs to one producer.
PIPE = f"""{dt.duck_with('pipe')}, s0 AS (SELECT *, {DUCK_STREAM} AS stream FROM ev), s1 AS (SELECT *, LAST_VALUE(p_role IGNORE NULLS) OVER w AS role, bool_or(COALESCE(p_synthetic, FALSE)) OVER w AS syn FROM s0 WINDOW w AS (PARTITION BY recording_id, stream ORDER BY mono_ns)),
 s2 AS (SELECT *, COALESCE(role, '') = 'runtime' AS rtm FROM s1),
 s3 AS (SELECT *, CASE WHEN event_type IN ('request.completed', 'request.failed', 'request.cancelled') THEN 'output' WHEN event_type LIKE 'route.%' THEN 'route' WHEN rtm THEN CASE WHEN event_type = 'request.started' THEN 'route' END
   WHEN event_type LIKE 'backend.layer.%' OR event_type LIKE 'backend.operator.%' THEN 'layers' WHEN event_type IN ('request.queued', 'scheduler.enqueued', 'scheduler.preempted') THEN 'queue'
   WHEN event_type = 'request.started' THEN CASE WHEN a_scheduled THEN 'queue' ELSE 'prefill' END
   WHEN event_type IN ('scheduler.admitted', 'kv.allocated', 'kv.reused', 'inference.prefill.completed') THEN 'prefill' WHEN event_type IN ('inference.decode.started', 'inference.token.generated', 'inference.decode.completed') THEN 'decode' END AS stage FROM s2),
 s4 AS (SELECT *, stage IS NOT NULL AND stage <> 'layers' AND event_type NOT IN ('inference.prefill.completed', 'inference.decode.completed') AS moves FROM s3),
 r0 AS (SELECT *, MIN(CASE WHEN moves THEN mono_ns END) OVER (PARTITION BY recording_id, stream, request_id) AS born FROM s4 WHERE request_id IS NOT NULL
  AND (stage IS NOT NULL OR event_type LIKE 'request.%' OR event_type LIKE 'kv.%' OR event_type LIKE 'scheduler.%' OR event_type = 'inference.token.generated')),
 r1 AS (SELECT *, NOT (rtm AND event_type = 'inference.token.generated') AS stt, event_type IN ('request.completed', 'request.failed', 'request.cancelled') AS term,
  CASE stage WHEN 'route' THEN 0 WHEN 'queue' THEN 1 WHEN 'prefill' THEN 2 WHEN 'layers' THEN 3 WHEN 'decode' THEN 4 WHEN 'output' THEN 5 END AS so FROM r0 WHERE mono_ns >= born)"""
_A = "arg_{w}({c}, mono_ns) FILTER ({c} IS NOT NULL AND stt)"
REQ = f"""{PIPE}, pre AS (SELECT recording_id, stream, request_id, MAX(mono_ns) AS lp FROM r1 WHERE event_type = 'scheduler.preempted' AND moves GROUP BY 1, 2, 3),
 q AS (SELECT recording_id, stream, request_id, MIN(born) AS born, arg_min(p_name, mono_ns) AS producer, arg_min(p_node_id, mono_ns) AS node_id, NULLIF(arg_min(COALESCE(role, ''), mono_ns), '') AS role, arg_min(session_id, mono_ns) AS session_id, arg_min(syn, mono_ns) AS synthetic,
  {_A.format(w='min', c='model_instance_id')} AS instance, {_A.format(w='min', c='device_id')} AS device_id, {_A.format(w='min', c='a_kind')} AS kind,
  arg_max(a_model, mono_ns) FILTER (event_type = 'route.selected' AND a_model IS NOT NULL) AS route_model, arg_max(a_requested_model, mono_ns) FILTER (event_type = 'request.started' AND a_requested_model IS NOT NULL) AS requested_model,
  arg_max(a_model, mono_ns) FILTER (term AND a_model IS NOT NULL) AS outcome_model, {_A.format(w='max', c='a_prompt_tokens')} AS prompt_tokens,
  arg_max(a_completion_tokens, mono_ns) FILTER (a_completion_tokens IS NOT NULL AND (event_type = 'inference.decode.completed' OR a_token_counts_from_backend OR rtm)) AS completion_tokens,
  COUNT(*) FILTER (event_type = 'inference.token.generated') AS output_events, MAX(mono_ns) FILTER (stt) AS last_ns, MAX(mono_ns) FILTER (term) AS end_ns,
  COALESCE(split_part(arg_max(event_type, mono_ns) FILTER (term), '.', 2), 'active') AS state, COUNT(DISTINCT a_parent_request_id) AS np, MIN(a_parent_request_id) AS par, COUNT(DISTINCT run_id) FILTER (stt) AS nr,
  {_A.format(w='min', c='run_id')} AS run_id, MAX(so) FILTER (moves AND (lp IS NULL OR mono_ns >= lp)) AS top
  FROM r1 LEFT JOIN pre USING (recording_id, stream, request_id) GROUP BY 1, 2, 3),
 sm AS (SELECT recording_id, session_id, arg_max(a_model, mono_ns) AS session_model FROM ev WHERE event_type = 'session.created' AND a_model IS NOT NULL GROUP BY 1, 2),
 lm AS (SELECT recording_id, model_instance_id AS instance, arg_max(a_model, mono_ns) AS load_model FROM ev WHERE (event_type LIKE 'model.load.%' OR event_type = 'model.unload') AND a_model IS NOT NULL AND model_instance_id IS NOT NULL GROUP BY 1, 2),
 rq AS (SELECT q.*, CASE WHEN np = 1 THEN par END AS parent_request_id, np > 1 AS parent_conflict, nr > 1 AS run_conflict, CASE WHEN end_ns IS NOT NULL THEN 'output' ELSE ['route', 'queue', 'prefill', 'layers', 'decode', 'output'][top + 1] END AS stage,
  COALESCE(route_model, outcome_model, requested_model, session_model, load_model, instance, 'unknown model') AS model,
  CASE WHEN route_model IS NOT NULL OR outcome_model IS NOT NULL THEN 'route.selected' WHEN requested_model IS NOT NULL THEN 'requested_model' WHEN session_model IS NOT NULL THEN 'session.created' WHEN load_model IS NOT NULL THEN 'model.load'
   WHEN instance IS NOT NULL THEN 'model_instance_id' ELSE 'unknown' END AS model_source FROM q LEFT JOIN sm USING (recording_id, session_id) LEFT JOIN lm USING (recording_id, instance))"""
_COLS = "recording_id, stream, request_id, producer, node_id, role, synthetic, device_id, kind, prompt_tokens, completion_tokens, output_events, last_ns, end_ns, state, parent_request_id, parent_conflict, run_id, run_conflict, stage, model, model_source"


def _requests(spark, d):
    ev = pipe(spark, d)
    return P.with_model(P.pipeline_requests(P.staged(ev)), ev)


@query("stage_of_event", f"{PIPE} SELECT event_id, stream, role, stage, moves FROM s4")
def stage_of_event(spark, d):
    return P.staged(pipe(spark, d)).select("event_id", "stream", "role", "stage", "moves")


@query("pipeline_requests", f"{REQ} SELECT {_COLS}, born AS start_ns FROM rq")
def pipeline_requests(spark, d):
    return _requests(spark, d).select(*_COLS.split(", "), "start_ns")


# The stage rule itself, folded row by row.
@query(
    "request_stage",
    f"""WITH RECURSIVE {PIPE[5:]}, m AS (SELECT recording_id, stream, request_id, mono_ns, so, event_type = 'scheduler.preempted' AS back, ROW_NUMBER() OVER (PARTITION BY recording_id, stream, request_id ORDER BY mono_ns) AS i FROM r1 WHERE moves),
 z AS (SELECT *, so AS cur, TRUE AS enter FROM m WHERE i = 1 UNION ALL SELECT m.*, CASE WHEN z.cur < 5 AND (m.so >= z.cur OR m.back) THEN m.so ELSE z.cur END, z.cur < 5 AND (m.so >= z.cur OR m.back) AND m.so <> z.cur
  FROM z JOIN m ON m.recording_id = z.recording_id AND m.stream = z.stream AND m.request_id = z.request_id AND m.i = z.i + 1)
 SELECT recording_id, stream, request_id, ['route', 'queue', 'prefill', 'layers', 'decode', 'output'][so + 1] AS stage, MAX(mono_ns) AS entered_ns FROM z WHERE enter GROUP BY 1, 2, 3, so""",
)
def request_stage(spark, d):
    return P.request_stage(P.staged(pipe(spark, d)))


_LANES = """ln AS (SELECT recording_id, node_id, model, COUNT(*) AS requests, COALESCE(arg_min(model_source, born) FILTER (model_source NOT IN ('unknown', 'model_instance_id')), arg_max(model_source, born)) AS model_source FROM rq GROUP BY 1, 2, 3)"""


@query(
    "lanes",
    f"""{REQ}, {_LANES} SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY recording_id ORDER BY node_id, model) - 1 AS INT) AS lane_index, CAST(DENSE_RANK() OVER (PARTITION BY recording_id ORDER BY node_id) - 1 AS INT) AS node_index FROM ln""",
)
def lanes(spark, d):
    return P.lanes(_requests(spark, d))


@query(
    "lane_members",
    f"""{REQ} SELECT recording_id, node_id, model, 'producer' AS kind, producer AS value, COUNT(*) AS requests FROM rq GROUP BY ALL UNION ALL SELECT recording_id, node_id, model, 'role', COALESCE(role, 'unstated'), COUNT(*) FROM rq GROUP BY ALL
 UNION ALL SELECT recording_id, node_id, model, 'device', device_id, COUNT(*) FROM rq WHERE device_id IS NOT NULL GROUP BY ALL""",
)
def lane_members(spark, d):
    return P.lane_members(_requests(spark, d))


@query(
    "recent_finished",
    f"""{REQ} SELECT recording_id, stream, request_id, state FROM rq WHERE state = 'active' UNION ALL SELECT recording_id, stream, request_id, state FROM rq WHERE state <> 'active'
 QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id ORDER BY COALESCE(end_ns, last_ns) DESC) <= 20""",
)
def recent_finished(spark, d):
    return P.shown_requests(_requests(spark, d), 20).select("recording_id", "stream", "request_id", "state")


@query(
    "runtime_links",
    f"""{REQ} SELECT c.recording_id, c.stream, c.request_id, MIN(p.stream) AS parent_stream, c.parent_request_id FROM rq c JOIN rq p ON p.recording_id = c.recording_id AND p.request_id = c.parent_request_id AND p.role = 'runtime'
 AND NOT p.run_conflict AND NOT c.run_conflict AND (c.run_id IS NULL OR p.run_id IS NULL OR c.run_id = p.run_id) AND NOT (p.stream = c.stream AND p.request_id = c.request_id) GROUP BY c.recording_id, c.stream, c.request_id, c.parent_request_id HAVING COUNT(*) = 1""",
)
def runtime_links(spark, d):
    return P.runtime_links(_requests(spark, d))


@query(
    "stage_summary",
    f"""{REQ}, now AS (SELECT recording_id, MAX(mono_ns) AS now, COUNT(*) FILTER (event_type LIKE 'backend.layer.%' AND a_layer >= 0 AND NOT rtm) AS lr FROM s4 GROUP BY 1),
 g AS (SELECT recording_id, now, lr, unnest(['route', 'queue', 'prefill', 'layers', 'decode', 'output']) AS stage FROM now), a AS (SELECT recording_id, stage, COUNT(*) AS events, COUNT(*) FILTER (mono_ns > now - 5000000000) AS rec FROM s4 JOIN now USING (recording_id) WHERE stage IS NOT NULL GROUP BY 1, 2),
 h AS (SELECT recording_id, stage, COUNT(*) AS n FROM rq GROUP BY 1, 2)
 SELECT recording_id, stage, COALESCE(n, 0) AS requests, COALESCE(events, 0) AS events, COALESCE(rec, 0) / 5.0::DOUBLE AS rate_per_sec FROM g LEFT JOIN a USING (recording_id, stage) LEFT JOIN h USING (recording_id, stage) WHERE stage <> 'layers' OR lr > 0""",
)
def stage_summary(spark, d):
    rows = P.staged(pipe(spark, d))
    return P.stage_summary(rows, P.pipeline_requests(rows))


_NOW = "now AS (SELECT recording_id, MAX(mono_ns) AS now FROM ev GROUP BY 1)"
_LAST = "arg_max({c}, mono_ns) FILTER ({c} IS NOT NULL)"


@query(
    "layers",
    f"""{PIPE}, {_NOW} SELECT recording_id, stream, a_layer AS layer, COUNT(*) AS events, {_LAST.format(c='a_layer_count')} AS layer_count, ROUND({_LAST.format(c='a_duration_ms')}, 6) AS last_duration_ms, ROUND(COALESCE(SUM(a_duration_ms), 0), 6) AS total_duration_ms,
 ROUND({_LAST.format(c='a_activation_rms')}, 6) AS activation_rms, ROUND({_LAST.format(c='a_attention_entropy')}, 6) AS attention_entropy, COUNT(*) FILTER (mono_ns > now - 5000000000) / 5.0::DOUBLE AS rate_per_sec
 FROM s0 JOIN now USING (recording_id) WHERE event_type LIKE 'backend.layer.%' AND a_layer >= 0 GROUP BY 1, 2, 3""",
)
def layers(spark, d):
    out = P.layers(pipe(spark, d))
    return out.select("recording_id", "stream", "layer", "events", "layer_count", *[r6(c) for c in ("last_duration_ms", "total_duration_ms", "activation_rms", "attention_entropy")], "rate_per_sec")


@query(
    "operators",
    f"""{PIPE}, {_NOW} SELECT recording_id, stream, a_operator AS operator, a_layer AS layer, COUNT(*) AS events, ROUND(COALESCE(SUM(a_duration_ms), 0), 6) AS total_duration_ms, COUNT(*) FILTER (mono_ns > now - 5000000000) / 5.0::DOUBLE AS rate_per_sec
 FROM s0 JOIN now USING (recording_id) WHERE event_type LIKE 'backend.operator.%' AND a_operator IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def operators(spark, d):
    return P.operators(pipe(spark, d)).withColumn("total_duration_ms", r6("total_duration_ms"))


@query(
    "kv_pools",
    f"""{PIPE}, k AS (SELECT *, CASE event_type WHEN 'kv.allocated' THEN COALESCE(a_blocks, 0) WHEN 'kv.freed' THEN -COALESCE(a_blocks, 0) END AS st, CASE event_type WHEN 'scheduler.configured' THEN a_kv_num_blocks WHEN 'kv.pressure' THEN a_total_blocks END AS tot,
  CASE WHEN event_type = 'kv.pressure' THEN COALESCE(a_occupancy, a_utilization) END AS oc, CASE WHEN event_type = 'kv.pressure' THEN a_level END AS lv FROM s0 WHERE event_type LIKE 'kv.%' OR (event_type = 'scheduler.configured' AND a_kv_num_blocks IS NOT NULL)),
 k1 AS (SELECT *, SUM(st) OVER (PARTITION BY recording_id, stream ORDER BY mono_ns) AS s FROM k)
 SELECT recording_id, stream, CAST(COALESCE(arg_max(s, mono_ns) FILTER (s IS NOT NULL) - LEAST(0, MIN(s)), 0) AS BIGINT) AS used_blocks, {_LAST.format(c='tot')} AS total_blocks, ROUND({_LAST.format(c='oc')}, 6) AS occupancy, {_LAST.format(c='lv')} AS level,
 CAST(COALESCE(SUM(CASE WHEN event_type = 'kv.reused' THEN COALESCE(a_tokens, 0) END), 0) AS BIGINT) AS reused_tokens FROM k1 GROUP BY 1, 2""",
)
def kv_pools(spark, d):
    return P.kv_pools(pipe(spark, d)).withColumn("occupancy", r6("occupancy"))


_TEXT = """tx0 AS (SELECT *, CASE WHEN event_type = 'session.created' AND a_text_capture IS NOT NULL THEN a_text_capture IN ('full', 'on') END AS al FROM s0),
 tx AS (SELECT *, COALESCE(LAST_VALUE(al IGNORE NULLS) OVER (PARTITION BY recording_id, stream, session_id ORDER BY mono_ns), bool_or(al) OVER (PARTITION BY recording_id, stream ORDER BY mono_ns), FALSE) AS ok FROM tx0)"""


@query(
    "top_chunks",
    f"""{PIPE}, {_TEXT} SELECT recording_id, stream, request_id, event_id, a_index AS index, a_bytes AS bytes, ROUND(a_elapsed_ms, 6) AS elapsed_ms, COALESCE(a_unit, 'token') AS unit,
 CASE WHEN a_unit IS NULL OR a_unit = 'token' THEN CASE WHEN a_count > 0 THEN a_count ELSE 1 END END AS tokens, ROUND(a_probability, 6) AS probability, CASE WHEN ok THEN a_text END AS text, a_text IS NOT NULL AND NOT ok AS text_withheld
 FROM tx WHERE event_type = 'inference.token.generated' QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id ORDER BY mono_ns DESC) <= 160""",
)
def top_chunks(spark, d):
    out = P.top_chunks(pipe(spark, d))
    return out.select("recording_id", "stream", "request_id", "event_id", "index", "bytes", r6("elapsed_ms"), "unit", "tokens", r6("probability"), "text", "text_withheld")


_PAIR = """COALESCE(CAST(a_index AS STRING), event_id)"""
_CAND = f"""{_TEXT}, cd AS (SELECT *, CASE WHEN request_id IS NOT NULL THEN 'r|' || stream || '|' || request_id ELSE 's|' || session_id END || '|' || {_PAIR} AS pair FROM tx WHERE event_type = 'inference.token.generated' AND a_probability IS NOT NULL),
 pg AS (SELECT recording_id, pair, MIN(mono_ns) AS born, arg_min(a_index, mono_ns) AS index, arg_max(event_id, mono_ns) AS event_id, NULLIF(arg_max(COALESCE(a_token_id, -1), mono_ns), -1) AS token_id, ROUND(arg_max(a_probability, mono_ns), 6) AS probability,
  NULLIF(arg_max(CASE WHEN ok THEN COALESCE(a_text, '') ELSE '' END, mono_ns), '') AS text, MAX(mono_ns) AS ns FROM cd GROUP BY 1, 2)"""


@query("token_candidates", f"{PIPE}, {_CAND} SELECT recording_id, event_id, index, token_id, probability, text, ns FROM pg")
def token_candidates(spark, d):
    return P.token_candidates(pipe(spark, d)).select("recording_id", "event_id", "index", "token_id", r6("probability"), "text", "ns")


@query("top_tokens", f"{PIPE}, {_CAND} SELECT recording_id, event_id, index, token_id, probability, text, ns FROM pg QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id ORDER BY born DESC) <= 40")
def top_tokens(spark, d):
    return P.top_tokens(pipe(spark, d)).select("recording_id", "event_id", "index", "token_id", r6("probability"), "text", "ns")


@query(
    "bounded_evidence",
    f"""{PIPE}, n AS (SELECT recording_id, stage, event_id, ROW_NUMBER() OVER (PARTITION BY recording_id, stage ORDER BY mono_ns) AS i, COUNT(*) OVER (PARTITION BY recording_id, stage) AS c FROM s4 WHERE stage IS NOT NULL) SELECT recording_id, stage, event_id FROM n WHERE i <= 5 OR i > c - 55""",
)
def bounded_evidence(spark, d):
    rows = P.staged(pipe(spark, d)).where("stage IS NOT NULL").select("recording_id", "stage", "mono_ns", "sequence", "event_id")
    return P.bounded_evidence(rows, ["recording_id", "stage"]).select("recording_id", "stage", "event_id")


@query("capture_allows_text", f"{PIPE}, {_TEXT} SELECT event_id, ok AS text_ok FROM tx")
def capture_allows_text(spark, d):
    return P.text_allowed(pipe(spark, d)).select("event_id", "text_ok")


@query("producer_capabilities")
def producer_capabilities(spark, d):
    ev = pipe(spark, d)
    return P.producer_capabilities(ev, P.pipeline_requests(P.staged(ev)))
