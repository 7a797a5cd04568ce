"""Core view: manifests, series and detectors. Pipe view: GPU."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.classify import event_class, is_failure
from beaconlake.operators import detectors as D
from beaconlake.operators import gpu, islands, manifests, series
from beaconlake.operators.spans import request_spans
from beaconlake.plans import driver_tables as dt
from beaconlake.plans import oracle_core as O
from beaconlake.plans.registry import DUCK_CLASS, DUCK_INSTANCE, query, r6

core, agents, pipe = dt.core_events, dt.agent_events, dt.pipe_events
EV, BASE, SPANS = O.EV, O.BASE, O.SPANS
AG = dt.duck_with("agents")
PP = dt.duck_with("pipe")

_POLICY = """pol AS (SELECT recording_id, string_agg(p, ',' ORDER BY o) AS capture_policy FROM (SELECT recording_id, a_text_capture AS p, MIN(mono_ns) AS o FROM ev
 WHERE event_type IN ('session.started', 'session.created') AND a_text_capture IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


@query("capture_policy", f"{EV}, {_POLICY} SELECT recording_id, COALESCE(capture_policy, 'unspecified') AS capture_policy FROM (SELECT DISTINCT recording_id FROM ev) LEFT JOIN pol USING (recording_id)")
def capture_policy(spark, d):
    return manifests.capture_policy(core(spark, d))


@query(
    "manifest",
    f"""{BASE}, {_POLICY}, s AS (SELECT recording_id, session_id, bool_or(event_type NOT LIKE 'telemetry.%') AS j, bool_or(event_type IN ('session.ended', 'session.closed', 'engine.stopped')) AS e FROM y GROUP BY 1, 2),
 dr AS (SELECT recording_id, SUM(n) AS n FROM (SELECT recording_id, stream, arg_max(n, mono_ns) AS n FROM (SELECT *, COALESCE(a_dropped_count, a_dropped_events) AS n FROM y WHERE event_type = 'telemetry.dropped') WHERE n > 0 GROUP BY 1, 2) GROUP BY 1)
 SELECT recording_id, COUNT(*) AS event_count, COUNT(DISTINCT session_id) AS session_count,
 (SELECT COUNT(*) FILTER (j) > 0 AND COUNT(*) FILTER (j AND NOT e) = 0 FROM s WHERE s.recording_id = y.recording_id) AS complete,
 COALESCE((SELECT capture_policy FROM pol WHERE pol.recording_id = y.recording_id), 'unspecified') AS capture_policy,
 CAST(COALESCE((SELECT n FROM dr WHERE dr.recording_id = y.recording_id), 0) AS DOUBLE) AS dropped_events,
 arg_min(wall_time, mono_ns) AS origin_wall_time, MIN(mono_ns) AS origin_mono_ns, bool_or(COALESCE(p_synthetic, FALSE)) AS synthetic FROM y GROUP BY recording_id""",
)
def manifest(spark, d):
    return manifests.manifest(core(spark, d))


@query(
    "manifest_members",
    f"""{EV}, m AS (SELECT recording_id, mono_ns, 'session' AS kind, session_id AS value FROM ev UNION ALL SELECT recording_id, mono_ns, 'run', run_id FROM ev UNION ALL SELECT recording_id, mono_ns, 'level', s_level FROM ev)
 SELECT recording_id, kind, value, MIN(mono_ns) AS first_ns FROM m WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
)
def manifest_members(spark, d):
    return manifests.manifest_members(core(spark, d)).select("recording_id", "kind", "value", F.col("first_ord.mono_ns").alias("first_ns"))


@query("producers_in_session", f"{EV} SELECT recording_id, p_name AS name, COUNT(*) AS events, arg_min(p_role, mono_ns) FILTER (p_role IS NOT NULL) AS role, bool_or(COALESCE(p_synthetic, FALSE)) AS synthetic FROM ev GROUP BY 1, 2")
def producers_in_session(spark, d):
    return manifests.producers(core(spark, d), ("name",))


_SET = "({c} IS NOT NULL AND {c} <> '' AND NOT regexp_matches({c}, '^\\s*\\[redacted', 'i') AND NOT regexp_matches({c}, '^sha256:', 'i'))"


@query(
    "sensitivity",
    f"""{EV}, {_POLICY}, c AS (SELECT recording_id, bool_or({_SET.format(c='a_prompt')}) AS txt, COUNT(*) FILTER (event_type LIKE 'tool.%' AND {_SET.format(c='a_args')}) AS n
  FROM ev WHERE mono_ns BETWEEN 300000000000 AND 1500000000000 GROUP BY 1), z AS (SELECT r.recording_id, COALESCE(capture_policy, 'unspecified') AS capture_policy, COALESCE(n, 0) AS n, COALESCE(txt, FALSE) AS txt
  FROM (SELECT DISTINCT recording_id FROM ev) r LEFT JOIN pol USING (recording_id) LEFT JOIN c USING (recording_id)),
 f AS (SELECT *, txt OR len(list_filter(string_split(capture_policy, ','), lambda q: lower(trim(q)) IN ('full', 'on'))) > 0 AS ft FROM z)
 SELECT recording_id, ft OR n > 0 AS sensitive, ft AS full_text, n > 0 AS tool_payloads, capture_policy, n AS tool_payload_events FROM f""",
)
def sensitivity(spark, d):
    return manifests.sensitivity(core(spark, d), from_ns=300_000_000_000, to_ns=1_500_000_000_000)


@query("text_flags", f"{EV} SELECT event_id, {_SET.format(c='a_prompt')} AS carries_text, event_type LIKE 'tool.%' AND {_SET.format(c='a_args')} AS tool_payload FROM ev")
def text_flags(spark, d):
    ev = core(spark, d)
    r = Readers(ev)
    return ev.select("event_id", R.carries_text(r).alias("carries_text"), R.has_tool_payload(r).alias("tool_payload"))


# -- series -------------------------------------------------------------------

_B = "bb AS (SELECT recording_id, MIN(mono_ns) AS lo, MAX(mono_ns) AS hi, GREATEST(1, MAX(mono_ns) - MIN(mono_ns)) / 24.0::DOUBLE AS w FROM ev GROUP BY 1)"
_BK = "CAST(LEAST(23, GREATEST(0, floor(({x} - lo) / w))) AS BIGINT)"


@query(
    "timeline_buckets",
    f"""{EV}, bb AS (SELECT recording_id, MIN(mono_ns) AS lo, MAX(mono_ns) - MIN(mono_ns) AS sp FROM ev GROUP BY 1)
 SELECT recording_id, {DUCK_CLASS} AS cls, LEAST(CAST(floor((mono_ns - lo) * (96.0::DOUBLE / GREATEST(sp, 1))) AS BIGINT), 95) AS bucket, COUNT(*) AS events FROM ev JOIN bb USING (recording_id) GROUP BY 1, 2, 3""",
)
def timeline_buckets(spark, d):
    return series.timeline_buckets(core(spark, d))


@query(
    "timeline_peaks",
    f"""{EV}, bb AS (SELECT recording_id, MIN(mono_ns) AS lo, MAX(mono_ns) - MIN(mono_ns) AS sp FROM ev GROUP BY 1), c AS (
 SELECT recording_id, {DUCK_CLASS} AS cls, LEAST(CAST(floor((mono_ns - lo) * (96.0::DOUBLE / GREATEST(sp, 1))) AS BIGINT), 95) AS bucket, COUNT(*) AS n FROM ev JOIN bb USING (recording_id) GROUP BY 1, 2, 3)
 SELECT recording_id, cls, MAX(n) AS max_events, CAST(SUM(n) AS BIGINT) AS events FROM c GROUP BY 1, 2""",
)
def timeline_peaks(spark, d):
    return series.timeline_peaks(series.timeline_buckets(core(spark, d)))


_OVER = f"""ov AS (SELECT recording_id, stream, request_id, b AS bucket, w, d_tokens * GREATEST(0.0::DOUBLE, LEAST(d_end, lo + b * w + w) - GREATEST(d_end - d_ns, lo + b * w)) / d_ns AS t
 FROM spans JOIN bb USING (recording_id), LATERAL (SELECT unnest(generate_series({_BK.format(x='(d_end - d_ns)')}, {_BK.format(x='d_end')})) AS b) WHERE d_ns > 0)"""


@query("decode_bucket_overlap", f"{SPANS}, {_B}, {_OVER} SELECT recording_id, stream, request_id, bucket, ROUND(t, 4) AS tokens FROM ov")
def decode_bucket_overlap(spark, d):
    ev = core(spark, d)
    return series.decode_bucket_overlap(ev, request_spans(ev)).select("recording_id", "stream", "request_id", "bucket", F.round("tokens", 4).alias("tokens"))


@query(
    "strip_tokens_per_sec",
    f"""{SPANS}, {_B}, {_OVER}, p AS (SELECT recording_id, bucket, SUM(t) / (MIN(w) / 1000000000.0::DOUBLE) AS v FROM ov GROUP BY 1, 2)
 SELECT g.recording_id, g.bucket, ROUND(COALESCE(v, 0), 4) AS tokens_per_sec FROM (SELECT DISTINCT recording_id, unnest(generate_series(0, 23)) AS bucket FROM p) g LEFT JOIN p USING (recording_id, bucket)""",
)
def strip_tokens_per_sec(spark, d):
    ev = core(spark, d)
    return series.strip_tokens_per_sec(ev, request_spans(ev)).withColumn("tokens_per_sec", F.round("tokens_per_sec", 4))


@query(
    "strip_agent_activity",
    f"""{EV}, {_B}, p AS (SELECT recording_id, {_BK.format(x='mono_ns')} AS bucket, COUNT(*) AS n FROM ev JOIN bb USING (recording_id)
 WHERE event_type LIKE 'agent.%' OR event_type LIKE 'route.%' OR event_type LIKE 'tool.%' GROUP BY 1, 2)
 SELECT g.recording_id, g.bucket, COALESCE(n, 0) AS events FROM (SELECT DISTINCT recording_id, unnest(generate_series(0, 23)) AS bucket FROM p) g LEFT JOIN p USING (recording_id, bucket)""",
)
def strip_agent_activity(spark, d):
    return series.strip_agent_activity(core(spark, d))


@query(
    "active_model",
    f"""{EV}, m AS (SELECT *, CASE WHEN event_type IN ('route.selected', 'session.created') THEN event_type WHEN event_type LIKE 'model.load.%' THEN 'model.load' END AS src FROM ev)
 SELECT recording_id, arg_max(a_model, mono_ns) AS model, arg_max(src, mono_ns) AS source, arg_max(p_name, mono_ns) AS producer, arg_max(p_node_id, mono_ns) AS node_id, COUNT(DISTINCT a_model) AS distinct_models
 FROM m WHERE src IS NOT NULL AND a_model IS NOT NULL GROUP BY 1""",
)
def active_model(spark, d):
    return series.active_model(core(spark, d))


@query(
    "rolling_latency",
    f"""{SPANS}, z AS (SELECT recording_id, stream, request_id, end_ns, (end_ns - start_ns) / 1000000.0::DOUBLE AS ms FROM spans WHERE end_ns IS NOT NULL),
 q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY recording_id ORDER BY end_ns) AS pos, list_sort(list(ms) OVER (PARTITION BY recording_id ORDER BY end_ns ROWS 7 PRECEDING)) AS l FROM z)
 SELECT recording_id, stream, request_id, end_ns, pos, ROUND(l[CAST(ceil(0.5::DOUBLE * len(l)) AS INT)], 6) AS p50_ms, ROUND(l[CAST(ceil(0.95::DOUBLE * len(l)) AS INT)], 6) AS p95_ms FROM q""",
)
def rolling_latency(spark, d):
    return series.rolling_latency(request_spans(core(spark, d))).withColumn("p50_ms", r6("p50_ms")).withColumn("p95_ms", r6("p95_ms"))


# All producers at every KV event: brute force over the pairs (producer, event time) of the small check tables.
_KV = f"""{EV}, {_B}, k AS (SELECT recording_id, mono_ns, event_type, CAST(to_json([p_name, p_node_id, COALESCE(p_instance_id, session_id)]) AS STRING) AS who,
 CASE event_type WHEN 'kv.allocated' THEN COALESCE(a_blocks, 0) WHEN 'kv.freed' THEN -COALESCE(a_blocks, 0) END AS st,
 CASE event_type WHEN 'scheduler.configured' THEN a_kv_num_blocks WHEN 'kv.pressure' THEN a_total_blocks END AS tot, CASE WHEN event_type = 'kv.pressure' THEN COALESCE(a_occupancy, a_utilization) END AS oc
 FROM ev WHERE event_type IN ('kv.allocated', 'kv.freed', 'kv.pressure') OR (event_type = 'scheduler.configured' AND a_kv_num_blocks > 0)),
 k1 AS (SELECT *, SUM(st) OVER w AS s FROM k WINDOW w AS (PARTITION BY recording_id, who ORDER BY mono_ns)),
 k2 AS (SELECT *, s - LEAST(0, MIN(CASE WHEN st IS NOT NULL THEN s END) OVER w) AS used, LAST_VALUE(tot IGNORE NULLS) OVER w AS total, LAST_VALUE(oc IGNORE NULLS) OVER w AS occ,
  LEAD(mono_ns, 1, 9000000000000000) OVER (PARTITION BY recording_id, who ORDER BY mono_ns) AS till FROM k1 WINDOW w AS (PARTITION BY recording_id, who ORDER BY mono_ns)),
 k3 AS (SELECT a.recording_id, a.mono_ns, COUNT(*) FILTER (b.used IS NOT NULL OR b.occ IS NOT NULL) AS n, COUNT(*) FILTER (b.used IS NOT NULL AND b.total IS NOT NULL) AS kn,
  SUM(CASE WHEN b.total IS NOT NULL THEN b.used END) AS u, SUM(CASE WHEN b.used IS NOT NULL THEN b.total END) AS t, MAX(b.occ) AS o
  FROM k a JOIN k2 b ON a.recording_id = b.recording_id AND b.mono_ns <= a.mono_ns AND a.mono_ns < b.till GROUP BY 1, 2),
 k4 AS (SELECT *, CASE WHEN n > 0 AND n = kn AND t > 0 THEN CAST(u AS DOUBLE) / t WHEN n > 0 AND o IS NOT NULL THEN GREATEST(o, 0) END AS v FROM k3),
 k5 AS (SELECT *, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY mono_ns) AS vv FROM k4)"""


@query(
    "kv_series",
    f"""{_KV}, k6 AS (SELECT recording_id, {_BK.format(x='mono_ns')} AS bucket, arg_max(vv, mono_ns) AS v FROM k5 JOIN bb USING (recording_id) WHERE vv IS NOT NULL GROUP BY 1, 2),
 g AS (SELECT g.recording_id, g.bucket, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY g.recording_id ORDER BY g.bucket) AS kv
  FROM (SELECT DISTINCT recording_id, unnest(generate_series(0, 23)) AS bucket FROM k6) g LEFT JOIN k6 USING (recording_id, bucket)) SELECT recording_id, bucket, ROUND(kv, 6) AS kv FROM g WHERE kv IS NOT NULL""",
)
def kv_series(spark, d):
    return series.kv_series(core(spark, d)).withColumn("kv", r6("kv"))


# -- GPU ----------------------------------------------------------------------

_GPU = f"""{PP}, g AS (SELECT *, CAST(to_json([p_name, p_node_id, {DUCK_INSTANCE}, CASE WHEN {DUCK_INSTANCE} IS NULL THEN session_id END, a_backend]) AS STRING) AS backend_key, {DUCK_INSTANCE} AS inst,
 (a_status IS NULL OR a_status = 'ok') AND (a_samples IS NULL OR a_samples <> 0) AS usable FROM ev),
 gs AS (SELECT *, CASE WHEN usable THEN a_dedicated_bytes END AS ded, CASE WHEN usable THEN a_shared_bytes END AS shr, a_spill_threshold_bytes + COALESCE(a_shared_baseline_bytes, 0) AS lim,
  NULLIF(a_fitted_ctx, 0) AS ctx FROM g WHERE event_type = 'backend.gpu_memory.sample'),
 gz AS (SELECT *, CASE WHEN usable THEN COALESCE(a_spilled, shr > lim) END AS spill, CASE WHEN a_samples < LAST_VALUE(a_samples IGNORE NULLS) OVER (PARTITION BY recording_id, backend_key ORDER BY mono_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS rs FROM gs)"""


@query(
    "gpu_memory_sample",
    f"""{_GPU} SELECT event_id, ded AS dedicated_bytes, shr AS shared_bytes, a_spill_threshold_bytes AS spill_threshold_bytes, a_shared_baseline_bytes AS shared_baseline_bytes,
 lim AS spill_limit_bytes, spill AS spilled, ctx AS fitted_ctx, a_samples AS sample_count, a_status AS status FROM gz""",
)
def gpu_memory_sample(spark, d):
    ev = pipe(spark, d)
    return ev.select("event_id", R.gpu_memory_sample(Readers(ev)).alias("s")).where("s IS NOT NULL").select("event_id", "s.*")


@query("gpu_epochs", f"{_GPU} SELECT recording_id, backend_key, event_id, a_samples AS sample_count, CAST(SUM(rs) OVER (PARTITION BY recording_id, backend_key ORDER BY mono_ns) AS BIGINT) AS epoch FROM gz")
def gpu_epochs(spark, d):
    return gpu.gpu_samples(pipe(spark, d)).select("recording_id", "backend_key", "event_id", "sample_count", "epoch")


@query(
    "gpu_context_changes",
    f"""{_GPU}, c AS (SELECT *, ROW_NUMBER() OVER w AS i, LAG(ctx) OVER w AS p FROM gz WHERE a_fitted_ctx IS NOT NULL WINDOW w AS (PARTITION BY recording_id, backend_key ORDER BY mono_ns))
 SELECT recording_id, backend_key, event_id, ctx AS fitted_ctx, a_fit_outcome AS fit_outcome FROM c WHERE i = 1 OR ctx IS DISTINCT FROM p""",
)
def gpu_context_changes(spark, d):
    return gpu.gpu_context_changes(pipe(spark, d)).select("recording_id", "backend_key", "event_id", "fitted_ctx", "fit_outcome")


@query(
    "gpu_warnings",
    f"""{_GPU} SELECT recording_id, backend_key, a_code AS code, COUNT(*) AS count, arg_max(a_message, mono_ns) FILTER (a_message IS NOT NULL) AS message,
 arg_max(a_severity, mono_ns) FILTER (a_severity IS NOT NULL) AS severity, arg_max(a_source, mono_ns) FILTER (a_source IS NOT NULL) AS source, MIN(mono_ns) AS first_ns, MAX(mono_ns) AS last_ns,
 arg_min(event_id, mono_ns) AS first_event_id, arg_max(event_id, mono_ns) AS last_event_id, arg_min(wall_time, mono_ns) AS first_wall, arg_max(wall_time, mono_ns) AS last_wall
 FROM g WHERE event_type = 'backend.warning' AND a_code IS NOT NULL GROUP BY 1, 2, 3""",
)
def gpu_warnings(spark, d):
    return gpu.gpu_warnings(pipe(spark, d))


@query(
    "gpu_backends",
    f"""{_GPU}, a AS (SELECT recording_id, backend_key, MAX(a_backend) AS backend, MAX(inst) AS instance_id, bool_or(COALESCE(p_synthetic, FALSE)) AS synthetic, COUNT(*) FILTER (event_type = 'backend.gpu_memory.sample') AS samples,
  COUNT(DISTINCT CASE WHEN event_type = 'backend.warning' THEN a_code END) AS warning_codes FROM g WHERE event_type = 'backend.gpu_memory.sample' OR (event_type = 'backend.warning' AND a_code IS NOT NULL) GROUP BY 1, 2),
 l AS (SELECT * FROM gz QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id, backend_key ORDER BY mono_ns DESC) = 1),
 c AS (SELECT * FROM gz WHERE a_fitted_ctx IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id, backend_key ORDER BY mono_ns DESC) = 1)
 SELECT a.*, l.event_id AS latest_event_id, l.ded AS dedicated_bytes, l.shr AS shared_bytes, l.spill AS spilled, c.ctx AS fitted_ctx FROM a LEFT JOIN l USING (recording_id, backend_key) LEFT JOIN c USING (recording_id, backend_key)""",
)
def gpu_backends(spark, d):
    return gpu.gpu_backends(pipe(spark, d))
