"""The driver's tables read as telemetry.

The SELECT texts below map table rows to event envelopes and are valid in both
Spark SQL and DuckDB, so a query and its check read the very same events.
Columns named ``a_*`` become members of the ``attributes`` struct.
One microsecond of the source table counts as one nanosecond, so that 30 days
of rows hold activity on the scale of the second-long windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.session import shared_folder
from beaconlake.sources.table import read_events, write_events

SPARK_BASE = """SELECT event_id AS id, timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) AS us,
 user_id AS uid, event_type AS et, value AS v, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}"""
DUCK_BASE = """SELECT event_id AS id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us,
 user_id AS uid, event_type AS et, value AS v, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"""

_RECORDING = "'r' || CAST(uid % 8 AS STRING)"
_WIN = "CAST(CAST(FLOOR(CAST(us AS DOUBLE) / 300000000000) AS BIGINT) AS STRING)"
_ENVELOPE = f"""
 {_RECORDING} AS recording_id,
 CASE WHEN uid % 3 = 1 THEN 'u' || CAST(uid AS STRING) || '-' || CAST(id AS STRING) ELSE 'x' || CAST(id AS STRING) END AS event_id,
 CAST(id AS BIGINT) AS sequence,
 CAST(us AS BIGINT) AS mono_ns,
 '2024-01-' || LPAD(CAST(CAST(FLOOR(CAST(us AS DOUBLE) / 86400000000) AS BIGINT) + 1 AS STRING), 2, '0') || 'T00:00:00Z' AS wall_time,
 's' || CAST(uid AS STRING) || '_' || CAST(CAST(FLOOR(CAST(us AS DOUBLE) / 1300000000000) AS BIGINT) AS STRING) AS session_id,
 CASE WHEN k % 10 = 0 THEN NULL WHEN k % 50 = 7 THEN 'runx' ELSE 'run' || CAST(uid % 10 AS STRING) END AS run_id,
 CASE WHEN k % 11 = 0 THEN NULL ELSE 'q' || CAST(uid % 100 AS STRING) || '_' || {_WIN} END AS request_id,
 CASE WHEN k % 13 = 0 THEN NULL ELSE 'a' || CAST((uid + k) % 6 AS STRING) END AS agent_id,
 CASE WHEN k % 4 = 0 THEN 't' || CAST(k % 7 AS STRING) END AS task_id,
 CASE WHEN k % 2 = 0 THEN 'm' || CAST(k % 3 AS STRING) END AS model_instance_id,
 CASE WHEN k % 5 <> 0 THEN 'd' || CAST(k % 4 AS STRING) END AS device_id,
 'p' || CAST(uid % 4 AS STRING) AS p_name,
 '1.' || CAST(uid % 2 AS STRING) AS p_version,
 'n' || CAST(uid % 2 AS STRING) AS p_node_id,
 CASE WHEN uid % 3 = 0 THEN 'i' || CAST(uid AS STRING) END AS p_instance_id,
 CASE uid % 5 WHEN 0 THEN 'runtime' WHEN 1 THEN 'inference' WHEN 2 THEN 'fixture' END AS p_role,
 CASE uid % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS p_synthetic,
 CASE k % 5 WHEN 0 THEN 'metrics' WHEN 1 THEN 'standard' WHEN 2 THEN 'deep' END AS s_level,
 CASE WHEN k % 9 = 0 THEN 'turn' || CAST(k % 12 AS STRING) END AS turn_id"""

_FV = "CAST(FLOOR(v) AS BIGINT)"

CORE = f"""SELECT {_ENVELOPE},
 CASE et
  WHEN 'signup' THEN CASE WHEN k < 75 THEN 'request.started' WHEN k < 88 THEN 'session.created' WHEN k < 95 THEN 'route.selected' ELSE 'session.ended' END
  WHEN 'purchase' THEN CASE WHEN k % 10 < 5 THEN 'request.completed' WHEN k % 10 < 7 THEN 'request.failed' WHEN k % 10 = 7 THEN 'request.cancelled'
    WHEN k % 10 = 8 THEN 'inference.decode.completed' ELSE 'scheduler.configured' END
  WHEN 'error' THEN CASE k % 8 WHEN 0 THEN 'tool.failed' WHEN 1 THEN 'retry.scheduled' WHEN 2 THEN 'recovery.action' WHEN 3 THEN 'guard.budget_pressure'
    WHEN 4 THEN 'kv.pressure' WHEN 5 THEN 'backend.error' ELSE 'telemetry.dropped' END
  WHEN 'click' THEN 'inference.token.generated'
  ELSE CASE k % 8 WHEN 0 THEN 'kv.reused' WHEN 1 THEN 'kv.allocated' WHEN 2 THEN 'kv.freed' WHEN 3 THEN 'device.memory.sample' WHEN 4 THEN 'device.compute.sample'
    WHEN 5 THEN CASE k % 4 WHEN 0 THEN 'agent.spawned' WHEN 1 THEN CASE WHEN k % 16 < 8 THEN 'agent.spawned' ELSE 'agent.completed' END ELSE 'agent.cancelled' END
    WHEN 6 THEN CASE k % 3 WHEN 0 THEN 'tool.called' WHEN 1 THEN 'tool.completed' ELSE 'tool.failed' END ELSE 'kv.evicted' END
 END AS event_type,
 CASE WHEN (et = 'signup' AND k >= 75) OR (et = 'purchase' AND k % 3 = 0) THEN 'mod' || CAST(k % 3 AS STRING) || CAST(uid % 2 AS STRING) END AS a_model,
 CASE WHEN et = 'signup' AND k >= 75 AND k < 88 THEN CASE k % 3 WHEN 0 THEN 'metadata' WHEN 1 THEN 'full' END END AS a_text_capture,
 CASE WHEN et = 'click' THEN CASE k % 9 WHEN 0 THEN 'chunk' WHEN 1 THEN 'token' END END AS a_unit,
 CASE WHEN et = 'click' AND k % 7 <> 0 THEN {_FV} % 6 END AS a_count,
 CASE WHEN et = 'purchase' THEN k % 2 = 0 END AS a_token_counts_from_backend,
 CASE WHEN et = 'purchase' THEN {_FV} + 1 END AS a_completion_tokens,
 CASE WHEN et = 'purchase' THEN v * 10 END AS a_total_ms,
 CASE WHEN et = 'purchase' AND k % 3 <> 1 THEN v END AS a_ttft_ms,
 CASE WHEN et = 'purchase' THEN v * 5 END AS a_backend_eval_ms,
 CASE WHEN et = 'purchase' AND k % 4 <> 3 THEN {_FV} * 3 END AS a_prompt_tokens,
 CASE WHEN et = 'purchase' AND k % 6 = 0 THEN {_FV} * 2 END AS a_prompt_eval_count,
 CASE WHEN et = 'purchase' AND k % 6 = 0 THEN {_FV} + k END AS a_prompt_eval_cached_count,
 CASE WHEN et = 'purchase' AND k % 6 IN (1, 2) THEN {_FV} END AS a_backend_cached_tokens,
 CASE WHEN et = 'purchase' AND k % 6 = 3 THEN CAST(k AS BIGINT) END AS a_cache_n,
 CASE WHEN et = 'purchase' AND k % 6 = 3 THEN {_FV} END AS a_prompt_n,
 CASE WHEN et = 'purchase' AND k % 5 = 0 THEN {_FV} + 5 END AS a_backend_draft_tokens,
 CASE WHEN et = 'purchase' AND k % 5 = 0 THEN CAST(k AS BIGINT) END AS a_backend_draft_accepted_tokens,
 CASE WHEN et = 'purchase' AND k % 5 = 1 THEN {_FV} + 9 END AS a_draft_n,
 CASE WHEN et = 'purchase' AND k % 5 = 1 THEN {_FV} END AS a_draft_n_accepted,
 CASE WHEN et = 'error' OR (et = 'view' AND k % 3 = 2) THEN v / 120 END AS a_used_fraction,
 CASE WHEN et = 'view' AND k % 3 = 0 THEN v * 9 END AS a_used_bytes,
 CASE WHEN et = 'view' AND k % 3 < 2 THEN 1000.0E0 END AS a_total_bytes,
 CASE WHEN et = 'view' AND k % 3 = 1 THEN v * 3 END AS a_available_bytes,
 CASE WHEN et IN ('view', 'error') AND k % 5 <> 4 THEN v / 500 END AS a_utilization,
 CASE WHEN et = 'error' AND k % 5 = 1 THEN v / 120 END AS a_occupancy,
 CASE WHEN et = 'error' AND k % 16 = 4 THEN CAST(512 AS BIGINT) END AS a_total_blocks,
 CASE WHEN et = 'view' THEN CAST(k % 9 + 1 AS BIGINT) END AS a_blocks,
 CASE WHEN et = 'view' THEN CAST(k AS BIGINT) END AS a_tokens,
 CASE WHEN et = 'purchase' THEN CAST(256 + k AS BIGINT) END AS a_kv_num_blocks,
 CASE WHEN et = 'error' AND k % 3 = 0 THEN CAST(k AS BIGINT) END AS a_dropped_count,
 CASE WHEN et = 'error' AND k % 3 = 1 THEN CAST(k * 2 AS BIGINT) END AS a_dropped_events,
 CASE WHEN et IN ('view', 'error') AND k % 7 <> 6 THEN 'tc' || CAST(uid % 20 AS STRING) || '_' || CAST(k % 5 AS STRING) END AS a_tool_call_id,
 CASE WHEN et = 'purchase' AND k % 3 <> 2 THEN v / 8 END AS a_cost_usd,
 CASE WHEN et = 'purchase' AND k % 25 = 0 THEN 1000.0E0 + k END AS a_cost_budget_usd,
 CASE WHEN et = 'purchase' AND k % 20 = 18 THEN v END AS a_decode_tokens_per_sec,
 CASE WHEN et = 'signup' AND k % 4 = 1 THEN 'q' || CAST((uid * 7) % 100 AS STRING) || '_' || {_WIN} END AS a_parent_request_id,
 CASE WHEN et = 'view' THEN CASE k % 4 WHEN 0 THEN 'vram' WHEN 1 THEN 'ram' END END AS a_kind,
 CASE WHEN et IN ('view', 'error') THEN CASE k % 5 WHEN 0 THEN '[redacted]' WHEN 1 THEN 'sha256:ab' WHEN 2 THEN 'ls -l' WHEN 3 THEN '' END END AS a_args,
 CASE WHEN et = 'purchase' THEN CASE k % 31 WHEN 0 THEN 'hello' WHEN 1 THEN '[REDACTED]' END END AS a_prompt,
 CASE WHEN et = 'error' AND k % 4 = 3 THEN 'tokens' END AS a_budget
FROM base"""

AGENTS = f"""SELECT {_ENVELOPE},
 CASE et
  WHEN 'signup' THEN CASE WHEN k % 8 = 5 THEN 'agent.started' ELSE 'agent.spawned' END
  WHEN 'purchase' THEN CASE k % 3 WHEN 0 THEN 'agent.completed' WHEN 1 THEN 'agent.cancelled' ELSE 'agent.started' END
  WHEN 'click' THEN CASE WHEN k % 5 < 3 THEN 'tool.called' WHEN k % 5 = 3 THEN 'tool.completed' ELSE 'tool.failed' END
  WHEN 'view' THEN CASE k % 10 WHEN 0 THEN 'route.selected' WHEN 1 THEN 'route.changed' WHEN 2 THEN 'memory.retrieval.started' WHEN 3 THEN 'memory.retrieval.completed'
    WHEN 4 THEN 'memory.retrieval.failed' WHEN 5 THEN 'context.forked' WHEN 6 THEN 'agent.message' WHEN 7 THEN 'context.compaction.started'
    WHEN 8 THEN 'context.compaction.completed' ELSE CASE WHEN k % 4 = 1 THEN 'context.compaction.failed' ELSE 'context.usage' END END
  ELSE CASE k % 9 WHEN 0 THEN 'retry.scheduled' WHEN 1 THEN 'recovery.action' WHEN 2 THEN 'guard.no_progress' WHEN 3 THEN 'guard.duplicate_work'
    WHEN 4 THEN 'model.load.completed' WHEN 5 THEN 'model.unload' WHEN 6 THEN 'agent.failed' WHEN 7 THEN 'guard.other' ELSE 'model.load.started' END
 END AS event_type,
 CASE WHEN et = 'signup' AND k % 3 <> 0 THEN 'a' || CAST((uid + k + 1 + k % 3) % 6 AS STRING) END AS a_parent,
 CASE WHEN et = 'signup' AND k % 5 = 1 THEN 'role' || CAST(k % 2 AS STRING) END AS a_role,
 CASE WHEN et = 'signup' AND k % 7 = 1 THEN 'name' || CAST(k % 4 AS STRING) END AS a_name,
 CASE WHEN et = 'signup' AND k % 6 <> 5 THEN 'task' || CAST(k % 5 AS STRING) END AS a_task,
 CASE WHEN (et = 'click' AND k % 10 <> 4) THEN 'tool' || CAST(uid % 3 AS STRING) END AS a_tool,
 CASE WHEN et IN ('click', 'error') AND k % 7 <> 1 THEN 'c' || CAST(uid % 40 AS STRING) || '_' || CAST(k % 6 AS STRING) END AS a_tool_call_id,
 CASE WHEN et = 'click' AND k % 8 < 6 THEN 'h' || CAST(uid % 2 AS STRING) END AS a_args_hash,
 CASE WHEN et = 'click' AND k % 8 = 6 THEN CASE k % 3 WHEN 0 THEN 'ls' WHEN 1 THEN '<redacted>' ELSE '***' END END AS a_args,
 CASE WHEN et = 'click' AND k % 6 <> 3 THEN 'o' || CAST(uid % 2 AS STRING) END AS a_output_hash,
 CASE WHEN et = 'view' AND k % 4 <> 1 THEN 'mi' || CAST(k % 3 AS STRING) END AS a_to_model,
 CASE WHEN et = 'view' AND k % 3 <> 1 THEN 'prov' || CAST(uid % 2 AS STRING) END AS a_provider,
 CASE WHEN et IN ('view', 'error') AND k % 3 <> 2 THEN 'model' || CAST(k % 2 AS STRING) END AS a_model,
 CASE WHEN et = 'view' AND k % 2 = 1 THEN 'mi' || CAST(uid % 3 AS STRING) END AS a_from_model,
 CASE WHEN et = 'view' AND k % 6 <> 1 THEN 'store' || CAST(uid % 3 AS STRING) END AS a_store,
 CASE WHEN et = 'view' AND k % 7 <> 3 THEN 'a' || CAST((uid + k * 3 + 1) % 6 AS STRING) END AS a_to_agent_id,
 CASE WHEN et = 'error' AND k % 5 = 2 THEN 'a' || CAST((uid + 2) % 6 AS STRING) END AS a_target_agent_id,
 CASE WHEN et = 'error' AND k % 5 = 3 THEN 'mi' || CAST(uid % 3 AS STRING) END AS a_target_model,
 CASE WHEN et IN ('view', 'click') AND k % 3 = 0 THEN CAST(k AS BIGINT) END AS a_tokens,
 CASE WHEN et = 'view' AND k % 3 = 1 THEN CAST(k + 1 AS BIGINT) END AS a_token_count,
 CASE WHEN et = 'view' AND k % 4 = 3 THEN 'ctx' || CAST(uid % 4 AS STRING) END AS a_context_id,
 CASE WHEN et = 'view' AND k % 2 = 0 THEN {_FV} + 100 END AS a_tokens_before,
 CASE WHEN et = 'view' AND k % 3 <> 2 THEN {_FV} END AS a_tokens_after,
 CASE WHEN et = 'view' AND k % 10 = 9 THEN {_FV} END AS a_used_tokens,
 CASE WHEN et = 'view' AND k % 10 = 9 THEN CAST(60 AS BIGINT) END AS a_limit_tokens
FROM base"""

PIPE = f"""SELECT {_ENVELOPE},
 CASE et
  WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'request.queued' WHEN 1 THEN 'scheduler.enqueued' ELSE 'request.started' END
  WHEN 'purchase' THEN CASE k % 8 WHEN 0 THEN 'request.completed' WHEN 1 THEN 'request.failed' WHEN 2 THEN 'request.cancelled' WHEN 3 THEN 'inference.prefill.completed'
    WHEN 4 THEN 'scheduler.preempted' WHEN 5 THEN 'scheduler.admitted' ELSE 'inference.decode.completed' END
  WHEN 'click' THEN CASE WHEN k % 10 < 8 THEN 'inference.token.generated' ELSE 'inference.decode.started' END
  WHEN 'view' THEN CASE k % 8 WHEN 0 THEN 'kv.allocated' WHEN 1 THEN 'kv.freed' WHEN 2 THEN 'kv.reused' WHEN 3 THEN 'kv.pressure' WHEN 4 THEN 'backend.layer.completed'
    WHEN 5 THEN 'backend.operator.completed' WHEN 6 THEN 'scheduler.configured' ELSE 'backend.registered' END
  ELSE CASE k % 6 WHEN 0 THEN 'route.selected' WHEN 1 THEN 'session.created' WHEN 2 THEN 'backend.warning' WHEN 3 THEN 'model.load.completed' ELSE 'backend.gpu_memory.sample' END
 END AS event_type,
 CASE WHEN et IN ('error', 'purchase') AND k % 4 <> 1 THEN 'mod' || CAST(k % 5 AS STRING) END AS a_model,
 CASE WHEN et = 'signup' AND k % 3 = 0 THEN 'want' || CAST(k % 2 AS STRING) END AS a_requested_model,
 CASE WHEN et = 'signup' THEN k % 3 = 1 END AS a_scheduled,
 CASE WHEN et = 'signup' AND k % 2 = 1 THEN CASE k % 3 WHEN 0 THEN 'backend' ELSE 'own' END END AS a_sampler,
 CASE WHEN et = 'signup' AND k % 5 = 1 THEN 'q' || CAST((uid * 7) % 100 AS STRING) || '_' || {_WIN} END AS a_parent_request_id,
 CASE WHEN et IN ('signup', 'purchase') AND k % 3 = 2 THEN 'kind' || CAST(k % 2 AS STRING) END AS a_kind,
 CASE WHEN et = 'purchase' AND k % 4 <> 2 THEN {_FV} * 2 END AS a_prompt_tokens,
 CASE WHEN et = 'purchase' AND k % 4 <> 3 THEN {_FV} END AS a_completion_tokens,
 CASE WHEN et = 'purchase' THEN k % 2 = 0 END AS a_token_counts_from_backend,
 CASE WHEN et = 'error' AND k % 3 = 1 THEN CASE k % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'metadata' ELSE 'on' END END AS a_text_capture,
 CASE WHEN et = 'click' THEN CASE k % 6 WHEN 0 THEN 'chunk' WHEN 1 THEN 'token' END END AS a_unit,
 CASE WHEN et = 'click' AND k % 4 <> 0 THEN {_FV} % 5 END AS a_count,
 CASE WHEN et = 'click' AND k % 3 <> 0 THEN CAST(k % 8 AS BIGINT) END AS a_index,
 CASE WHEN et = 'click' AND k % 5 <> 4 THEN CAST(id % 1000 AS BIGINT) END AS a_token_id,
 CASE WHEN et = 'click' AND k % 2 = 0 THEN v / 500 END AS a_probability,
 CASE WHEN et = 'click' AND k % 3 = 1 THEN 'w' || CAST(k AS STRING) END AS a_text,
 CASE WHEN et = 'click' THEN CAST(k * 3 AS BIGINT) END AS a_bytes,
 CASE WHEN et = 'click' THEN v END AS a_elapsed_ms,
 CASE WHEN et = 'view' THEN CAST(k % 9 + 1 AS BIGINT) END AS a_blocks,
 CASE WHEN et = 'view' THEN CAST(k AS BIGINT) END AS a_tokens,
 CASE WHEN et = 'view' AND k % 16 = 3 THEN v / 120 END AS a_occupancy,
 CASE WHEN et = 'view' AND k % 16 = 11 THEN v / 200 END AS a_utilization,
 CASE WHEN et = 'view' AND k % 5 = 3 THEN 'high' END AS a_level,
 CASE WHEN et = 'view' AND k % 24 = 3 THEN CAST(400 + k AS BIGINT) END AS a_total_blocks,
 CASE WHEN et = 'view' AND k % 3 = 0 THEN CAST(300 + k AS BIGINT) END AS a_kv_num_blocks,
 CASE WHEN et = 'view' AND k % 12 <> 5 THEN CAST(k % 6 AS BIGINT) END AS a_layer,
 CASE WHEN et = 'view' AND k % 5 = 0 THEN CAST(6 AS BIGINT) END AS a_layer_count,
 CASE WHEN et = 'view' AND k % 7 <> 2 THEN v END AS a_duration_ms,
 CASE WHEN et = 'view' AND k % 5 = 4 THEN v / 7 END AS a_activation_rms,
 CASE WHEN et = 'view' AND k % 5 = 2 THEN v / 9 END AS a_attention_entropy,
 CASE WHEN et = 'view' AND k % 11 <> 2 THEN 'op' || CAST(k % 3 AS STRING) END AS a_operator,
 CASE WHEN et IN ('view', 'error') AND k % 4 <> 2 THEN 'be' || CAST(uid % 2 AS STRING) END AS a_backend,
 CASE WHEN et = 'error' THEN {_FV} * 10 END AS a_dedicated_bytes,
 CASE WHEN et = 'error' AND k % 9 <> 4 THEN {_FV} * 4 END AS a_shared_bytes,
 CASE WHEN et = 'error' AND k % 5 = 0 THEN CAST(20 AS BIGINT) END AS a_shared_baseline_bytes,
 CASE WHEN et = 'error' AND k % 7 <> 4 THEN CAST(100 AS BIGINT) END AS a_spill_threshold_bytes,
 CASE WHEN et = 'error' AND k % 13 = 4 THEN k % 2 = 0 END AS a_spilled,
 CASE WHEN et = 'error' AND k % 8 <> 5 THEN CAST(k % 12 AS BIGINT) END AS a_samples,
 CASE WHEN et = 'error' AND k % 3 <> 1 THEN CAST((k % 4) * 1024 AS BIGINT) END AS a_fitted_ctx,
 CASE WHEN et = 'error' AND k % 2 = 0 THEN 'fit' || CAST(k % 3 AS STRING) END AS a_fit_outcome,
 CASE WHEN et = 'error' THEN CASE k % 10 WHEN 4 THEN 'ok' WHEN 5 THEN 'failed' END END AS a_status,
 CASE WHEN et = 'error' AND k % 26 <> 8 THEN 'code' || CAST(uid % 3 AS STRING) END AS a_code,
 CASE WHEN et = 'error' AND k % 3 = 2 THEN 'sev' || CAST(k % 2 AS STRING) END AS a_severity,
 CASE WHEN et = 'error' AND k % 4 = 0 THEN 'src' || CAST(k % 3 AS STRING) END AS a_source,
 CASE WHEN et = 'error' AND k % 7 <> 1 THEN 'msg' || CAST(k % 2 AS STRING) END AS a_message
FROM base"""

# Requests: one span per order; a token event per line; amounts set the clock.
_SPAN_LINES = """SELECT o.o_orderkey AS okey, {start} AS start_ns, o.o_orderstatus AS status, o.o_orderpriority AS prio,
 l.p AS p, CAST(l.qty AS BIGINT) AS qty, CAST(l.cum AS BIGINT) AS cum, l.brand AS brand
 FROM {orders} o LEFT JOIN (SELECT ol.l_orderkey AS okey, ol.l_quantity AS qty, pt.p_brand AS brand,
  ROW_NUMBER() OVER w AS p, SUM(ol.l_quantity) OVER (PARTITION BY ol.l_orderkey ORDER BY {cols} ROWS UNBOUNDED PRECEDING) AS cum
  FROM {lineitem} ol LEFT JOIN {part} pt ON pt.p_partkey = ol.l_partkey
  WINDOW w AS (PARTITION BY ol.l_orderkey ORDER BY {cols})) l ON l.okey = o.o_orderkey"""
_LINE_COLS = (
    "ol.l_partkey, ol.l_suppkey, ol.l_linenumber, ol.l_quantity, ol.l_extendedprice, ol.l_discount, ol.l_tax, "
    "ol.l_returnflag, ol.l_linestatus, ol.l_shipdate"
)
SPARK_SPAN_LINES = _SPAN_LINES.format(
    start="timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o.o_orderdate) * 1000",
    orders="{orders}", lineitem="{lineitem}", part="{part}", cols=_LINE_COLS,
)
DUCK_SPAN_LINES = _SPAN_LINES.format(
    start="epoch_us(o.o_orderdate) * 1000", orders="orders", lineitem="lineitem", part="part", cols=_LINE_COLS
)

# The events of an order follow from its lines: start, one token event per line, end.
SPANS = """SELECT 'orders' AS recording_id, 'o' || CAST(okey AS STRING) || '-' || CAST(seq AS STRING) AS event_id, seq AS sequence, event_type, mono_ns,
 '2024-01-01T00:00:00Z' AS wall_time, 'day' AS session_id, CAST(NULL AS STRING) AS run_id, CAST(okey AS STRING) AS request_id, CAST(NULL AS STRING) AS agent_id,
 CAST(NULL AS STRING) AS task_id, CAST(NULL AS STRING) AS model_instance_id, CAST(NULL AS STRING) AS device_id,
 prio AS p_name, '1' AS p_version, 'n' AS p_node_id, prio AS p_instance_id, CAST(NULL AS STRING) AS p_role, CAST(NULL AS BOOLEAN) AS p_synthetic,
 CAST(NULL AS STRING) AS s_level, CAST(NULL AS STRING) AS turn_id, qty AS a_count, model AS a_model FROM (
 SELECT okey, CAST(0 AS BIGINT) AS seq, 'request.started' AS event_type, start_ns AS mono_ns, prio, CAST(NULL AS BIGINT) AS qty, brand AS model
  FROM span_lines WHERE p IS NULL OR p = 1
 UNION ALL
 SELECT okey, CAST(p AS BIGINT), 'inference.token.generated', start_ns + 100000000 + 10000000 * cum, prio, qty, CAST(NULL AS STRING) FROM span_lines WHERE p IS NOT NULL
 UNION ALL
 SELECT okey, CAST(MAX(COALESCE(p, 0)) + 1 AS BIGINT), CASE WHEN MAX(status) = 'F' THEN 'request.failed' ELSE 'request.completed' END,
  MAX(start_ns) + CASE WHEN MAX(cum) IS NULL THEN 5000000 ELSE 105000000 + 10000000 * MAX(cum) END, MAX(prio), CAST(NULL AS BIGINT), CAST(NULL AS STRING)
  FROM span_lines GROUP BY okey HAVING MAX(status) <> 'P') u"""

# Conversations: one message event per turn, from its role to the role of the next turn.
TURNS = """SELECT 'conversations' AS recording_id, 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS event_id, CAST(turn AS BIGINT) AS sequence,
 'agent.message' AS event_type, CAST(conv_id * 1000000000 + turn * 1000000 AS BIGINT) AS mono_ns, '2024-01-01T00:00:00Z' AS wall_time,
 CAST(conv_id AS STRING) AS session_id, CAST(NULL AS STRING) AS run_id, CAST(NULL AS STRING) AS request_id, role AS agent_id, CAST(NULL AS STRING) AS task_id,
 CAST(NULL AS STRING) AS model_instance_id, CAST(NULL AS STRING) AS device_id, 'chat' AS p_name, '1' AS p_version, 'n' AS p_node_id, CAST(NULL AS STRING) AS p_instance_id,
 CAST(NULL AS STRING) AS p_role, CAST(NULL AS BOOLEAN) AS p_synthetic, CAST(NULL AS STRING) AS s_level, CAST(turn AS STRING) AS turn_id,
 LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS a_to_agent_id, CAST(LENGTH(text) AS BIGINT) AS a_tokens FROM {conversations}"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assemble(flat: DataFrame) -> DataFrame:
    """Flat mapped columns -> envelope with producer, sampling and attributes structs."""
    producer = F.struct(*[F.col(f"p_{n}").alias(n) for n in ("name", "version", "node_id", "instance_id", "role", "synthetic")])
    sampling = F.struct(F.col("s_level").alias("level"), F.lit(None).cast("boolean").alias("sampled"))
    attributes = F.struct(*[F.col(c).alias(c[2:]) for c in flat.columns if c.startswith("a_")])
    keep = [c for c in flat.columns if c[:2] not in ("p_", "s_", "a_")]
    return flat.select(*keep, producer.alias("producer"), sampling.alias("sampling"), attributes.alias("attributes"))


def _mapped(spark: SparkSession, sf_dir: str, mapping: str) -> DataFrame:
    """Mapped after the rows are ranged by recording and time: ranging reads its input twice and moves it, and the table's rows are narrower than events."""
    base = spark.sql(SPARK_BASE, events=_read(spark, sf_dir, "events")).repartitionByRange(F.expr(_RECORDING), "us")
    return assemble(spark.sql(mapping.replace("FROM base", "FROM {base}"), base=base))


def _span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: _read(spark, sf_dir, name) for name in ("orders", "lineitem", "part")}
    lines = spark.sql(SPARK_SPAN_LINES, **tables)
    return assemble(spark.sql(SPANS.replace("FROM span_lines", "FROM {span_lines}"), span_lines=lines))


_VIEWS = {
    "core": lambda spark, sf_dir: _mapped(spark, sf_dir, CORE),
    "agents": lambda spark, sf_dir: _mapped(spark, sf_dir, AGENTS),
    "pipe": lambda spark, sf_dir: _mapped(spark, sf_dir, PIPE),
    "spans": _span_events,
    "turns": lambda spark, sf_dir: assemble(spark.sql(TURNS, conversations=_read(spark, sf_dir, "conversations"))),
}
_RANGED = ("core", "agents", "pipe")
_STORED: dict[tuple[str, str, str], str] = {}


def events_of(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """Events of a view, read from the events table.

    As with recordings, the mapped events are written once, partitioned by
    recording and ranged by time, so that queries read only the recordings,
    columns and attribute members they use and skip files by time and type.
    The table lives in the shared folder of the session.
    """
    mapped = _VIEWS[view](spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, view)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}/{view}"
        write_events(mapped, path, ranged=view in _RANGED)
        _STORED[key] = path
    return read_events(spark, _STORED[key], mapped.schema)


def core_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir, "core")


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir, "agents")


def pipe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir, "pipe")


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir, "spans")


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir, "turns")


def duck_with(view: str) -> str:
    """CTE prefix giving the flat events of one view as ``ev`` to DuckDB."""
    if view == "spans":
        return f"WITH span_lines AS ({DUCK_SPAN_LINES}), ev AS ({SPANS})"
    if view == "turns":
        return f"WITH ev AS ({TURNS.format(conversations='conversations')})"
    mapping = {"core": CORE, "agents": AGENTS, "pipe": PIPE}[view]
    return f"WITH base AS ({DUCK_BASE}), ev AS ({mapping})"
