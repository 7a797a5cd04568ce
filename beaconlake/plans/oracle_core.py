"""DuckDB readings shared by the checks of the core view.

The times of the mapped events are distinct, so ``mono_ns`` alone orders them.
"""

from __future__ import annotations

from beaconlake.plans import driver_tables as dt
from beaconlake.plans.registry import DUCK_STREAM

EV = dt.duck_with("core")

# Readings of one event.
READ = f""", x AS (SELECT *, {DUCK_STREAM} AS stream,
 CASE WHEN event_type IN ('request.completed', 'request.failed', 'request.cancelled') THEN split_part(event_type, '.', 2) END AS oc,
 CASE WHEN a_token_counts_from_backend AND a_completion_tokens >= 0 THEN a_completion_tokens END AS backend_n,
 CASE WHEN event_type = 'inference.decode.completed' AND a_backend_eval_ms > 0 THEN a_backend_eval_ms END AS eval_ms,
 event_type = 'inference.token.generated' AS is_out,
 CASE WHEN event_type = 'inference.token.generated' AND (a_unit IS NULL OR a_unit = 'token') THEN CASE WHEN a_count > 0 THEN a_count ELSE 1 END END AS n_tok,
 CASE WHEN a_prompt_eval_cached_count BETWEEN 0 AND a_prompt_eval_count THEN 1 WHEN a_backend_cached_tokens BETWEEN 0 AND a_prompt_tokens THEN 2
  WHEN a_cache_n >= 0 AND a_prompt_n >= 0 THEN 3 END AS cache_k,
 CASE WHEN a_backend_draft_accepted_tokens BETWEEN 0 AND a_backend_draft_tokens THEN 1 WHEN a_draft_n_accepted BETWEEN 0 AND a_draft_n THEN 2 END AS spec_k
 FROM ev), y AS (SELECT *, CASE cache_k WHEN 1 THEN a_prompt_eval_count WHEN 2 THEN a_prompt_tokens WHEN 3 THEN a_cache_n + a_prompt_n END AS c_prompt,
 CASE cache_k WHEN 1 THEN a_prompt_eval_cached_count WHEN 2 THEN a_backend_cached_tokens WHEN 3 THEN a_cache_n END AS c_cached,
 CASE cache_k WHEN 1 THEN 'prompt_eval_cached_count' WHEN 2 THEN 'backend_cached_tokens' WHEN 3 THEN 'cache_n' END AS c_source,
 CASE spec_k WHEN 1 THEN a_backend_draft_tokens WHEN 2 THEN a_draft_n END AS s_draft,
 CASE spec_k WHEN 1 THEN a_backend_draft_accepted_tokens WHEN 2 THEN a_draft_n_accepted END AS s_acc,
 CASE spec_k WHEN 1 THEN 'backend_draft_tokens' WHEN 2 THEN 'draft_n' END AS s_source FROM x)"""

# Spans: number the starts of every request, keep the events of the last one.
SPAN = """, num AS (SELECT *, SUM(CASE WHEN event_type = 'request.started' THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, stream, request_id ORDER BY mono_ns) AS inst
 FROM y WHERE request_id IS NOT NULL), cur AS (SELECT * FROM (SELECT *, MAX(inst) OVER (PARTITION BY recording_id, stream, request_id) AS top FROM num) WHERE inst = top AND inst > 0),
 smod AS (SELECT recording_id, stream, session_id, arg_min(a_model, mono_ns) AS smodel FROM y WHERE event_type = 'session.created' AND a_model IS NOT NULL GROUP BY ALL),
 sp0 AS (SELECT recording_id, stream, request_id, MIN(CASE WHEN event_type = 'request.started' THEN mono_ns END) AS start_ns,
  arg_min(p_name, CASE WHEN event_type = 'request.started' THEN mono_ns END) AS producer, arg_min(session_id, CASE WHEN event_type = 'request.started' THEN mono_ns END) AS session_id,
  arg_min(CASE WHEN model_instance_id IS NULL THEN '' ELSE model_instance_id END, CASE WHEN event_type = 'request.started' THEN mono_ns END) AS minst,
  MIN(CASE WHEN oc IS NOT NULL THEN mono_ns END) AS end_ns, COALESCE(arg_min(oc, CASE WHEN oc IS NOT NULL THEN mono_ns END), 'open') AS outcome,
  MIN(CASE WHEN is_out THEN mono_ns END) AS first_token_ns, MAX(CASE WHEN n_tok IS NOT NULL THEN mono_ns END) AS last_token_ns,
  CAST(COALESCE(SUM(n_tok), 0) AS BIGINT) AS tokens, COUNT(n_tok) AS token_events, COUNT(*) FILTER (is_out AND n_tok IS NULL) AS chunks,
  arg_max(eval_ms, CASE WHEN eval_ms IS NOT NULL THEN mono_ns END) AS eval_ms, MAX(CASE WHEN eval_ms IS NOT NULL THEN mono_ns END) AS eval_end_ns,
  arg_min(a_model, CASE WHEN a_model IS NOT NULL AND NOT is_out THEN mono_ns END) AS amodel,
  arg_max(c_prompt, CASE WHEN cache_k IS NOT NULL THEN mono_ns END) AS c_prompt, arg_max(c_cached, CASE WHEN cache_k IS NOT NULL THEN mono_ns END) AS c_cached,
  arg_max(c_source, CASE WHEN cache_k IS NOT NULL THEN mono_ns END) AS c_source, arg_max(event_id, CASE WHEN cache_k IS NOT NULL THEN mono_ns END) AS c_event,
  arg_max(s_draft, CASE WHEN spec_k IS NOT NULL THEN mono_ns END) AS s_draft, arg_max(s_acc, CASE WHEN spec_k IS NOT NULL THEN mono_ns END) AS s_acc,
  arg_max(s_source, CASE WHEN spec_k IS NOT NULL THEN mono_ns END) AS s_source, arg_max(event_id, CASE WHEN spec_k IS NOT NULL THEN mono_ns END) AS s_event
  FROM cur GROUP BY recording_id, stream, request_id),
 sp1 AS (SELECT s.*, e.backend_n AS backend_tokens, e.a_total_ms AS total_ms, e.a_ttft_ms AS ttft_ms, COALESCE(amodel, m.smodel, NULLIF(minst, '')) AS model,
  CASE WHEN e.backend_n IS NOT NULL THEN e.backend_n WHEN chunks > 0 AND tokens = 0 THEN NULL ELSE tokens END AS token_count
  FROM sp0 s LEFT JOIN cur e ON e.recording_id = s.recording_id AND e.stream = s.stream AND e.request_id = s.request_id AND e.mono_ns = s.end_ns
  LEFT JOIN smod m ON m.recording_id = s.recording_id AND m.stream = s.stream AND m.session_id = s.session_id),
 sp2 AS (SELECT *, CASE WHEN token_count IS NULL OR token_count <= 0 THEN NULL WHEN eval_ms IS NOT NULL THEN 'backend-eval' WHEN token_count < 2 THEN NULL
  WHEN end_ns IS NOT NULL AND ttft_ms >= 0 AND total_ms > ttft_ms THEN 'reported-total-minus-ttft' WHEN first_token_ns IS NULL THEN NULL
  WHEN end_ns IS NULL AND last_token_ns > first_token_ns THEN 'first-to-last-token' WHEN end_ns > first_token_ns THEN 'first-output-to-end' END AS dsrc FROM sp1),
 spans AS (SELECT *, CASE dsrc WHEN 'backend-eval' THEN eval_ms * 1000000.0::DOUBLE WHEN 'reported-total-minus-ttft' THEN (total_ms - ttft_ms) * 1000000.0::DOUBLE
  WHEN 'first-output-to-end' THEN CAST(end_ns - first_token_ns AS DOUBLE) WHEN 'first-to-last-token' THEN CAST(last_token_ns - first_token_ns AS DOUBLE) END AS d_ns,
  CASE WHEN dsrc = 'backend-eval' THEN token_count WHEN dsrc IS NOT NULL THEN token_count - 1 END AS d_tokens,
  CAST(CASE dsrc WHEN 'backend-eval' THEN eval_end_ns WHEN 'first-to-last-token' THEN last_token_ns WHEN 'reported-total-minus-ttft' THEN end_ns WHEN 'first-output-to-end' THEN end_ns END AS DOUBLE) AS d_end FROM sp2)"""

# Output events that belong to no running request.
LOOSE = """, firsts AS (SELECT recording_id, stream, request_id, MIN(mono_ns) AS f FROM y WHERE event_type = 'request.started' AND request_id IS NOT NULL GROUP BY ALL),
 loose AS (SELECT y.* FROM y LEFT JOIN firsts f ON f.recording_id = y.recording_id AND f.stream = y.stream AND f.request_id = y.request_id
  WHERE n_tok IS NOT NULL AND (f.f IS NULL OR y.mono_ns < f.f))"""
BASE = EV + READ
SPANS = BASE + SPAN
