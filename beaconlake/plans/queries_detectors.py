"""Detectors, findings and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.classify import event_class, is_failure
from beaconlake.operators import detectors as D
from beaconlake.operators import islands
from beaconlake.plans import driver_tables as dt
from beaconlake.plans import oracle_core as O
from beaconlake.plans.registry import DUCK_CLASS, ORACLES, query, r6
from beaconlake.session import cut_lineage

core, agents = dt.core_events, dt.agent_events
EV, BASE = O.EV, O.BASE
AG = dt.duck_with("agents")
FAIL = "(event_type LIKE '%.failed' OR event_type LIKE '%.error')"


def burst_sql(src: str, keys: str, count: int, ns: int, name: str = "br") -> str:
    """CTEs ending in ``name``: the rows of ``src`` inside bursts, with ``isl``, the time of the first row of their burst."""
    return f""", {name}1 AS (SELECT *, COUNT(*) OVER (PARTITION BY {keys} ORDER BY mono_ns RANGE BETWEEN CURRENT ROW AND {ns} FOLLOWING) AS fwd FROM {src}),
 {name}2 AS (SELECT *, MAX(fwd) OVER (PARTITION BY {keys} ORDER BY mono_ns RANGE BETWEEN {ns} PRECEDING AND CURRENT ROW) >= {count} AS mk FROM {name}1),
 {name}3 AS (SELECT *, CASE WHEN mk AND (NOT COALESCE(LAG(mk) OVER w, FALSE) OR mono_ns - LAG(mono_ns) OVER w > {ns}) THEN mono_ns END AS st FROM {name}2 WINDOW w AS (PARTITION BY {keys} ORDER BY mono_ns)),
 {name} AS (SELECT *, MAX(st) OVER (PARTITION BY {keys} ORDER BY mono_ns) AS isl FROM {name}3 WHERE mk)"""


def _sev(n: str, count: int) -> str:
    return f"CASE WHEN {n} >= {2 * count} THEN 'critical' ELSE 'warning' END"


_STATS = "CAST(COUNT(*) AS BIGINT) AS evidence_count, MIN(mono_ns) AS start_ns, MAX(mono_ns) AS end_ns"
_COLS = ("recording_id", "finding_id", "severity", "start_ns", "end_ns", "evidence_count")


def _fact(name: str, kind: str = "string"):
    return F.col("facts")[name].cast(kind).alias(name)


@query(
    "bursts",
    f"""{EV}, f AS (SELECT * FROM ev WHERE {FAIL}){burst_sql('f', 'recording_id', 3, 5000000000)} SELECT recording_id, event_id, isl AS island_ns FROM br""",
)
def bursts(spark, d):
    rows = core(spark, d).where(is_failure()).select("recording_id", "mono_ns", "sequence", "event_id")
    return islands.bursts(rows, ["recording_id"], 3, 5_000_000_000).select("recording_id", "event_id", F.col("island.mono_ns").alias("island_ns"))


@query(
    "episodes",
    f"""{EV}, s AS (SELECT *, a_utilization >= 0.1 AS h FROM ev WHERE event_type = 'device.compute.sample' AND a_utilization IS NOT NULL),
 g AS (SELECT *, COUNT(*) FILTER (NOT h) OVER (PARTITION BY recording_id ORDER BY mono_ns) AS k FROM s)
 SELECT recording_id, event_id, MIN(mono_ns) OVER (PARTITION BY recording_id, k) AS island_ns FROM (SELECT * FROM g WHERE h)""",
)
def episodes(spark, d):
    ev = core(spark, d)
    load = Readers(ev).num("utilization")
    rows = ev.where(F.col("event_type") == "device.compute.sample").select("recording_id", "mono_ns", "sequence", "event_id", load.alias("load")).where("load IS NOT NULL")
    return islands.episodes(rows, ["recording_id"], F.col("load") >= 0.1).select("recording_id", "event_id", F.col("island.mono_ns").alias("island_ns"))


_SIG = """COALESCE(COALESCE(a_tool, '?') || '|' || a_args_hash, COALESCE(a_tool, '?') || '|args:' || CASE WHEN a_args <> '' AND NOT regexp_matches(a_args, '^\\s*(\\[?redacted\\]?|\\*+|<redacted>)\\s*$', 'i') THEN a_args END)"""
_ACTOR = "COALESCE('agent:' || agent_id, 'request:' || request_id, 'session:' || session_id)"
_SCOPE = "COALESCE('context:' || a_context_id, 'request:' || request_id, 'agent:' || agent_id, 'session:' || session_id)"


def run_sql(where: str, sig: str, name: str) -> str:
    return f""", {name}1 AS (SELECT *, {_ACTOR} AS actor, {sig} AS sig FROM ev WHERE {where}),
 {name}2 AS (SELECT *, CASE WHEN sig IS NOT NULL AND sig IS DISTINCT FROM LAG(sig) OVER (PARTITION BY recording_id, actor ORDER BY mono_ns) THEN event_id END AS st FROM {name}1),
 {name} AS (SELECT *, LAST_VALUE(st IGNORE NULLS) OVER (PARTITION BY recording_id, actor ORDER BY mono_ns) AS isl FROM {name}2)"""


@query("runs", AG + run_sql("event_type = 'tool.called'", _SIG, "r") + " SELECT recording_id, actor, event_id, sig, isl AS island_id FROM r WHERE sig IS NOT NULL")
def runs(spark, d):
    ev = agents(spark, d)
    rows = ev.where(F.col("event_type") == "tool.called").select(
        "recording_id", "mono_ns", "sequence", "event_id", R.actor_key().alias("actor"), R.call_signature(Readers(ev)).alias("signature")
    )
    return islands.runs(rows, ["recording_id", "actor"], F.col("signature")).select("recording_id", "actor", "event_id", "sig", F.col("island.event_id").alias("island_id"))


@query(
    "scope_readers",
    f"""{AG} SELECT event_id, {_SCOPE} AS scope, {_ACTOR} AS actor, COALESCE('model:' || model_instance_id, 'device:' || device_id, 'all') AS cache_scope, COALESCE(a_task, task_id) AS task,
 {_SIG} AS call_sig, COALESCE(a_tool, '?') || '|' || a_output_hash AS output_sig FROM ev""",
)
def scope_readers(spark, d):
    ev = agents(spark, d)
    r = Readers(ev)
    return ev.select(
        "event_id", R.scope_key(r).alias("scope"), R.actor_key().alias("actor"), R.cache_scope().alias("cache_scope"),
        R.task_key(r, D.Config().task_keys).alias("task"), R.call_signature(r).alias("call_sig"), R.output_signature(r).alias("output_sig"),
    )


@query(
    "severity_for",
    f"{EV} SELECT event_id, CASE WHEN a_used_fraction >= 0.95 THEN 'critical' WHEN a_used_fraction >= 0.8 THEN 'warning' END AS severity FROM ev WHERE a_used_fraction IS NOT NULL",
)
def severity_for(spark, d):
    ev = core(spark, d)
    return ev.withColumn("f", Readers(ev).num("used_fraction")).where("f IS NOT NULL").select("event_id", R.severity_for(F.col("f"), 0.8, 0.95).alias("severity"))


_AGG_BUDGET = f"""{AG}, s AS (SELECT *, {_SCOPE} AS scope, CAST(a_used_tokens AS DOUBLE) / a_limit_tokens AS f FROM ev WHERE a_used_tokens IS NOT NULL AND a_limit_tokens > 0 AND event_type NOT LIKE 'guard.%'),
 g AS (SELECT *, COUNT(*) FILTER (f < 0.3) OVER (PARTITION BY recording_id, scope ORDER BY mono_ns) AS k FROM s)
 SELECT recording_id, 'budget-pressure:' || arg_min(event_id, mono_ns) AS finding_id, CASE WHEN MAX(f) >= 0.6 THEN 'critical' ELSE 'warning' END AS severity, {_STATS}, scope,
 CAST(COUNT(*) AS BIGINT) AS samples, ROUND(MAX(f), 6) AS peak_fraction, CAST(MAX(a_used_tokens) AS DOUBLE) AS peak_used_tokens FROM g WHERE f >= 0.3 GROUP BY recording_id, scope, k"""


@query("det_budget_pressure_usage", _AGG_BUDGET)
def det_budget_usage(spark, d):
    config = D.Config().override(budget={"warn": 0.3, "critical": 0.6})
    found = D.budget_pressure(agents(spark, d), config).findings
    return found.select(*_COLS, _fact("scope"), _fact("samples", "bigint"), r6(F.col("facts")["peak_fraction"], "peak_fraction"), _fact("peak_used_tokens", "double"))


@query(
    "det_budget_pressure",
    f"""{EV} SELECT recording_id, 'budget-pressure:' || event_id AS finding_id, CASE WHEN a_used_fraction IS NULL THEN 'warning' WHEN a_used_fraction >= 0.95 THEN 'critical' WHEN a_used_fraction >= 0.8 THEN 'warning' ELSE 'info' END AS severity,
 mono_ns AS start_ns, mono_ns AS end_ns, CAST(1 AS BIGINT) AS evidence_count, COALESCE(a_budget, 'unspecified') AS budget, ROUND(a_used_fraction, 6) AS used_fraction FROM ev WHERE event_type = 'guard.budget_pressure'""",
)
def det_budget(spark, d):
    found = D.budget_pressure(core(spark, d)).findings
    return found.select(*_COLS, _fact("budget"), r6(F.col("facts")["used_fraction"], "used_fraction"))


# The stack itself, folded row by row.
_COMP_FOLD = f"""WITH RECURSIVE {AG[5:]}, c AS (SELECT recording_id, {_SCOPE} AS scope, event_id, mono_ns, split_part(event_type, '.', 3) AS step, a_tokens_before AS tb, a_tokens_after AS ta FROM ev WHERE event_type LIKE 'context.compaction.%'),
 n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY recording_id, scope ORDER BY mono_ns) AS i FROM c),
 z AS (SELECT recording_id, scope, i, event_id, mono_ns, step, tb, ta, CASE WHEN step = 'started' THEN [{{'e': event_id, 'ns': mono_ns, 'tb': tb}}] ELSE [] END AS stack, CAST(NULL AS STRUCT(e STRING, ns BIGINT, tb BIGINT)) AS start FROM n WHERE i = 1
  UNION ALL SELECT n.recording_id, n.scope, n.i, n.event_id, n.mono_ns, n.step, n.tb, n.ta, CASE WHEN n.step = 'started' THEN list_append(z.stack, {{'e': n.event_id, 'ns': n.mono_ns, 'tb': n.tb}}) ELSE z.stack[:-2] END,
   CASE WHEN n.step <> 'started' THEN z.stack[-1] END FROM z JOIN n ON n.recording_id = z.recording_id AND n.scope = z.scope AND n.i = z.i + 1),
 lastz AS (SELECT * FROM z QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id, scope ORDER BY i DESC) = 1),
 res AS (SELECT recording_id, scope, COALESCE(start.e, event_id) AS id, step, COALESCE(start.ns, mono_ns) AS start_ns, mono_ns AS end_ns, CASE WHEN start IS NULL THEN 1 ELSE 2 END AS ev_n,
   CASE WHEN step = 'completed' AND start IS NOT NULL THEN CAST(round((mono_ns - start.ns) / 1000000.0::DOUBLE) AS BIGINT) END AS duration_ms,
   CASE WHEN step = 'completed' AND COALESCE(tb, start.tb) IS NOT NULL AND ta IS NOT NULL THEN COALESCE(tb, start.tb) END AS tokens_before,
   CASE WHEN step = 'completed' AND COALESCE(tb, start.tb) IS NOT NULL AND ta IS NOT NULL THEN ta END AS tokens_after FROM z WHERE step <> 'started'
  UNION ALL SELECT recording_id, scope, u.e, 'dangling', u.ns, u.ns, 1, NULL, NULL, NULL FROM (SELECT recording_id, scope, unnest(stack) AS u FROM lastz)),
 done AS (SELECT * FROM c WHERE step = 'completed'){burst_sql('done', 'recording_id, scope', 3, 60000000000)}
 SELECT recording_id, 'compaction:' || id AS finding_id, CASE WHEN step = 'completed' THEN 'info' ELSE 'warning' END AS severity, start_ns, end_ns, CAST(ev_n AS BIGINT) AS evidence_count, scope,
  duration_ms, CAST(tokens_before AS DOUBLE) AS tokens_before, CAST(tokens_after AS DOUBLE) AS tokens_after FROM res
 UNION ALL SELECT recording_id, 'compaction:churn:' || arg_min(event_id, mono_ns), 'warning', MIN(mono_ns), MAX(mono_ns), COUNT(*), scope, NULL, NULL, NULL FROM br GROUP BY recording_id, scope, isl"""


@query("det_compaction", _COMP_FOLD)
def det_compaction(spark, d):
    found = D.compaction(agents(spark, d)).findings
    return found.select(*_COLS, _fact("scope"), _fact("duration_ms", "bigint"), _fact("tokens_before", "double"), _fact("tokens_after", "double"))


_OUT_SIG = "COALESCE(a_tool, '?') || '|' || a_output_hash"
_NOPROG = f"""{AG}{run_sql("event_type = 'tool.called'", _SIG, 'ra')}{run_sql("event_type = 'tool.completed'", _OUT_SIG, 'rb')},
 qa AS (SELECT recording_id, actor, isl, sig, COUNT(*) AS n FROM ra WHERE sig IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 3),
 ea AS (SELECT r.recording_id, 'no-progress-loop:calls:' || r.isl AS finding_id, r.event_id, r.mono_ns FROM ra r JOIN qa USING (recording_id, actor, isl, sig)
  UNION SELECT r.recording_id, 'no-progress-loop:calls:' || r.isl, o.event_id, o.mono_ns FROM ra r JOIN qa USING (recording_id, actor, isl, sig)
  JOIN ev o ON o.recording_id = r.recording_id AND o.a_tool_call_id = r.a_tool_call_id AND o.event_type IN ('tool.completed', 'tool.failed')),
 qb AS (SELECT recording_id, actor, isl, sig, COUNT(*) AS n FROM rb WHERE sig IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 3),
 eb AS (SELECT r.recording_id, 'no-progress-loop:outputs:' || r.isl AS finding_id, r.event_id, r.mono_ns FROM rb r JOIN qb USING (recording_id, actor, isl, sig)),
 eg AS (SELECT recording_id, 'no-progress-loop:' || event_id AS finding_id, event_id, mono_ns FROM ev WHERE event_type = 'guard.no_progress'),
 e AS (SELECT * FROM ea UNION ALL SELECT * FROM eb UNION ALL SELECT * FROM eg),
 q AS (SELECT recording_id, 'no-progress-loop:calls:' || isl AS finding_id, actor, split_part(sig, '|', 1) AS tool, n FROM qa UNION ALL SELECT recording_id, 'no-progress-loop:outputs:' || isl, actor, split_part(sig, '|', 1), n FROM qb
  UNION ALL SELECT recording_id, finding_id, NULL, NULL, NULL FROM eg)"""


@query(
    "det_no_progress",
    f"""{_NOPROG} SELECT q.recording_id, q.finding_id, CASE WHEN n >= 6 THEN 'critical' ELSE 'warning' END AS severity, MIN(mono_ns) AS start_ns, MAX(mono_ns) AS end_ns, COUNT(*) AS evidence_count, actor, tool, n AS repeats
 FROM q JOIN e USING (recording_id, finding_id) GROUP BY q.recording_id, q.finding_id, actor, tool, n""",
)
def det_no_progress(spark, d):
    found = D.no_progress(agents(spark, d)).findings
    return found.select(*_COLS, _fact("actor"), _fact("tool"), _fact("repeats", "bigint"))


@query("det_no_progress_evidence", f"{_NOPROG} SELECT recording_id, finding_id, event_id FROM e")
def det_no_progress_evidence(spark, d):
    return D.no_progress(agents(spark, d)).evidence.select("recording_id", "finding_id", "event_id")


@query(
    "tool_outcomes",
    f"""{AG} SELECT c.recording_id, c.event_id AS call_event_id, o.event_id AS outcome_event_id FROM ev c JOIN ev o ON o.recording_id = c.recording_id AND o.a_tool_call_id = c.a_tool_call_id
 AND o.mono_ns > c.mono_ns AND o.event_type IN ('tool.completed', 'tool.failed') WHERE c.event_type = 'tool.called'
 QUALIFY ROW_NUMBER() OVER (PARTITION BY c.recording_id, o.event_id ORDER BY c.mono_ns DESC) = 1""",
)
def tool_outcomes(spark, d):
    from beaconlake.operators.topology import resolved_calls

    found = resolved_calls(agents(spark, d))
    return found.where("event_type IN ('tool.completed', 'tool.failed') AND call IS NOT NULL").select("recording_id", F.col("call.event_id").alias("call_event_id"), F.col("event_id").alias("outcome_event_id"))


_DUPLICATE = f"""{AG}, life AS (SELECT *, event_type = 'agent.spawned' AS spawn, CASE WHEN event_type = 'agent.spawned' THEN COALESCE(a_task, task_id) END AS own FROM ev
  WHERE event_type IN ('agent.spawned', 'agent.completed', 'agent.cancelled') AND agent_id IS NOT NULL),
 tk AS (SELECT *, LAST_VALUE(own IGNORE NULLS) OVER (PARTITION BY recording_id, agent_id ORDER BY mono_ns) AS task FROM life WHERE NOT spawn OR own IS NOT NULL),
 ins AS (SELECT *, COALESCE(LAG(spawn) OVER (PARTITION BY recording_id, task, agent_id ORDER BY mono_ns), FALSE) AS was FROM tk WHERE task IS NOT NULL),
 st AS (SELECT *, CASE WHEN spawn AND NOT was THEN 1 WHEN NOT spawn AND was THEN -1 ELSE 0 END AS step FROM ins), sz AS (SELECT *, SUM(step) OVER (PARTITION BY recording_id, task ORDER BY mono_ns) AS size FROM st),
 pd AS (SELECT *, LAST_VALUE(CASE WHEN size = 1 AND step = 1 THEN mono_ns END IGNORE NULLS) OVER (PARTITION BY recording_id, task ORDER BY mono_ns) AS period FROM sz), pp AS (SELECT * FROM pd WHERE size - step > 0 OR step = 1),
 op AS (SELECT recording_id, task, period, MIN(mono_ns) AS opens FROM pp WHERE step = 1 AND size > 1 GROUP BY ALL), rw AS (SELECT pp.*, opens FROM pp JOIN op USING (recording_id, task, period)),
 mb AS (SELECT recording_id, task, period, agent_id, event_id, mono_ns, event_type FROM rw WHERE mono_ns >= opens AND (event_type <> 'agent.spawned' OR step = 1)
  UNION ALL SELECT recording_id, task, period, agent_id, event_id, mono_ns, event_type FROM (SELECT * FROM rw WHERE mono_ns < opens QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id, task, period, agent_id ORDER BY mono_ns DESC) = 1) WHERE event_type = 'agent.spawned')
 SELECT recording_id, 'duplicate-worker:' || arg_min(event_id, mono_ns) AS finding_id, CASE WHEN COUNT(DISTINCT agent_id) FILTER (event_type = 'agent.spawned') >= 3 THEN 'critical' ELSE 'warning' END AS severity, {_STATS}, task,
  COUNT(DISTINCT agent_id) FILTER (event_type = 'agent.spawned') AS agents FROM mb GROUP BY recording_id, task, period
 UNION ALL SELECT recording_id, 'duplicate-worker:' || event_id, 'warning', 1, mono_ns, mono_ns, NULL, NULL FROM ev WHERE event_type = 'guard.duplicate_work'"""


@query("det_duplicate_worker", _DUPLICATE)
def det_duplicate_worker(spark, d):
    found = D.duplicate_worker(agents(spark, d)).findings
    return found.select(*_COLS, _fact("task"), _fact("agents", "bigint"))


@query(
    "det_retry_storm",
    f"""{EV}, f AS (SELECT *, COALESCE(a_tool_call_id, request_id, task_id, agent_id, 'unscoped') AS tg FROM ev WHERE event_type = 'retry.scheduled'){burst_sql('f', 'recording_id', 3, 10000000000)}
 SELECT recording_id, 'retry-storm:' || arg_min(event_id, mono_ns) AS finding_id, {_sev('COUNT(*)', 3)} AS severity, {_STATS}, CAST(COUNT(*) AS BIGINT) AS retries,
 CAST(round((MAX(mono_ns) - MIN(mono_ns)) / 1000000.0::DOUBLE) AS BIGINT) AS span_ms, COUNT(DISTINCT tg) AS targets_count FROM br GROUP BY recording_id, isl""",
)
def det_retry_storm(spark, d):
    found = D.retry_storm(core(spark, d)).findings
    return found.select(*_COLS, _fact("retries", "bigint"), _fact("span_ms", "bigint"), _fact("targets_count", "bigint"))


@query(
    "finding_subjects",
    f"""{EV}, f AS (SELECT *, COALESCE(a_tool_call_id, request_id, task_id, agent_id, 'unscoped') AS tg FROM ev WHERE event_type = 'retry.scheduled'){burst_sql('f', 'recording_id', 3, 10000000000)},
 i AS (SELECT *, first_value(event_id) OVER (PARTITION BY recording_id, isl ORDER BY mono_ns) AS fe FROM br) SELECT recording_id, 'retry-storm:' || fe AS finding_id, 'targets' AS fact, tg AS subject, MIN(mono_ns) AS first_ns FROM i GROUP BY 1, 2, 4""",
)
def finding_subjects(spark, d):
    return D.retry_storm(core(spark, d)).subjects.select("recording_id", "finding_id", "fact", "subject", F.col("first_ord.mono_ns").alias("first_ns"))


@query(
    "det_error_burst",
    f"""{EV}, f AS (SELECT * FROM ev WHERE {FAIL}){burst_sql('f', 'recording_id', 3, 5000000000)}, t AS (SELECT recording_id, isl, event_type, COUNT(*) AS c, MIN(mono_ns) AS lo, MAX(mono_ns) AS hi, arg_min(event_id, mono_ns) AS e FROM br GROUP BY 1, 2, 3)
 SELECT recording_id, 'error-burst:' || arg_min(e, lo) AS finding_id, {_sev('SUM(c)', 3)} AS severity, MIN(lo) AS start_ns, MAX(hi) AS end_ns, CAST(SUM(c) AS BIGINT) AS evidence_count,
 CAST(round((MAX(hi) - MIN(lo)) / 1000000.0::DOUBLE) AS BIGINT) AS span_ms, string_agg(CAST(c AS STRING) || 'x ' || event_type, ', ' ORDER BY c DESC, event_type) AS breakdown FROM t GROUP BY recording_id, isl""",
)
def det_error_burst(spark, d):
    return D.error_burst(core(spark, d)).findings.select(*_COLS, _fact("span_ms", "bigint"), _fact("breakdown"))


@query(
    "det_model_churn",
    f"""{AG}, f AS (SELECT *, COALESCE(model_instance_id, a_model, 'unknown') AS m FROM ev WHERE (event_type = 'model.load.completed' AND request_id IS NULL) OR event_type = 'model.unload'){burst_sql('f', 'recording_id', 4, 60000000000)}
 SELECT recording_id, 'model-churn:' || arg_min(event_id, mono_ns) AS finding_id, {_sev('COUNT(*)', 4)} AS severity, {_STATS}, COUNT(*) FILTER (event_type = 'model.load.completed') AS loads, COUNT(*) FILTER (event_type = 'model.unload') AS unloads,
 COUNT(DISTINCT m) AS models_count FROM br GROUP BY recording_id, isl""",
)
def det_model_churn(spark, d):
    return D.model_churn(agents(spark, d)).findings.select(*_COLS, _fact("loads", "bigint"), _fact("unloads", "bigint"), _fact("models_count", "bigint"))


# Window length and thresholds suited to the density of the table.
_CT = {"window_ms": 120_000, "min_lookups": 3, "baseline_hit_rate": 0.4, "drop_ratio": 0.7, "eviction_count": 5}
_CTW = 120_000_000_000
_THRASH = f"""{EV}, l AS (SELECT *, COALESCE('model:' || model_instance_id, 'device:' || device_id, 'all') AS scope, event_type = 'kv.reused' AS h FROM ev WHERE event_type IN ('kv.reused', 'kv.allocated')),
 p AS (SELECT *, CAST(floor((mono_ns - MIN(mono_ns) OVER (PARTITION BY recording_id, scope)) / CAST({_CTW} AS DOUBLE)) AS BIGINT) AS w FROM l),
 q AS (SELECT recording_id, scope, w, COUNT(*) FILTER (h) AS hits, COUNT(*) AS n, COUNT(*) FILTER (h) / CAST(COUNT(*) AS DOUBLE) AS rate, COALESCE(arg_min(event_id, mono_ns) FILTER (h), arg_min(event_id, mono_ns)) AS fid FROM p GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3),
 b AS (SELECT *, ROW_NUMBER() OVER w1 AS i, AVG(rate) OVER (PARTITION BY recording_id, scope ORDER BY w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS base FROM q WINDOW w1 AS (PARTITION BY recording_id, scope ORDER BY w)),
 j AS (SELECT * FROM b WHERE i > 1 AND base >= 0.4 AND rate <= base * 0.7::DOUBLE),
 m AS (SELECT j.recording_id, j.fid, j.scope, j.rate, j.base, j.n, p.mono_ns FROM j JOIN b o ON o.recording_id = j.recording_id AND o.scope = j.scope AND o.i BETWEEN j.i - 3 AND j.i
  JOIN p ON p.recording_id = o.recording_id AND p.scope = o.scope AND p.w = o.w), e AS (SELECT * FROM ev WHERE event_type = 'kv.evicted'){burst_sql('e', 'recording_id', 5, _CTW)}
 SELECT recording_id, 'cache-thrash:hitrate:' || fid AS finding_id, CASE WHEN rate = 0 THEN 'critical' ELSE 'warning' END AS severity, {_STATS}, scope, ROUND(rate, 6) AS hit_rate, ROUND(base, 6) AS baseline_hit_rate, n AS lookups FROM m GROUP BY recording_id, fid, scope, rate, base, n
 UNION ALL SELECT recording_id, 'cache-thrash:evictions:' || arg_min(event_id, mono_ns), {_sev('COUNT(*)', 5)}, COUNT(*), MIN(mono_ns), MAX(mono_ns), NULL, NULL, NULL, NULL FROM br GROUP BY recording_id, isl"""


@query("det_cache_thrash", _THRASH)
def det_cache_thrash(spark, d):
    found = D.cache_thrash(core(spark, d), D.Config().override(cache_thrash=_CT)).findings
    return found.select(*_COLS, _fact("scope"), r6(F.col("facts")["hit_rate"], "hit_rate"), r6(F.col("facts")["baseline_hit_rate"], "baseline_hit_rate"), _fact("lookups", "bigint"))


@query(
    "det_latency_outlier",
    f"""{EV}, l AS (SELECT recording_id, request_id, event_id, mono_ns, event_type, LAG(event_type) OVER w AS pt, LAG(mono_ns) OVER w AS pn, LAG(event_id) OVER w AS pe FROM ev
  WHERE request_id IS NOT NULL AND event_type IN ('request.started', 'request.completed', 'request.failed', 'request.cancelled') WINDOW w AS (PARTITION BY recording_id, request_id ORDER BY mono_ns)),
 s AS (SELECT *, (mono_ns - pn) / 1000000.0::DOUBLE AS ms FROM l WHERE event_type IN ('request.completed', 'request.failed') AND pt = 'request.started'),
 b AS (SELECT *, list_sort(list(ms) OVER (PARTITION BY recording_id ORDER BY mono_ns ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS l20 FROM s), c AS (SELECT *, len(l20) AS n, l20[CAST(ceil(0.95::DOUBLE * len(l20)) AS INT)] AS p95 FROM b)
 SELECT recording_id, 'latency-outlier:' || pe AS finding_id, CASE WHEN ms > p95 * 1.4 * 2 THEN 'critical' ELSE 'warning' END AS severity, pn AS start_ns, mono_ns AS end_ns, CAST(2 AS BIGINT) AS evidence_count, request_id,
 CAST(round(ms) AS BIGINT) AS duration_ms, CAST(round(p95) AS BIGINT) AS baseline_p95_ms, CAST(n AS BIGINT) AS baseline_requests, split_part(event_type, '.', 2) AS outcome FROM c WHERE n >= 5 AND ms > p95 * 1.4 AND ms - p95 >= 250""",
)
def det_latency_outlier(spark, d):
    found = D.latency_outlier(core(spark, d), D.Config().override(latency={"factor": 1.4})).findings
    return found.select(*_COLS, _fact("request_id"), _fact("duration_ms", "bigint"), _fact("baseline_p95_ms", "bigint"), _fact("baseline_requests", "bigint"), _fact("outcome"))


_USE = """CASE WHEN a_used_bytes IS NOT NULL AND a_total_bytes > 0 THEN a_used_bytes / a_total_bytes WHEN a_total_bytes > 0 AND a_available_bytes BETWEEN 0 AND a_total_bytes THEN (a_total_bytes - a_available_bytes) / a_total_bytes ELSE a_used_fraction END"""


@query(
    "det_resource_pressure",
    f"""{EV}, s AS (SELECT *, COALESCE(device_id, 'unknown-device') || '/' || COALESCE(a_kind, 'memory') AS scope, {_USE} AS f FROM ev WHERE event_type = 'device.memory.sample'),
 g AS (SELECT *, COUNT(*) FILTER (f < 0.85) OVER (PARTITION BY recording_id, scope ORDER BY mono_ns) AS k FROM s WHERE f IS NOT NULL)
 SELECT recording_id, 'resource-pressure:' || arg_min(event_id, mono_ns) AS finding_id, CASE WHEN MAX(f) >= 0.95 THEN 'critical' ELSE 'warning' END AS severity, {_STATS}, scope, ROUND(MAX(f), 6) AS peak_fraction FROM g WHERE f >= 0.85 GROUP BY recording_id, scope, k
 UNION ALL SELECT recording_id, 'resource-pressure:' || event_id, CASE WHEN COALESCE(a_occupancy, a_used_fraction) IS NULL THEN 'warning' WHEN COALESCE(a_occupancy, a_used_fraction) >= 0.95 THEN 'critical' WHEN COALESCE(a_occupancy, a_used_fraction) >= 0.85 THEN 'warning' ELSE 'info' END,
  1, mono_ns, mono_ns, NULL, NULL FROM ev WHERE event_type = 'kv.pressure'""",
)
def det_resource_pressure(spark, d):
    return D.resource_pressure(core(spark, d)).findings.select(*_COLS, _fact("scope"), r6(F.col("facts")["peak_fraction"], "peak_fraction"))


# All ten detectors, with the thresholds of the checks of each one.
_CONFIG = D.Config().override(budget={"warn": 0.3, "critical": 0.6}, cache_thrash=_CT, latency={"factor": 1.4})
_CHECKS = {
    "budget-pressure": ("det_budget_pressure_usage", "det_budget_pressure"), "compaction": ("det_compaction",), "no-progress-loop": ("det_no_progress",), "duplicate-worker": ("det_duplicate_worker",),
    "retry-storm": ("det_retry_storm",), "cache-thrash": ("det_cache_thrash",), "model-churn": ("det_model_churn",), "latency-outlier": ("det_latency_outlier",), "error-burst": ("det_error_burst",), "resource-pressure": ("det_resource_pressure",),
}


# Events of the core view (recordings c/...) and of the agent view (a/...), so that every detector meets what it looks for.
_BOTH = f"WITH ev AS (SELECT * REPLACE ('c/' || recording_id AS recording_id) FROM ({EV} SELECT * FROM ev) UNION ALL BY NAME SELECT * REPLACE ('a/' || recording_id AS recording_id) FROM ({AG} SELECT * FROM ev))"


def _both(spark, d) -> DataFrame:
    led = lambda ev, lead: ev.withColumn("recording_id", F.concat(F.lit(lead), "recording_id"))
    return led(core(spark, d), "c/").unionByName(led(agents(spark, d), "a/"), allowMissingColumns=True)


def _check_of(kind: str, name: str) -> str:
    text, view = ORACLES[name], AG if AG[5:] in ORACLES[name] else EV
    text = text.replace(view[5:], _BOTH[5:])
    if name == "det_budget_pressure":
        text = text.replace(">= 0.95", ">= 0.6").replace(">= 0.8 ", ">= 0.3 ")
    return f"SELECT recording_id, '{kind}' AS kind, finding_id, severity, start_ns, end_ns, CAST(evidence_count AS BIGINT) AS evidence_count FROM ({text})"


_ALL = "WITH fs AS (" + " UNION ALL ".join(_check_of(kind, name) for kind, names in _CHECKS.items() for name in names) + ")"
_ROW = ("recording_id", "kind", "finding_id", "severity", "start_ns", "end_ns", "evidence_count")
_FOUND: dict[tuple[str, str], DataFrame] = {}


def _findings(spark, d) -> DataFrame:
    """Findings of all ten detectors, computed once per session for the queries that only sort, filter or count them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOUND:
        _FOUND[key] = cut_lineage(D.run_all(_both(spark, d), _CONFIG).findings)
    return _FOUND[key]


@query("union_findings", f"{_ALL} SELECT * FROM fs ORDER BY recording_id, start_ns, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, finding_id")
def union_findings(spark, d):
    return D.in_order(_findings(spark, d)).select(*_ROW)


@query("filter_findings", f"{_ALL} SELECT * FROM fs WHERE severity <> 'info' AND kind IN ('error-burst', 'compaction', 'latency-outlier', 'no-progress-loop')")
def filter_findings(spark, d):
    return D.filter_findings(_findings(spark, d), "warning", ["error-burst", "compaction", "latency-outlier", "no-progress-loop"]).select(*_ROW)


@query("severity_counts", f"{_ALL} SELECT recording_id, COUNT(*) FILTER (severity = 'critical') AS critical, COUNT(*) FILTER (severity = 'warning') AS warning, COUNT(*) FILTER (severity = 'info') AS info FROM fs GROUP BY 1")
def severity_counts(spark, d):
    return D.severity_counts(_findings(spark, d))


@query(
    "resolve_evidence",
    f"""{EV}, f AS (SELECT * FROM ev WHERE {FAIL}){burst_sql('f', 'recording_id', 3, 5000000000)}, i AS (SELECT *, first_value(event_id) OVER (PARTITION BY recording_id, isl ORDER BY mono_ns) AS fe FROM br)
 SELECT recording_id, 'error-burst:' || fe AS finding_id, event_id, event_type, {DUCK_CLASS} AS cls, ROUND(ROUND((mono_ns - lo) / 1000000.0::DOUBLE) / 1000.0::DOUBLE, 6) AS rel_s FROM i JOIN (SELECT recording_id, MIN(mono_ns) AS lo FROM ev GROUP BY 1) USING (recording_id)""",
)
def resolve_evidence(spark, d):
    ev = core(spark, d)
    return D.resolve_evidence(D.error_burst(ev).evidence, ev, event_class()).withColumn("rel_s", r6("rel_s"))


@query("findings", f"{_ALL} SELECT recording_id, kind, finding_id, severity, start_ns, end_ns, evidence_count FROM fs")
def findings(spark, d):
    """All ten detectors in one plan."""
    return D.in_order(D.run_all(_both(spark, d), _CONFIG).findings).select(*_ROW)
