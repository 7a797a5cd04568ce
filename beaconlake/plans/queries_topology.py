"""Topology over the agent view and the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconlake.operators import topology as T
from beaconlake.operators.replay import as_of
from beaconlake.plans import driver_tables as dt
from beaconlake.plans.registry import query, r6

agents = dt.agent_events

# One SELECT per rule of the graph, collected by UNION ALL.
_TOOLISH = "(event_type LIKE 'tool.%' OR event_type IN ('retry.scheduled', 'recovery.action'))"


def graph_sql(source: str) -> str:
    return f"""{source}, c0 AS (SELECT *, CASE WHEN event_type = 'tool.called' AND a_tool IS NOT NULL THEN event_id END AS mk FROM ev),
 c1 AS (SELECT *, CASE WHEN a_tool_call_id IS NOT NULL AND {_TOOLISH} THEN LAST_VALUE(mk IGNORE NULLS) OVER (PARTITION BY recording_id, a_tool_call_id ORDER BY mono_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS call_event FROM c0),
 t AS (SELECT c1.*, q.a_tool AS c_tool, q.agent_id AS c_agent, COALESCE(c1.a_tokens, c1.a_token_count) AS tk, c1.event_type LIKE 'route.%' AS rt, COALESCE(c1.model_instance_id, c1.a_to_model) AS inst,
  CASE WHEN COALESCE(c1.model_instance_id, c1.a_to_model) IS NULL THEN c1.a_provider END AS prov FROM c1 LEFT JOIN ev q ON q.recording_id = c1.recording_id AND q.event_id = c1.call_event),
 u AS (SELECT *, COALESCE(inst, prov) AS tgt, rt AND COALESCE(inst, prov) IS NOT NULL AND (agent_id IS NOT NULL OR prov IS NOT NULL) AS routed,
  CASE WHEN event_type = 'tool.called' THEN a_tool WHEN event_type LIKE 'tool.%' THEN COALESCE(c_tool, a_tool) END AS tl FROM t),
 nm AS (
  SELECT recording_id, mono_ns, event_id, 'agent' AS kind, agent_id AS ent, CASE WHEN event_type <> 'agent.message' THEN a_name END AS label, CASE WHEN event_type <> 'agent.message' THEN a_role END AS role,
   CASE event_type WHEN 'agent.spawned' THEN 'pending' WHEN 'agent.started' THEN 'active' WHEN 'agent.completed' THEN 'completed' WHEN 'agent.cancelled' THEN 'cancelled' WHEN 'agent.failed' THEN 'failed' END AS st FROM u WHERE event_type LIKE 'agent.%'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'agent', a_to_agent_id, NULL, NULL, NULL FROM u WHERE event_type = 'agent.message' AND agent_id IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, 'agent', a_parent, NULL, NULL, NULL FROM u WHERE event_type = 'agent.spawned' AND agent_id IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, 'agent', agent_id, NULL, NULL, NULL FROM u WHERE rt AND tgt IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, 'model', tgt, CASE WHEN event_type = 'route.selected' THEN prov || ' · ' || a_model END, NULL, CASE WHEN agent_id IS NULL THEN 'active' END FROM u WHERE routed
  UNION ALL SELECT recording_id, mono_ns, event_id, 'model', a_from_model, NULL, NULL, NULL FROM u WHERE routed AND event_type = 'route.changed' AND a_from_model <> tgt
  UNION ALL SELECT recording_id, mono_ns, event_id, 'model', model_instance_id, a_model, NULL, CASE event_type WHEN 'model.load.started' THEN 'loading' WHEN 'model.load.completed' THEN 'active' ELSE 'unloaded' END FROM u WHERE event_type LIKE 'model.%'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'agent', agent_id, NULL, NULL, NULL FROM u WHERE event_type LIKE 'tool.%' AND a_tool IS NOT NULL AND (event_type = 'tool.called' OR c_tool IS NULL)
  UNION ALL SELECT recording_id, mono_ns, event_id, 'tool', tl, NULL, NULL, CASE event_type WHEN 'tool.called' THEN 'active' WHEN 'tool.completed' THEN 'completed' ELSE 'failed' END FROM u WHERE event_type LIKE 'tool.%'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'memory', a_store, NULL, NULL, CASE split_part(event_type, '.', 3) WHEN 'started' THEN 'active' WHEN 'failed' THEN 'failed' ELSE 'completed' END FROM u WHERE event_type LIKE 'memory.%'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'agent', agent_id, NULL, NULL, NULL FROM u WHERE event_type LIKE 'memory.%' OR {_TOOLISH[1:-1].split(' OR ')[1]} OR event_type LIKE 'guard.%'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'agent', agent_id, NULL, NULL, NULL FROM u WHERE event_type = 'context.forked' AND a_to_agent_id IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, 'agent', a_to_agent_id, NULL, NULL, NULL FROM u WHERE event_type = 'context.forked' AND agent_id IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, 'tool', c_tool, NULL, NULL, NULL FROM u WHERE event_type = 'retry.scheduled' AND agent_id IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, 'agent', a_target_agent_id, NULL, NULL, NULL FROM u WHERE (event_type = 'recovery.action' OR (event_type = 'retry.scheduled' AND c_tool IS NULL)) AND agent_id IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, 'model', a_target_model, NULL, NULL, NULL FROM u WHERE event_type = 'recovery.action' AND agent_id IS NOT NULL AND a_target_agent_id IS NULL),
 em0 AS (
  SELECT recording_id, mono_ns, event_id, 'message' AS kind, 'agent:' || agent_id AS src, 'agent:' || a_to_agent_id AS dst, tk, 1 AS c, 0 AS f, NULL AS st FROM u WHERE event_type = 'agent.message'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'delegation', 'agent:' || a_parent, 'agent:' || agent_id, tk, 1, 0, NULL FROM u WHERE event_type = 'agent.spawned'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'route', 'agent:' || agent_id, 'model:' || tgt, tk, 1, 0, 'active' FROM u WHERE routed
  UNION ALL SELECT recording_id, mono_ns, event_id, 'route_change', 'model:' || a_from_model, 'model:' || tgt, tk, 1, 0, NULL FROM u WHERE routed AND event_type = 'route.changed' AND a_from_model <> tgt
  UNION ALL SELECT recording_id, mono_ns, event_id, 'tool_call', 'agent:' || CASE WHEN event_type <> 'tool.called' AND c_tool IS NOT NULL THEN c_agent ELSE agent_id END, 'tool:' || tl, CASE WHEN event_type = 'tool.called' OR c_tool IS NULL THEN tk END,
   CASE WHEN event_type = 'tool.called' THEN 1 ELSE 0 END, CASE WHEN event_type = 'tool.failed' THEN 1 ELSE 0 END, CASE event_type WHEN 'tool.called' THEN 'active' WHEN 'tool.completed' THEN 'ok' ELSE 'failed' END FROM u WHERE event_type LIKE 'tool.%'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'memory_retrieval', 'agent:' || agent_id, 'memory:' || a_store, tk, CASE WHEN event_type LIKE '%.started' THEN 1 ELSE 0 END, CASE WHEN event_type LIKE '%.failed' THEN 1 ELSE 0 END,
   CASE split_part(event_type, '.', 3) WHEN 'started' THEN 'active' WHEN 'failed' THEN 'failed' ELSE 'ok' END FROM u WHERE event_type LIKE 'memory.%'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'context_transfer', 'agent:' || agent_id, 'agent:' || a_to_agent_id, tk, 1, 0, NULL FROM u WHERE event_type = 'context.forked'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'retry', 'agent:' || agent_id, COALESCE('tool:' || c_tool, 'agent:' || a_target_agent_id), tk, 1, 0, NULL FROM u WHERE event_type = 'retry.scheduled'
  UNION ALL SELECT recording_id, mono_ns, event_id, 'recovery', 'agent:' || agent_id, COALESCE('agent:' || a_target_agent_id, 'model:' || a_target_model, 'tool:' || c_tool), tk, 1, 0, NULL FROM u WHERE event_type = 'recovery.action'),
 em AS (SELECT * FROM em0 WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT recording_id, mono_ns, event_id, kind, src, p, NULL, 0, 0, 'superseded' FROM
  (SELECT *, LAG(dst) OVER (PARTITION BY recording_id, src ORDER BY mono_ns) AS p FROM em0 WHERE kind = 'route' AND src IS NOT NULL) WHERE p IS NOT NULL AND p <> dst),
 dg AS (SELECT recording_id, mono_ns, event_id, event_type, 'failure' AS kind, 'agent:' || agent_id AS node_id FROM u WHERE event_type = 'agent.failed' AND agent_id IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, event_type, 'failure', 'tool:' || tl FROM u WHERE event_type = 'tool.failed' AND tl IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, event_type, 'retry', 'agent:' || agent_id FROM u WHERE event_type = 'retry.scheduled'
  UNION ALL SELECT recording_id, mono_ns, event_id, event_type, 'retry', 'tool:' || c_tool FROM u WHERE event_type = 'retry.scheduled' AND agent_id IS NOT NULL AND c_tool IS NOT NULL
  UNION ALL SELECT recording_id, mono_ns, event_id, event_type, 'recovery', 'agent:' || agent_id FROM u WHERE event_type = 'recovery.action'
  UNION ALL SELECT recording_id, mono_ns, event_id, event_type, CASE event_type WHEN 'guard.no_progress' THEN 'no_progress' WHEN 'guard.duplicate_work' THEN 'duplicate_work' WHEN 'guard.budget_pressure' THEN 'budget_pressure' ELSE 'guard' END, 'agent:' || agent_id FROM u WHERE event_type LIKE 'guard.%')"""


GRAPH = graph_sql(dt.duck_with("agents"))
NODES_SQL = """SELECT recording_id, kind || ':' || ent AS node_id, kind, ent AS entity_id, COALESCE(arg_min(label, mono_ns) FILTER (label <> ent), ent) AS label, arg_max(role, mono_ns) FILTER (role IS NOT NULL) AS role,
 COALESCE(arg_max(st, mono_ns) FILTER (st <> 'pending'), CASE WHEN bool_or(st = 'pending') THEN 'pending' END, 'unknown') AS status, MIN(mono_ns) AS first_ns, MAX(mono_ns) AS last_ns FROM nm WHERE ent IS NOT NULL GROUP BY recording_id, kind, ent"""
EDGES_SQL = """SELECT recording_id, kind || ':' || src || '->' || dst AS edge_id, kind, src AS source, dst AS target, COALESCE(arg_max(st, mono_ns) FILTER (st IS NOT NULL), 'active') AS status,
 CAST(SUM(c) + CASE WHEN kind = 'memory_retrieval' AND MIN(mono_ns) FILTER (st = 'ok') IS NOT NULL AND (MIN(mono_ns) FILTER (c > 0) IS NULL OR MIN(mono_ns) FILTER (st = 'ok') < MIN(mono_ns) FILTER (c > 0)) THEN 1 ELSE 0 END AS BIGINT) AS count,
 CAST(SUM(f) AS BIGINT) AS failures, CAST(SUM(tk) AS DOUBLE) AS tokens, MIN(mono_ns) AS first_ns, MAX(mono_ns) AS last_ns FROM em GROUP BY recording_id, kind, src, dst"""


@query("topology_nodes", f"{GRAPH} {NODES_SQL}")
def topology_nodes(spark, d):
    return T.topology_nodes(T.mentions(agents(spark, d))).drop("mentions")


@query("topology_edges", f"{GRAPH} {EDGES_SQL}")
def topology_edges(spark, d):
    return T.topology_edges(T.mentions(agents(spark, d)))


@query("topology_diagnostics", f"{GRAPH} SELECT * FROM dg")
def topology_diagnostics(spark, d):
    return T.topology_diagnostics(T.mentions(agents(spark, d)))


_TOPO = """(event_type LIKE 'agent.%' OR event_type LIKE 'route.%' OR event_type LIKE 'tool.%' OR event_type LIKE 'memory.retrieval.%' OR event_type LIKE 'guard.%'
 OR event_type IN ('model.load.started', 'model.load.completed', 'model.unload', 'context.forked', 'retry.scheduled', 'recovery.action'))"""
_SAID = "(event_id IN (SELECT event_id FROM nm WHERE ent IS NOT NULL) OR event_id IN (SELECT event_id FROM em) OR event_id IN (SELECT event_id FROM dg))"


@query("unmapped_events", f"{GRAPH} SELECT recording_id, event_id, event_type, mono_ns FROM u WHERE {_TOPO} AND NOT {_SAID}")
def unmapped_events(spark, d):
    return T.unmapped_events(T.mentions(agents(spark, d)))


@query("topology_counts", f"{GRAPH} SELECT recording_id, COUNT(*) AS considered, COUNT(*) FILTER ({_TOPO} AND {_SAID}) AS mapped, COUNT(*) FILTER ({_TOPO} AND NOT {_SAID}) AS unmapped FROM u GROUP BY 1")
def topology_counts(spark, d):
    ev = agents(spark, d)
    return T.topology_counts(ev, T.mentions(ev))


@query(
    "evidence_for",
    f"{GRAPH} SELECT DISTINCT recording_id, event_id FROM nm WHERE kind = 'tool' AND ent = 'tool1'",
)
def evidence_for(spark, d):
    return T.evidence_for(T.mentions(agents(spark, d)), "tool:tool1").select("recording_id", "event_id")


_AT = dt.duck_with("agents") + """, lim AS (SELECT recording_id, MIN(mono_ns) + LEAST(700000000000, MAX(mono_ns) - MIN(mono_ns)) AS till FROM ev GROUP BY 1)"""


@query("topology_at", graph_sql(_AT + ", ev0 AS (SELECT ev.* FROM ev JOIN lim USING (recording_id) WHERE mono_ns <= till)").replace("FROM ev)", "FROM ev0)").replace("LEFT JOIN ev q", "LEFT JOIN ev0 q") + f" {NODES_SQL}")
def topology_at(spark, d):
    return T.topology_nodes(T.mentions(as_of(agents(spark, d), 700_000_000_000))).drop("mentions")


@query(
    "message_graph",
    f"""{dt.duck_with('turns')} SELECT recording_id, 'message:agent:' || agent_id || '->agent:' || a_to_agent_id AS edge_id, COUNT(*) AS count, CAST(SUM(a_tokens) AS DOUBLE) AS tokens FROM ev WHERE a_to_agent_id IS NOT NULL AND agent_id IS NOT NULL GROUP BY 1, 2""",
)
def message_graph(spark, d):
    return T.topology_edges(T.mentions(dt.turn_events(spark, d))).select("recording_id", "edge_id", "count", "tokens")


# Shortest distance from any agent that nothing spawned; agents on or behind a cycle without such a root hang on the first-seen agent that
# reaches them. Paths never repeat an agent, so the number of agents bounds their length.
_DEPTH = """, sp AS (SELECT DISTINCT recording_id, src, dst FROM em WHERE kind = 'delegation'),
 seen AS (SELECT recording_id, node, MIN((mono_ns, event_id, place)) AS at FROM (
  SELECT nm.recording_id, nm.mono_ns, nm.event_id, 'agent:' || nm.ent AS node, CASE WHEN u.agent_id = nm.ent THEN 0 ELSE 1 END AS place
  FROM nm JOIN u ON u.recording_id = nm.recording_id AND u.event_id = nm.event_id WHERE nm.kind = 'agent' AND nm.ent IS NOT NULL) GROUP BY 1, 2),
 reach AS (SELECT recording_id, node AS top, node FROM seen UNION SELECT reach.recording_id, top, dst FROM reach JOIN sp ON sp.recording_id = reach.recording_id AND sp.src = reach.node),
 roots AS (SELECT recording_id, node FROM seen s WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.recording_id = s.recording_id AND sp.dst = s.node)),
 under AS (SELECT DISTINCT reach.recording_id, reach.node FROM reach JOIN roots ON roots.recording_id = reach.recording_id AND roots.node = reach.top),
 cyc AS (SELECT reach.recording_id, reach.node, arg_min(reach.top, t.at) AS top FROM reach JOIN seen t ON t.recording_id = reach.recording_id AND t.node = reach.top
  WHERE NOT EXISTS (SELECT 1 FROM under x WHERE x.recording_id = reach.recording_id AND x.node = reach.node) GROUP BY 1, 2),
 own AS (SELECT recording_id, node, '' AS top FROM under UNION ALL SELECT recording_id, node, top FROM cyc),
 walk AS (SELECT recording_id, node, top, 0 AS depth FROM own WHERE node = top OR (top = '' AND EXISTS (SELECT 1 FROM roots r WHERE r.recording_id = own.recording_id AND r.node = own.node))
  UNION SELECT w.recording_id, sp.dst, w.top, w.depth + 1 FROM walk w JOIN sp ON sp.recording_id = w.recording_id AND sp.src = w.node JOIN own o ON o.recording_id = w.recording_id AND o.node = sp.dst AND o.top = w.top
  WHERE w.depth < (SELECT COUNT(*) FROM seen s WHERE s.recording_id = w.recording_id))
 SELECT recording_id, node AS node_id, MIN(depth) AS depth FROM walk GROUP BY 1, 2"""


@query("delegation_depth", GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + _DEPTH)
def delegation_depth(spark, d):
    return T.delegation_depth(T.mentions(agents(spark, d)))
