"""Comparison of the two halves of every recording, correlation groups, cursors and report facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconlake.operators import compare as C
from beaconlake.operators import cursors as K
from beaconlake.operators import detectors as D
from beaconlake.operators import gpu, manifests, metrics, replay
from beaconlake.operators import related as X
from beaconlake.operators import topology as T
from beaconlake.operators.spans import request_spans
from beaconlake.plans import driver_tables as dt
from beaconlake.plans import oracle_core as O
from beaconlake.plans.queries_core import _latency_sql
from beaconlake.plans.queries_topology import EDGES_SQL, NODES_SQL, graph_sql
from beaconlake.plans import queries_series  # noqa: F401 (its check text is reused here)
from beaconlake.plans.registry import DUCK_ERROR, ORACLES, query, r6
from beaconlake.session import cut_lineage

core, agents, pipe = dt.core_events, dt.agent_events, dt.pipe_events
HALF = 1_296_000_000_000


def halves(events):
    """Recording ``r`` becomes ``r/a`` (first half by time) and ``r/b``."""
    side = F.when(F.col("mono_ns") < HALF, "a").otherwise("b")
    return events.withColumn("recording_id", F.concat("recording_id", F.lit("/"), side))


def sides(df):
    return df.withColumn("pair_id", F.substring_index("recording_id", "/", 1)).withColumn("side", F.substring_index("recording_id", "/", -1)).drop("recording_id")


def _halved(view: str) -> str:
    """The events of a view with halves as recordings."""
    base = dt.duck_with(view)
    return base.replace(", ev AS (", ", whole AS (", 1) + f", ev AS (SELECT * REPLACE (recording_id || '/' || CASE WHEN mono_ns < {HALF} THEN 'a' ELSE 'b' END AS recording_id) FROM whole)"


SP = _halved("core") + O.READ + O.SPAN
FACTS = f"""{SP}, fs AS (SELECT recording_id, request_id, MIN(mono_ns) AS fm, stream FROM y WHERE event_type = 'request.started' AND request_id IS NOT NULL GROUP BY recording_id, request_id, stream),
 sq AS (SELECT s.*, fm FROM spans s JOIN fs USING (recording_id, request_id, stream)),
 b0 AS (SELECT * FROM sq QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id, request_id ORDER BY fm DESC) = 1), bd AS (SELECT * FROM sq WHERE d_ns IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id, request_id ORDER BY fm DESC) = 1),
 ef AS (SELECT recording_id, request_id, arg_min(run_id, mono_ns) FILTER (run_id IS NOT NULL) AS run_id, arg_min(turn_id, mono_ns) FILTER (turn_id IS NOT NULL) AS turn, MAX(COALESCE(a_prompt_tokens, a_prompt_eval_count)) AS pt, MAX(CASE WHEN n_tok IS NOT NULL THEN mono_ns END) AS lt,
  arg_max(a_decode_tokens_per_sec, mono_ns) FILTER (event_type = 'inference.decode.completed' AND a_decode_tokens_per_sec > 0) AS rate, arg_min(a_completion_tokens, mono_ns) FILTER (oc IS NOT NULL AND a_completion_tokens IS NOT NULL) AS ct,
  SUM(a_cost_usd) FILTER (oc IS NOT NULL) AS cost, arg_min(a_ttft_ms, mono_ns) FILTER (oc IS NOT NULL AND a_ttft_ms >= 0) AS ttft FROM y WHERE request_id IS NOT NULL GROUP BY 1, 2),
 fa AS (SELECT b0.recording_id, b0.request_id, run_id, turn, b0.start_ns, b0.outcome, COALESCE((b0.first_token_ns - b0.start_ns) / 1000000.0::DOUBLE, ef.ttft) AS ttft_ms, CASE WHEN b0.first_token_ns IS NOT NULL THEN 'derived' WHEN ef.ttft IS NOT NULL THEN 'reported' END AS ttft_source,
  b0.tokens AS streamed_tokens, COALESCE(rate, CASE WHEN b0.tokens >= 2 AND lt > b0.first_token_ns THEN (b0.tokens - 1) / ((lt - b0.first_token_ns) / 1000000000.0::DOUBLE) END, CASE WHEN bd.d_tokens > 0 AND bd.d_ns > 0 THEN bd.d_tokens / (bd.d_ns / 1000000000.0::DOUBLE) END) AS dr,
  rate IS NOT NULL AS rated, CAST(pt AS DOUBLE) AS prompt_tokens, CAST(COALESCE(ct, CASE WHEN b0.tokens > 0 THEN b0.tokens END) AS DOUBLE) AS completion_tokens, cost AS cost_usd
  FROM b0 LEFT JOIN bd USING (recording_id, request_id) LEFT JOIN ef USING (recording_id, request_id))"""


@query(
    "request_facts",
    f"""{FACTS} SELECT recording_id, request_id, run_id, turn, start_ns, outcome, ROUND(ttft_ms, 6) AS ttft_ms, ttft_source, streamed_tokens, ROUND(dr, 6) AS decode_tok_per_sec, CASE WHEN rated THEN 'reported' WHEN dr IS NOT NULL THEN 'derived' END AS decode_source,
 prompt_tokens, completion_tokens, ROUND(cost_usd, 6) AS cost_usd FROM fa""",
)
def request_facts(spark, d):
    out = C.request_facts(halves(core(spark, d)))
    return out.withColumn("ttft_ms", r6("ttft_ms")).withColumn("decode_tok_per_sec", r6("decode_tok_per_sec")).withColumn("cost_usd", r6("cost_usd"))


def units_sql(event_unit: str, fact_unit: str, session: bool = False) -> str:
    """CTEs ending in ``un``: statistics per unit."""
    budget = "arg_max(a_cost_budget_usd, mono_ns) FILTER (a_cost_budget_usd > 0)" if session else "NULL"
    return f""", uj AS (SELECT y.*, f.run_id AS f_run, f.turn AS f_turn, f.request_id AS f_rid FROM y LEFT JOIN fa f ON f.recording_id = y.recording_id AND f.request_id = y.request_id),
 ue AS (SELECT recording_id, {event_unit} AS unit, COUNT(*) AS events, MIN(mono_ns) AS fe, COUNT(*) FILTER (event_type = 'retry.scheduled') AS retries, COUNT(*) FILTER (event_type = 'kv.reused') AS hits, COUNT(*) FILTER (event_type = 'kv.allocated') AS misses,
  COUNT(*) FILTER (event_type LIKE '%.failed' OR event_type LIKE '%.error' OR event_type IN ('retry.scheduled', 'recovery.action') OR event_type LIKE 'guard.%') AS errors, MAX(CASE WHEN event_type = 'guard.budget_pressure' AND a_used_fraction >= 0 THEN a_used_fraction END) AS bp, {budget} AS budget
  FROM uj WHERE {event_unit} IS NOT NULL GROUP BY 1, 2),
 uk AS (SELECT *, {fact_unit} AS unit, COALESCE(completion_tokens, CAST(streamed_tokens AS DOUBLE)) AS n, ROW_NUMBER() OVER (PARTITION BY recording_id, {fact_unit}, ttft_ms IS NULL ORDER BY ttft_ms) AS i,
  COUNT(ttft_ms) OVER (PARTITION BY recording_id, {fact_unit}) AS c FROM fa WHERE {fact_unit} IS NOT NULL),
 uf AS (SELECT recording_id, unit, COUNT(*) AS requests, MIN(start_ns) AS fst, COUNT(*) FILTER (outcome = 'failed') AS failed, SUM(prompt_tokens) AS pt, SUM(completion_tokens) AS ct, SUM(cost_usd) AS cost, MIN(ttft_ms) FILTER (i >= ceil(0.5::DOUBLE * c)) AS p50, MIN(ttft_ms) FILTER (i >= ceil(0.95::DOUBLE * c)) AS p95,
  SUM(n) FILTER (dr IS NOT NULL AND n > 0) AS tn, SUM(n / dr) FILTER (dr IS NOT NULL AND n > 0) AS ts FROM uk GROUP BY 1, 2),
 un AS (SELECT recording_id, unit, LEAST(COALESCE(fe, fst), COALESCE(fst, fe)) AS first_ns, COALESCE(events, 0) AS events, COALESCE(requests, 0) AS requests, COALESCE(failed, 0) AS failed_requests, p50 AS ttft_ms, p95 AS ttft_p95_ms, CASE WHEN ts > 0 THEN tn / ts END AS decode_tok_per_sec,
  pt AS prompt_tokens, ct AS completion_tokens, cost AS cost_usd, CAST(cost / budget AS DOUBLE) AS cost_budget_fraction, bp AS budget_peak_fraction, COALESCE(retries, 0) AS retries, COALESCE(hits, 0) AS cache_hits, COALESCE(misses, 0) AS cache_misses,
  CASE WHEN hits + misses > 0 THEN CAST(hits AS DOUBLE) / (hits + misses) END AS cache_hit_rate, COALESCE(errors, 0) AS errors FROM ue FULL JOIN uf USING (recording_id, unit))"""


_UNITS = {
    "session": units_sql("'session'", "'session'", True), "request": units_sql("f_rid", "request_id"), "run": units_sql("COALESCE(run_id, f_run)", "run_id"),
    "turn": units_sql("COALESCE(turn_id, f_turn)", "turn"),
}
_FLOATS = ("ttft_ms", "ttft_p95_ms", "decode_tok_per_sec", "prompt_tokens", "completion_tokens", "cost_usd", "cost_budget_fraction", "budget_peak_fraction", "cache_hit_rate")
_STAT_COLS = "recording_id, unit, first_ns, events, requests, failed_requests, retries, cache_hits, cache_misses, errors, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in _FLOATS)


def _unit_stats(spark, d, mode):
    ev = halves(core(spark, d))
    out = C.unit_stats(ev, C.request_facts(ev), mode)
    for c in _FLOATS:
        out = out.withColumn(c, F.round(F.col(c).cast("double"), 6))
    return out


for _mode in ("session", "request", "run", "turn"):
    query(f"unit_stats_{_mode}", f"{FACTS}{_UNITS[_mode]} SELECT {_STAT_COLS} FROM un")(lambda spark, d, _mode=_mode: _unit_stats(spark, d, _mode))


@query("unattributed_events", f"{FACTS}, uj AS (SELECT y.recording_id, COALESCE(y.run_id, f.run_id) AS u FROM y LEFT JOIN fa f ON f.recording_id = y.recording_id AND f.request_id = y.request_id) SELECT recording_id, COUNT(*) FILTER (u IS NULL) AS unattributed FROM uj GROUP BY 1")
def unattributed_events(spark, d):
    ev = halves(core(spark, d))
    return C.unattributed_events(ev, C.request_facts(ev), "run")


_SIDED = "sd AS (SELECT *, split_part(recording_id, '/', 1) AS pair_id, split_part(recording_id, '/', 2) AS side FROM un)"
_ALIGN = f"""{_SIDED}, ix AS (SELECT pair_id, side, unit, ROW_NUMBER() OVER (PARTITION BY pair_id, side ORDER BY first_ns, unit) AS pos FROM sd), ia AS (SELECT * FROM ix WHERE side = 'a'), ib AS (SELECT b.*, a.pos AS met FROM ix b LEFT JOIN ia a ON a.pair_id = b.pair_id AND a.unit = b.unit WHERE b.side = 'b')"""


@query(
    "align_by_id",
    f"""{FACTS}{_UNITS['run']}, {_ALIGN}, an AS (SELECT *, LAST_VALUE(met IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY pos) AS anchor FROM ib)
 SELECT pair_id, ia.unit AS a_unit, an.unit AS b_unit, CASE WHEN ia.unit IS NOT NULL AND an.unit IS NOT NULL THEN 'matched' WHEN ia.unit IS NOT NULL THEN 'only-a' ELSE 'only-b' END AS status, 'id' AS matched_by,
 CASE WHEN ia.pos IS NOT NULL THEN CAST(ia.pos AS DOUBLE) ELSE COALESCE(an.anchor, 0) + 0.5::DOUBLE END AS place, an.pos AS b_pos FROM ia FULL JOIN an USING (pair_id, unit)""",
)
def align_by_id(spark, d):
    ev = halves(core(spark, d))
    return C.align_units(sides(C.unit_stats(ev, C.request_facts(ev), "run")))


@query(
    "align_by_position",
    f"""{FACTS}{_UNITS['request']}, {_ALIGN} SELECT pair_id, ia.unit AS a_unit, ib.unit AS b_unit, CASE WHEN ia.unit IS NOT NULL AND ib.unit IS NOT NULL THEN 'matched' WHEN ia.unit IS NOT NULL THEN 'only-a' ELSE 'only-b' END AS status, 'position' AS matched_by,
 CAST(pos AS DOUBLE) AS place, CASE WHEN ib.unit IS NOT NULL THEN pos END AS b_pos FROM ia FULL JOIN ib USING (pair_id, pos)""",
)
def align_by_position(spark, d):
    ev = halves(core(spark, d))
    return C.align_units(sides(C.unit_stats(ev, C.request_facts(ev), "request")), F.lit(True))


_METRIC_ROWS = ", ".join(f"('{n}', '{p}', {t}::DOUBLE)" for n, p, t in C.METRICS)
_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT pair_id, side, unit, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM sd" for n, _, _ in C.METRICS) + f"), md(metric, pol, tol) AS (VALUES {_METRIC_ROWS})"
_VERDICT = """SELECT pair_id, unit, metric, ROUND(a, 6) AS a, ROUND(b, 6) AS b, ROUND(b - a, 5) AS delta, ROUND(CASE WHEN a <> 0 THEN (b - a) / abs(a) END, 5) AS relative,
 CASE WHEN a IS NULL AND b IS NULL THEN 'n/a' WHEN a IS NULL THEN 'only-b' WHEN b IS NULL THEN 'only-a' WHEN b - a = 0 OR (tol > 0 AND a <> 0 AND abs((b - a) / abs(a)) < tol) THEN 'same' WHEN pol = 'neutral' THEN 'changed'
 WHEN (pol = 'lower' AND b < a) OR (pol = 'higher' AND b > a) THEN 'better' ELSE 'worse' END AS verdict"""


def _delta_cols(df):
    for c, digits in (("a", 6), ("b", 6), ("delta", 5), ("relative", 5)):
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(
    "metric_deltas",
    f"""{FACTS}{_UNITS['session']}, {_SIDED}, {_LONG}, p AS (SELECT pair_id, unit, metric, MAX(value) FILTER (side = 'a') AS a, MAX(value) FILTER (side = 'b') AS b FROM lg GROUP BY 1, 2, 3) {_VERDICT} FROM p JOIN md USING (metric)""",
)
def metric_deltas(spark, d):
    ev = halves(core(spark, d))
    return _delta_cols(C.metric_deltas(sides(C.unit_stats(ev, C.request_facts(ev)))))


@query(
    "metric_deltas_by_run",
    f"""{FACTS}{_UNITS['run']}, {_SIDED}, {_LONG}, p AS (SELECT pair_id, unit, metric, MAX(value) FILTER (side = 'a') AS a, MAX(value) FILTER (side = 'b') AS b FROM lg GROUP BY 1, 2, 3) {_VERDICT} FROM p JOIN md USING (metric)""",
)
def metric_deltas_by_run(spark, d):
    ev = halves(core(spark, d))
    units = cut_lineage(sides(C.unit_stats(ev, C.request_facts(ev), "run")))
    return _delta_cols(C.metric_deltas(units, C.align_units(units)))


_RP = f"""{_halved('core')}, gp AS (SELECT *, COALESCE(a_used_fraction, -1) AS uf FROM ev WHERE event_type = 'guard.budget_pressure'),
 fd AS (SELECT split_part(recording_id, '/', 1) AS pair_id, split_part(recording_id, '/', 2) AS side, 'budget-pressure|budget=' || COALESCE(a_budget, 'unspecified') AS signature, 'budget-pressure:' || event_id AS id, mono_ns AS s,
  CASE WHEN uf < 0 THEN 'warning' WHEN uf >= 0.95 THEN 'critical' WHEN uf >= 0.8 THEN 'warning' ELSE 'info' END AS sev FROM gp),
 n1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, side, signature, sev ORDER BY s) AS k FROM fd),
 eq AS (SELECT pair_id, signature, a.id AS a_id, b.id AS b_id, sev AS a_severity, sev AS b_severity FROM (SELECT * FROM n1 WHERE side = 'a') a JOIN (SELECT * FROM n1 WHERE side = 'b') b USING (pair_id, signature, sev, k)),
 n2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id, side, signature ORDER BY s) AS k FROM fd WHERE id NOT IN (SELECT a_id FROM eq) AND id NOT IN (SELECT b_id FROM eq)),
 ot AS (SELECT pair_id, signature, a.id AS a_id, b.id AS b_id, a.sev AS a_severity, b.sev AS b_severity FROM (SELECT * FROM n2 WHERE side = 'a') a FULL JOIN (SELECT * FROM n2 WHERE side = 'b') b USING (pair_id, signature, k)),
 al AS (SELECT * FROM eq UNION ALL SELECT * FROM ot), rk(sev, r) AS (VALUES ('info', 0), ('warning', 1), ('critical', 2))"""


@query(
    "diff_findings",
    f"""{_RP} SELECT pair_id, signature, a_id, b_id, a_severity, b_severity, CASE WHEN a_id IS NULL THEN 'added' WHEN b_id IS NULL THEN 'resolved' ELSE 'persisting' END AS status,
 CASE WHEN y.r > x.r THEN 'escalated' WHEN y.r < x.r THEN 'eased' END AS severity_change FROM al LEFT JOIN rk x ON x.sev = a_severity LEFT JOIN rk y ON y.sev = b_severity""",
)
def diff_findings(spark, d):
    signed = C.finding_signatures(D.budget_pressure(halves(core(spark, d))))
    return C.diff_findings(sides(signed))


@query(
    "signature_list",
    f"""{_halved('core')}, f AS (SELECT *, COALESCE(a_tool_call_id, request_id, task_id, agent_id, 'unscoped') AS tg FROM ev WHERE event_type = 'retry.scheduled'),
 b1 AS (SELECT *, COUNT(*) OVER (PARTITION BY recording_id ORDER BY mono_ns RANGE BETWEEN CURRENT ROW AND 60000000000 FOLLOWING) AS fwd FROM f),
 b2 AS (SELECT *, MAX(fwd) OVER (PARTITION BY recording_id ORDER BY mono_ns RANGE BETWEEN 60000000000 PRECEDING AND CURRENT ROW) >= 3 AS mk FROM b1),
 b3 AS (SELECT *, CASE WHEN mk AND (NOT COALESCE(LAG(mk) OVER w, FALSE) OR mono_ns - LAG(mono_ns) OVER w > 60000000000) THEN mono_ns END AS st FROM b2 WINDOW w AS (PARTITION BY recording_id ORDER BY mono_ns)),
 b4 AS (SELECT *, MAX(st) OVER (PARTITION BY recording_id ORDER BY mono_ns) AS isl FROM b3 WHERE mk), g AS (SELECT recording_id, isl, arg_min(event_id, mono_ns) AS fe, list(DISTINCT tg) AS l FROM b4 GROUP BY 1, 2)
 SELECT recording_id, 'retry-storm:' || fe AS finding_id, 'retry-storm|targets=' || len(l) || ':' || list_sum([CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) for x in l]) || ':' || list_sum([CAST('0x' || substr(md5(x), 9, 8) AS BIGINT) for x in l]) AS signature FROM g""",
)
def signature_list(spark, d):
    config = D.Config().override(retry_storm={"window_ms": 60_000})
    return C.finding_signatures(D.retry_storm(halves(core(spark, d)), config)).select("recording_id", "finding_id", "signature")


_GH = graph_sql(_halved("agents"))


@query(
    "diff_graph_nodes",
    f"""{_GH}, nd AS ({NODES_SQL}), s AS (SELECT *, split_part(recording_id, '/', 1) AS pair_id, split_part(recording_id, '/', 2) AS side FROM nd)
 SELECT pair_id, node_id, CASE WHEN a.status IS NULL THEN 'added' WHEN b.status IS NULL THEN 'removed' WHEN a.status <> b.status THEN 'changed' ELSE 'same' END AS change, a.status AS a_status, b.status AS b_status
 FROM (SELECT * FROM s WHERE side = 'a') a FULL JOIN (SELECT * FROM s WHERE side = 'b') b USING (pair_id, node_id)""",
)
def diff_graph_nodes(spark, d):
    return C.diff_graph(sides(T.topology_nodes(T.mentions(halves(agents(spark, d))))), "node_id")


@query(
    "diff_graph_edges",
    f"""{_GH}, nd AS ({EDGES_SQL}), s AS (SELECT *, split_part(recording_id, '/', 1) AS pair_id, split_part(recording_id, '/', 2) AS side FROM nd)
 SELECT pair_id, edge_id, CASE WHEN a.status IS NULL THEN 'added' WHEN b.status IS NULL THEN 'removed' WHEN a.status <> b.status OR a.count <> b.count OR a.failures <> b.failures THEN 'changed' ELSE 'same' END AS change, a.status AS a_status, b.status AS b_status,
 b.count - a.count AS count_delta, b.failures - a.failures AS failures_delta FROM (SELECT * FROM s WHERE side = 'a') a FULL JOIN (SELECT * FROM s WHERE side = 'b') b USING (pair_id, edge_id)""",
)
def diff_graph_edges(spark, d):
    return C.diff_graph(sides(T.topology_edges(T.mentions(halves(agents(spark, d))))), "edge_id", ("count", "failures"))


# -- correlation --------------------------------------------------------------

_CO = f"""{O.BASE}, k AS (SELECT recording_id, event_id, mono_ns, event_type, a_tool_call_id AS tc, request_id AS rid, stream, a_parent_request_id AS par, run_id, agent_id FROM y), s AS (SELECT * FROM k WHERE event_type = 'session.ended'),
 li AS (SELECT recording_id, stream, rid, COUNT(DISTINCT par) AS np, MIN(par) AS par1, COUNT(DISTINCT run_id) AS nr, MIN(run_id) AS run1 FROM k WHERE rid IS NOT NULL GROUP BY 1, 2, 3),
 m AS (SELECT s.recording_id, s.event_id AS sid, 'tool_call' AS kind, k.event_id, k.mono_ns FROM s JOIN k ON k.recording_id = s.recording_id AND k.tc = s.tc
  UNION ALL SELECT s.recording_id, s.event_id, 'request', k.event_id, k.mono_ns FROM s JOIN k ON k.recording_id = s.recording_id AND k.rid = s.rid AND k.stream = s.stream
  UNION ALL SELECT s.recording_id, s.event_id, 'run', k.event_id, k.mono_ns FROM s JOIN k ON k.recording_id = s.recording_id AND k.run_id = s.run_id
  UNION ALL SELECT s.recording_id, s.event_id, 'agent', k.event_id, k.mono_ns FROM s JOIN k ON k.recording_id = s.recording_id AND k.agent_id = s.agent_id
  UNION ALL SELECT s.recording_id, s.event_id, 'parent', k.event_id, k.mono_ns FROM s JOIN li ON li.recording_id = s.recording_id AND li.stream = s.stream AND li.rid = s.rid AND np = 1 AND nr <= 1
   JOIN k ON k.recording_id = s.recording_id AND k.rid = li.par1 AND NOT (k.rid = s.rid AND k.stream = s.stream) AND (li.run1 IS NULL OR k.run_id IS NULL OR k.run_id = li.run1)
  UNION ALL SELECT DISTINCT s.recording_id, s.event_id, 'children', k.event_id, k.mono_ns FROM s JOIN k c ON c.recording_id = s.recording_id AND c.par = s.rid AND c.rid IS NOT NULL AND NOT (c.rid = s.rid AND c.stream = s.stream)
   AND (c.run_id IS NULL OR s.run_id IS NULL OR c.run_id = s.run_id) JOIN k ON k.recording_id = c.recording_id AND k.rid = c.rid AND k.stream = c.stream), mm AS (SELECT * FROM m WHERE event_id <> sid)"""


@query("related_groups", f"{_CO} SELECT recording_id, sid AS selected_id, kind, COUNT(*) AS total FROM mm GROUP BY 1, 2, 3")
def related_groups(spark, d):
    ev = core(spark, d)
    return X.related_groups(ev, ev.where("event_type = 'session.ended'"))[0].select("recording_id", "selected_id", "kind", "total")


@query("related_groups_shown", f"{_CO} SELECT recording_id, sid AS selected_id, kind, event_id FROM mm QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id, sid, kind ORDER BY mono_ns) <= 25")
def related_groups_shown(spark, d):
    ev = core(spark, d)
    return X.related_groups(ev, ev.where("event_type = 'session.ended'"))[1].select("recording_id", "selected_id", "kind", "event_id")


@query(
    "related_events",
    f"""{O.BASE}, s AS (SELECT * FROM y WHERE event_type = 'session.ended'), m AS (SELECT s.recording_id, s.event_id AS sid, 1 AS lv, 'tool_call_id' AS kind, k.event_id, k.mono_ns FROM s JOIN y k ON k.recording_id = s.recording_id AND k.a_tool_call_id = s.a_tool_call_id
  UNION ALL SELECT s.recording_id, s.event_id, 2, 'request_id', k.event_id, k.mono_ns FROM s JOIN y k ON k.recording_id = s.recording_id AND k.request_id = s.request_id
  UNION ALL SELECT s.recording_id, s.event_id, 3, 'agent_id', k.event_id, k.mono_ns FROM s JOIN y k ON k.recording_id = s.recording_id AND k.agent_id = s.agent_id),
 b AS (SELECT *, MIN(lv) OVER (PARTITION BY recording_id, sid) AS best FROM m WHERE event_id <> sid) SELECT recording_id, sid AS selected_id, kind, event_id FROM b WHERE lv = best QUALIFY ROW_NUMBER() OVER (PARTITION BY recording_id, sid ORDER BY mono_ns) <= 25""",
)
def related_events(spark, d):
    ev = core(spark, d)
    return X.related_events(ev, ev.where("event_type = 'session.ended'")).select("recording_id", "selected_id", "kind", "event_id")


@query(
    "request_lineage",
    f"""{O.BASE} SELECT recording_id, CAST(to_json([stream, request_id]) AS STRING) AS request, CASE WHEN COUNT(DISTINCT a_parent_request_id) = 1 AND COUNT(DISTINCT run_id) <= 1 THEN MIN(a_parent_request_id) END AS one_parent,
 CASE WHEN COUNT(DISTINCT run_id) = 1 THEN MIN(run_id) END AS one_run FROM y WHERE request_id IS NOT NULL GROUP BY recording_id, stream, request_id""",
)
def request_lineage(spark, d):
    return X.lineage(X.correlated(core(spark, d)))


# -- cursors ------------------------------------------------------------------

_CURS = tuple((i, i * 65_000_000_000) for i in range(41))
_CUR_SQL = ", ".join(f"({i}, {ns})" for i, ns in _CURS)


def _at(view: str) -> str:
    return dt.duck_with(view).replace(", ev AS (", ", whole AS (", 1) + f", cur_(c, at_) AS (VALUES {_CUR_SQL}), ev AS (SELECT whole.* REPLACE (recording_id || '@' || c AS recording_id) FROM whole JOIN cur_ ON mono_ns <= at_)"


def _cursors(events):
    return events.select("recording_id").distinct().withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("cursor_id"), F.lit(ns).alias("at_ns")) for i, ns in _CURS]))).select("recording_id", "c.cursor_id", "c.at_ns")


_METRICS_AT = f"""{_at('core')}{O.READ}{O.SPAN}{_latency_sql('spans', 'recording_id', '(end_ns - start_ns)').replace(chr(10) + ' SELECT ', ', lat AS (SELECT ', 1)}),
 grid AS (SELECT DISTINCT whole.recording_id || '@' || c AS recording_id FROM whole, cur_),
 cnt AS (SELECT recording_id, COUNT(*) AS events, COUNT(*) FILTER ({DUCK_ERROR}) AS errors, COUNT(*) FILTER (event_type = 'tool.called') AS tools_called, COUNT(*) FILTER (event_type = 'tool.completed') AS tools_completed,
  COUNT(*) FILTER (event_type = 'tool.failed') AS tools_failed, COUNT(*) FILTER (event_type LIKE 'agent.%' OR event_type LIKE 'route.%') AS agent_transitions, COUNT(*) FILTER (event_type = 'agent.spawned' AND agent_id IS NOT NULL) AS agents_spawned,
  COUNT(*) FILTER (event_type = 'agent.completed' AND agent_id IS NOT NULL) AS agents_completed, COUNT(*) FILTER (event_type IN ('kv.pressure', 'guard.budget_pressure')) AS pressure_events FROM ev GROUP BY 1),
 ag AS (SELECT recording_id, COUNT(*) AS agents_active FROM (SELECT recording_id, agent_id, arg_max(event_type, mono_ns) AS s FROM ev WHERE agent_id IS NOT NULL AND event_type IN ('agent.spawned', 'agent.started', 'agent.completed', 'agent.cancelled') GROUP BY 1, 2) WHERE s IN ('agent.spawned', 'agent.started') GROUP BY 1),
 tl AS (SELECT recording_id, COUNT(*) AS tools_active FROM (SELECT recording_id, a_tool_call_id, arg_max(event_type, mono_ns) AS s FROM ev WHERE a_tool_call_id IS NOT NULL AND event_type IN ('tool.called', 'tool.completed', 'tool.failed') GROUP BY 1, 2) WHERE s = 'tool.called' GROUP BY 1),
 dr AS (SELECT recording_id, SUM(n) AS dropped_events FROM (SELECT recording_id, stream, arg_max(n, mono_ns) AS n FROM (SELECT recording_id, stream, mono_ns, COALESCE(a_dropped_count, a_dropped_events) AS n FROM y WHERE event_type = 'telemetry.dropped') WHERE n > 0 GROUP BY 1, 2) GROUP BY 1),
 rq AS (SELECT recording_id, COUNT(*) AS requests, COUNT(*) FILTER (outcome = 'completed') AS requests_completed, COUNT(*) FILTER (outcome = 'failed') AS requests_failed, COUNT(*) FILTER (outcome = 'cancelled') AS requests_cancelled FROM spans GROUP BY 1),
 me AS (SELECT recording_id, MAX(f) AS peak_fraction, arg_max(f, mono_ns) AS latest_fraction FROM (SELECT *, CASE WHEN a_used_bytes IS NOT NULL AND a_total_bytes > 0 THEN a_used_bytes WHEN a_total_bytes > 0 AND a_available_bytes BETWEEN 0 AND a_total_bytes THEN a_total_bytes - a_available_bytes END / a_total_bytes AS f
  FROM ev WHERE event_type = 'device.memory.sample') WHERE f IS NOT NULL GROUP BY 1),
 cu AS (SELECT recording_id, arg_max(a_utilization, mono_ns) AS latest_compute FROM ev WHERE event_type = 'device.compute.sample' AND a_utilization IS NOT NULL GROUP BY 1)
 SELECT recording_id, COALESCE(events, 0) AS events, COALESCE(errors, 0) AS errors, COALESCE(tools_called, 0) AS tools_called, COALESCE(tools_completed, 0) AS tools_completed, COALESCE(tools_failed, 0) AS tools_failed, COALESCE(agent_transitions, 0) AS agent_transitions,
  COALESCE(agents_spawned, 0) AS agents_spawned, COALESCE(agents_completed, 0) AS agents_completed, COALESCE(pressure_events, 0) AS pressure_events, COALESCE(agents_active, 0) AS agents_active, COALESCE(tools_active, 0) AS tools_active,
  CAST(COALESCE(requests, 0) AS BIGINT) AS requests, COALESCE(requests_completed, 0) AS requests_completed, COALESCE(requests_failed, 0) AS requests_failed, COALESCE(requests_cancelled, 0) AS requests_cancelled, CAST(COALESCE(dropped_events, 0) AS DOUBLE) AS dropped_events,
  ROUND(peak_fraction, 6) AS peak_fraction, ROUND(latest_fraction, 6) AS latest_fraction, ROUND(latest_compute, 6) AS latest_compute, COALESCE(lat.count, 0) AS finished, p50_ms, p95_ms, max_ms
 FROM grid LEFT JOIN cnt USING (recording_id) LEFT JOIN ag USING (recording_id) LEFT JOIN tl USING (recording_id) LEFT JOIN dr USING (recording_id) LEFT JOIN rq USING (recording_id) LEFT JOIN me USING (recording_id) LEFT JOIN cu USING (recording_id) LEFT JOIN lat USING (recording_id)"""


@query("metrics_at", _METRICS_AT)
def metrics_at(spark, d):
    ev = core(spark, d)
    out = K.metrics_at(ev, _cursors(ev))
    floats = {"peak_fraction", "latest_fraction", "latest_compute", "p50_ms", "p95_ms", "max_ms"}
    return out.select(*(r6(c) if c in floats else F.col(c) for c in out.columns))


_GRAPH_AT = graph_sql(_at("agents"))


@query("topology_nodes_at", f"{_GRAPH_AT} {NODES_SQL}")
def topology_nodes_at(spark, d):
    ev = agents(spark, d)
    return K.topology_nodes_at(T.mentions(ev), _cursors(ev))


@query("topology_edges_at", f"{_GRAPH_AT} {EDGES_SQL}")
def topology_edges_at(spark, d):
    ev = agents(spark, d)
    return K.topology_edges_at(T.mentions(ev), _cursors(ev))


@query("gpu_at", f"SELECT recording_id, backend_key, backend, samples, latest_event_id, dedicated_bytes, shared_bytes, spilled, fitted_ctx, warning_codes FROM ({ORACLES['gpu_backends'].replace(dt.duck_with('pipe'), _at('pipe'))})")
def gpu_at(spark, d):
    ev = pipe(spark, d)
    return K.gpu_at(ev, _cursors(ev))


@query(
    "report_source",
    f"""{O.EV} SELECT recording_id, COUNT(*) AS exported_events, COUNT(DISTINCT session_id) AS sessions, COUNT(DISTINCT p_name || ' ' || p_version) AS producers, bool_or(COALESCE(p_synthetic, FALSE)) AS synthetic, arg_min(wall_time, mono_ns) AS first_wall_time,
 arg_max(wall_time, mono_ns) AS last_wall_time, MIN(mono_ns) AS origin_mono_ns, ROUND(ROUND((MAX(mono_ns) - MIN(mono_ns)) / 1000000.0::DOUBLE) / 1000.0::DOUBLE, 6) AS duration_s FROM ev WHERE mono_ns BETWEEN 100000000000 AND 2000000000000 GROUP BY 1""",
)
def report_source(spark, d):
    from beaconlake.sources.report import report_source as source

    return source(replay.filter_range(core(spark, d), from_ns=100_000_000_000, to_ns=2_000_000_000_000)).withColumn("duration_s", r6("duration_s"))
