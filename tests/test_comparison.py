"""Two small sessions whose requests have other ids, compared as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconlake.operators.comparison import compare_sessions
from beaconlake.operators.detectors import Config
from events import event, load


def session(lead: str, slow: int, retries: int, tool: str):
    rows, at = [], 0
    for i in range(8):
        rid = {"request_id": f"{lead}{i}"}
        rows.append(event(at, "request.started", **rid))
        rows.append(event(at + 50, "inference.token.generated", {"count": 4}, **rid))
        at += 3000 if i == slow else 300
        rows.append(event(at, "request.completed", **rid))
        at += 100
    rows += [event(at + 10 * i, "retry.scheduled", {"tool_call_id": "c1"}, agent_id="w") for i in range(retries)]
    rows += [event(at + 500, "tool.called", {"tool": tool, "tool_call_id": "c1"}, agent_id="w"), event(at + 600, "tool.failed", {"tool_call_id": "c1"}, agent_id="w")]
    return rows


def shredded(spark, rows):
    """The events with typed attributes, as an events table holds them."""
    return load(spark, rows).withColumn("attributes", F.from_json(F.to_json("attributes"), "count bigint, tool_call_id string, tool string"))


def test_requests_with_other_ids_keep_their_findings(spark):
    a, b = (shredded(spark, session(*how)) for how in (("old", 6, 3, "search"), ("new", 6, 7, "lookup")))
    done = compare_sessions(a, b, config=Config().override(latency={"min_baseline": 3, "min_excess_ms": 100.0}), kinds=("latency-outlier", "retry-storm", "error-burst"))
    totals = {r["metric"]: (r["a"], r["b"], r["verdict"]) for r in done.totals.collect()}
    assert totals["requests"] == (8.0, 8.0, "same") and totals["retries"] == (3.0, 7.0, "worse") and totals["ttft_ms"][2] == "same"
    pairs = {r["a_unit"]: (r["b_unit"], r["status"], r["matched_by"]) for r in done.alignment.collect()}
    assert pairs == {f"old{i}": (f"new{i}", "matched", "position") for i in range(8)}
    rows = {(r["unit"], r["metric"]): r["verdict"] for r in done.rows.collect()}
    assert rows["old3", "ttft_ms"] == "same" and len({u for u, _ in rows}) == 8
    found = {r["signature"].split("|")[0]: r for r in done.findings.collect()}
    slow, storm = found["latency-outlier"], found["retry-storm"]
    assert (slow["status"], slow["severity_change"]) == ("persisting", None) and slow["signature"].endswith("request_id=old6") and slow["b_id"] is not None
    assert (storm["status"], storm["severity_change"]) == ("persisting", "escalated")
    nodes = {r["node_id"]: r["change"] for r in done.nodes.collect()}
    assert nodes["tool:search"] == "removed" and nodes["tool:lookup"] == "added" and nodes["agent:w"] == "same"
    assert {r["change"] for r in done.edges.where(F.col("edge_id").startswith("tool_call")).collect()} == {"added", "removed"}

