"""State at cursors: what is read several times is stored once, and gives the state of each prefix."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from beaconlake.operators import cursors as K
from beaconlake.operators import topology as T
from beaconlake.operators.replay import at_cursors
from beaconlake.plans import driver_tables as dt
from beaconlake.session import short_methods
from events import event, load

LIMIT = "spark.sql.codegen.hugeMethodLimit"


@pytest.fixture
def table(spark, tmp_path):
    """A recording as a table of files, and three cursors in it."""
    rows = [
        event(1, "request.started", request_id="q"), event(2, "agent.spawned", {"parent": "a0"}, agent_id="a1"), event(3, "inference.token.generated", request_id="q"),
        event(4, "tool.called", {"tool": "t", "tool_call_id": "c"}, agent_id="a1"), event(5, "request.completed", request_id="q"), event(6, "tool.completed", {"tool_call_id": "c"}),
        event(7, "agent.completed", agent_id="a1"), event(8, "route.selected", {"provider": "v"}, agent_id="a0"), event(9, "route.selected", {"provider": "w"}, agent_id="a0"),
    ]
    members = F.from_json(F.to_json("attributes"), "parent string, tool string, tool_call_id string, provider string")
    load(spark, rows).withColumn("attributes", members).drop("extra").write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    cursors = spark.createDataFrame([("rec", i, ns * 1_000_000) for i, ns in enumerate((0, 4, 9))], "recording_id string, cursor_id bigint, at_ns bigint")
    return events, cursors, f"{tmp_path}/events"


def test_metrics_at_reads_events_once(spark, table):
    events, cursors, path = table
    out = K.metrics_at(events, cursors)
    assert not [f for f in out.inputFiles() if path in f]
    got = {r["recording_id"]: r for r in out.collect()}
    columns = ("events", "tools_called", "tools_completed", "agents_active", "tools_active", "requests", "requests_completed", "finished", "p50_ms")
    assert [tuple(got[f"rec@{i}"][c] for c in columns) for i in range(3)] == [(0, 0, 0, 0, 0, 0, 0, 0, None), (4, 1, 0, 1, 1, 1, 0, 0, None), (9, 1, 1, 0, 0, 1, 1, 1, 4.0)]


@pytest.mark.parametrize("state, whole", [(K.topology_nodes_at, T.topology_nodes), (K.topology_edges_at, T.topology_edges)])
def test_topology_at_states_mentions_once(spark, table, state, whole):
    events, cursors, path = table
    out = state(T.mentions(events), cursors)
    assert not [f for f in out.inputFiles() if path in f]
    prefixes = at_cursors(events, cursors.withColumn("cursor_id", F.col("cursor_id").cast("string")))
    expect = whole(T.mentions(prefixes)).select(*out.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, expect.collect())) != []


def test_rows_are_ranged_before_they_are_mapped(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i % 7), i % 5, ("signup", "click", None)[i % 3], 1.5 * i, '{"k": %d}' % i) for i in range(40)]
    spark.createDataFrame(rows + rows[:3] + [(None, None, None, None, None, None)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    plan = dt._mapped(spark, str(tmp_path), dt.CORE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("attributes") < plan.index("RepartitionByExpression") and "attributes" not in plan[plan.index("RepartitionByExpression"):]
    held = spark.conf.get(LIMIT)
    stored = dt.core_events(spark, str(tmp_path))
    assert spark.conf.get(LIMIT) == held
    assert sorted(map(str, stored.collect())) == sorted(map(str, dt._mapped(spark, str(tmp_path), dt.CORE).select(*stored.columns).collect()))


def test_long_methods_are_cut_only_inside(spark):
    held = spark.conf.get(LIMIT)
    with pytest.raises(ValueError), short_methods(spark):
        assert spark.conf.get(LIMIT) == "8000"
        raise ValueError
    assert spark.conf.get(LIMIT) == held
