"""Agent, model, tool and memory graph derived from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.functions.attrs import Readers
from beaconlake.functions.readings import filled
from beaconlake.operators.scans import Scan, lagged, running
from beaconlake.schema import ord_col
from beaconlake.session import cut_lineage

REC = "recording_id"


def is_topology_event() -> Column:
    t = F.col("event_type")
    return (
        t.startswith("agent.") | t.startswith("route.") | t.startswith("tool.") | t.startswith("memory.retrieval.") | t.startswith("guard.")
        | t.isin("model.load.started", "model.load.completed", "model.unload", "context.forked", "retry.scheduled", "recovery.action")
    )


def call_id(r: Readers) -> Column:
    return F.coalesce(r.extra_text("tool_call_id"), r.name("tool_call_id"))


def resolved_calls(events: DataFrame) -> DataFrame:
    """Topology events with ``call``: the last ``tool.called`` of their call id before them (event_id, agent, tool)."""
    r = Readers(events)
    rows = events.where(is_topology_event()).withColumn("call_id", call_id(r))
    uses = F.col("event_type").startswith("tool.") | F.col("event_type").isin("retry.scheduled", "recovery.action")
    made = F.when(
        (F.col("event_type") == "tool.called") & r.name("tool", "tool_name").isNotNull(),
        F.struct("event_id", filled("agent_id").alias("agent"), r.name("tool", "tool_name").alias("tool")),
    )
    tied = uses & F.col("call_id").isNotNull()
    with_id = running(rows.where(tied).withColumn("__made", made), [REC, "call_id"], [Scan("call", "last", F.col("__made"), inclusive=False)]).drop("__made")
    rest = rows.where(~tied | tied.isNull())
    return with_id.unionByName(rest.withColumn("call", F.lit(None).cast(with_id.schema["call"].dataType)))


# Diagnostic kind of the known guard events.
GUARD_KINDS = {"guard.no_progress": "no_progress", "guard.duplicate_work": "duplicate_work", "guard.budget_pressure": "budget_pressure"}


def _node(cond: Column, kind: str, entity: Column, status: Column | None = None, label: Column | None = None, role: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    value = F.struct(
        F.lit(kind).alias("kind"), entity.alias("entity"), (none if label is None else label).alias("label"),
        (none if role is None else role).alias("role"), (none if status is None else status).alias("status"),
    )
    return F.when(cond & entity.isNotNull(), value)


def _edge(
    cond: Column, kind: str, src: Column, dst: Column, tokens: Column | None, count: int | Column = 1, fail: int | Column = 0, status: Column | None = None
) -> Column:
    lit = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("bigint")
    value = F.struct(
        F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), (F.lit(None).cast("double") if tokens is None else tokens).alias("tokens"),
        lit(count).alias("count"), lit(fail).alias("fail"), (F.lit(None).cast("string") if status is None else status).alias("status"),
    )
    return F.when(cond & src.isNotNull() & dst.isNotNull(), value)


def _diag(cond: Column, kind: Column | str, node: Column) -> Column:
    return F.when(cond, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), node.alias("node")))


def _id(kind: str, entity: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), entity)


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def mentions(events: DataFrame) -> DataFrame:
    """Topology events with the nodes, edges and diagnostics each of them states."""
    r = Readers(events)
    t = F.col("event_type")
    agent, call = filled("agent_id"), F.col("call")
    tokens = r.num("tokens", "token_count", "transferred_tokens")
    me = _id("agent", agent)
    to = r.name("to_agent_id", "to", "target_agent_id")
    is_agent, is_message = t.startswith("agent."), t == "agent.message"
    parent = r.name("parent", "parent_agent_id")
    agent_state = (
        F.when(t == "agent.spawned", "pending").when(t == "agent.started", "active").when(t == "agent.completed", "completed")
        .when(t == "agent.cancelled", "cancelled").when(t.endswith(".failed"), "failed")
    )
    no = F.lit(None).cast("string")
    own = F.when(~is_message, F.lit(True))

    is_route = t.startswith("route.")
    instance = F.coalesce(filled("model_instance_id"), r.name("model_instance_id", "to_model"))
    provider = F.when(instance.isNull(), r.name("to_provider", "provider"))
    target = F.coalesce(instance, provider)
    named = F.when(t == "route.selected", F.concat(provider, F.lit(" · "), r.name("model")))
    routed = is_route & target.isNotNull() & (agent.isNotNull() | provider.isNotNull())
    came_from = r.name("from_model", "previous_model_instance_id", "from_provider")
    moved = routed & (t == "route.changed") & came_from.isNotNull() & (came_from != target)

    is_model = t.startswith("model.")
    model_state = F.when(t == "model.load.started", "loading").when(t == "model.load.completed", "active").when(t == "model.unload", "unloaded")

    is_tool, called = t.startswith("tool."), t == "tool.called"
    tool = r.name("tool", "tool_name")
    known = is_tool & ~called & call.isNotNull()
    unknown = is_tool & ~called & call.isNull() & tool.isNotNull()
    failed = t == "tool.failed"
    tool_state = F.when(called, "active").when(t == "tool.completed", "completed").when(failed, "failed")
    edge_state = F.when(called, "active").when(t == "tool.completed", "ok").when(failed, "failed")
    failures = F.when(failed, 1).otherwise(0)
    tool_named = F.when(is_tool & (called | unknown), tool).when(known, F.col("call.tool"))

    is_memory = t.startswith("memory.retrieval.")
    store = r.name("store", "memory_store", "store_id")
    started, lost = t == "memory.retrieval.started", t.endswith(".failed")
    memory_state = F.when(started, "active").when(lost, "failed").otherwise("completed")

    forked = t == "context.forked"
    fork_from = F.coalesce(agent, r.name("from_agent_id", "source_agent_id"))
    fork_to = r.name("to_agent_id", "target_agent_id")
    fork = forked & fork_from.isNotNull() & fork_to.isNotNull()

    retry, recovery, guard = t == "retry.scheduled", t == "recovery.action", t.startswith("guard.")
    target_agent, target_model = r.name("target_agent_id"), r.name("target_model")
    retry_call = retry & agent.isNotNull() & call.isNotNull()
    retry_agent = retry & agent.isNotNull() & call.isNull() & target_agent.isNotNull()
    healed = recovery & agent.isNotNull()
    heal_to = F.coalesce(_id("agent", target_agent), _id("model", target_model), _id("tool", F.col("call.tool")))
    guard_kind = F.lit("guard")
    for name, kind in GUARD_KINDS.items():
        guard_kind = F.when(t == name, kind).otherwise(guard_kind)

    nodes = _present(
        _node(is_agent, "agent", agent, F.when(own, agent_state), F.when(own, r.name("name")), F.when(own, r.name("role"))),
        _node(is_message & agent.isNotNull(), "agent", to),
        _node((t == "agent.spawned") & agent.isNotNull(), "agent", parent),
        _node(is_route & target.isNotNull(), "agent", agent),
        _node(routed, "model", target, F.when(agent.isNull(), "active"), named),
        _node(moved, "model", came_from),
        _node(is_model, "model", filled("model_instance_id"), model_state, r.name("model")),
        _node((called & tool.isNotNull()) | unknown, "agent", agent),
        _node(is_tool, "tool", tool_named, tool_state),
        _node(is_memory, "memory", store, memory_state),
        _node(is_memory, "agent", agent),
        _node(fork, "agent", fork_from),
        _node(fork, "agent", fork_to),
        _node(retry | recovery | guard, "agent", agent),
        _node(retry_call, "tool", F.col("call.tool")),
        _node(retry_agent, "agent", target_agent),
        _node(healed, "agent", target_agent),
        _node(healed & target_agent.isNull(), "model", target_model),
    )
    by_agent = F.when(known, _id("agent", F.col("call.agent"))).otherwise(me)
    edges = _present(
        _edge(is_message, "message", me, _id("agent", to), tokens),
        _edge(t == "agent.spawned", "delegation", _id("agent", parent), me, tokens),
        _edge(routed, "route", me, _id("model", target), tokens, 1, 0, F.lit("active")),
        _edge(moved, "route_change", _id("model", came_from), _id("model", target), tokens),
        # A completion found through its call cites the edge without adding tokens.
        _edge(is_tool, "tool_call", by_agent, _id("tool", tool_named), F.when(~known, tokens), F.when(called, 1).otherwise(0), failures, edge_state),
        _edge(
            is_memory, "memory_retrieval", me, _id("memory", store), tokens, F.when(started, 1).otherwise(0), F.when(lost, 1).otherwise(0),
            F.when(started, "active").when(lost, "failed").otherwise("ok"),
        ),
        _edge(fork, "context_transfer", _id("agent", fork_from), _id("agent", fork_to), tokens),
        _edge(retry_call, "retry", me, _id("tool", F.col("call.tool")), tokens),
        _edge(retry_agent, "retry", me, _id("agent", target_agent), tokens),
        _edge(healed, "recovery", me, heal_to, tokens),
    )
    diags = _present(
        _diag(is_agent & t.endswith(".failed") & agent.isNotNull(), "failure", me),
        _diag(failed & tool_named.isNotNull(), "failure", _id("tool", tool_named)),
        _diag(retry, "retry", me),
        _diag(retry_call, "retry", _id("tool", F.col("call.tool"))),
        _diag(recovery, "recovery", me),
        _diag(guard, guard_kind, me),
    )
    rows = resolved_calls(events)
    return rows.select(REC, "mono_ns", "sequence", "event_id", "event_type", "agent_id", nodes.alias("nodes"), edges.alias("edges"), diags.alias("diags"))


def node_mentions(stated: DataFrame) -> DataFrame:
    """Nodes stated by events; ``place`` orders the mentions of one event."""
    rows = stated.select(REC, "mono_ns", "sequence", "event_id", F.posexplode("nodes").alias("place", "n"))
    return rows.select(REC, "mono_ns", "sequence", "event_id", "place", F.concat("n.kind", F.lit(":"), "n.entity").alias("node_id"), "n.*")


def edge_mentions(stated: DataFrame) -> DataFrame:
    """Edges stated by events, and superseded routes: the next route of the agent to another target closes the edge."""
    rows = stated.select(REC, "mono_ns", "sequence", "event_id", F.explode("edges").alias("e")).select(REC, "mono_ns", "sequence", "event_id", "e.*")
    routes = lagged(rows.where("kind = 'route'"), [REC, "src"], {"was": F.col("dst")})
    closed = routes.where(F.col("was").isNotNull() & (F.col("was") != F.col("dst"))).select(
        REC, "mono_ns", "sequence", "event_id", "kind", "src", F.col("was").alias("dst"), F.lit(None).cast("double").alias("tokens"),
        F.lit(0).cast("bigint").alias("count"), F.lit(0).cast("bigint").alias("fail"), F.lit("superseded").alias("status"),
    )
    all_ = rows.unionByName(closed)
    return all_.withColumn("edge_id", F.concat("kind", F.lit(":"), "src", F.lit("->"), "dst"))


def topology_nodes(stated: DataFrame) -> DataFrame:
    """Nodes with first and last time, label, role and status; their evidence is :func:`node_mentions`."""
    at = ord_col()
    known = lambda c: F.when(c.isNotNull(), at)
    label = F.when(F.col("label") != F.col("entity"), F.col("label"))
    firm = F.when(F.col("status") != "pending", F.col("status"))
    folded = node_mentions(stated).groupBy(REC, "node_id", "kind", "entity").agg(
        F.min_by(label, known(label)).alias("label"), F.max_by("role", known(F.col("role"))).alias("role"), F.max_by(firm, known(firm)).alias("firm"),
        F.max(F.coalesce(F.col("status") == "pending", F.lit(False))).alias("pending"), F.min("mono_ns").alias("first_ns"), F.max("mono_ns").alias("last_ns"),
        F.count(F.lit(1)).alias("mentions"),
    )
    # A spawn makes an agent pending only while nothing else is known of it.
    status = F.coalesce("firm", F.when(F.col("pending"), "pending"), F.lit("unknown"))
    return folded.select(
        REC, "node_id", "kind", F.col("entity").alias("entity_id"), F.coalesce("label", "entity").alias("label"), "role", status.alias("status"), "first_ns", "last_ns", "mentions"
    )


def topology_edges(stated: DataFrame) -> DataFrame:
    at = ord_col()
    started = F.when(F.col("count") > 0, at)
    done = F.when(F.col("status") == "ok", at)
    folded = edge_mentions(stated).groupBy(REC, "edge_id", "kind", "src", "dst").agg(
        F.sum("count").alias("count"), F.sum("fail").alias("failures"), F.sum("tokens").alias("tokens"),
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"), F.min("mono_ns").alias("first_ns"), F.max("mono_ns").alias("last_ns"),
        F.min(started).alias("s"), F.min(done).alias("d"),
    )
    # A retrieval completed before any start of its edge counts once.
    early = (F.col("kind") == "memory_retrieval") & F.col("d").isNotNull() & (F.col("s").isNull() | (F.col("d") < F.col("s")))
    return folded.select(
        REC, "edge_id", "kind", F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("status", F.lit("active")).alias("status"),
        (F.col("count") + F.when(early, 1).otherwise(0)).alias("count"), "failures", "tokens", "first_ns", "last_ns",
    )


def topology_diagnostics(stated: DataFrame) -> DataFrame:
    """All diagnostics; ``node_id`` is null where the event names no agent."""
    rows = stated.select(REC, "mono_ns", "event_id", "event_type", F.explode("diags").alias("d"))
    return rows.select(REC, "mono_ns", "event_id", "event_type", "d.kind", F.col("d.node").alias("node_id"))


def unmapped_events(stated: DataFrame) -> DataFrame:
    """Topology events that state nothing because a required id is missing."""
    return stated.where((F.size("nodes") == 0) & (F.size("edges") == 0) & (F.size("diags") == 0)).select(REC, "event_id", "event_type", "mono_ns")


def topology_counts(events: DataFrame, stated: DataFrame) -> DataFrame:
    considered = events.groupBy(REC).agg(F.count(F.lit(1)).alias("considered"))
    said = (F.size("nodes") > 0) | (F.size("edges") > 0) | (F.size("diags") > 0)
    mapped = stated.groupBy(REC).agg(F.count_if(said).alias("mapped"), F.count_if(~said).alias("unmapped"))
    return considered.join(mapped, REC, "left").fillna(0)


def evidence_for(stated: DataFrame, selected_id: str) -> DataFrame:
    """Evidence events of one node or edge id."""
    columns = [REC, "event_id", "mono_ns", "sequence"]
    nodes = node_mentions(stated).where(F.col("node_id") == selected_id).select(*columns)
    return nodes.unionByName(edge_mentions(stated).where(F.col("edge_id") == selected_id).select(*columns)).distinct()


def agent_order(stated: DataFrame) -> DataFrame:
    """Agents with ``seen``, the place of their first mention: replay order, then the order inside the event."""
    seen = F.struct("mono_ns", "sequence", "event_id", "place", "node_id")
    return node_mentions(stated).where("kind = 'agent'").groupBy(REC, "node_id").agg(F.min(seen).alias("seen"))


def delegation_depth(stated: DataFrame) -> DataFrame:
    """Depth of every agent below the delegation roots (depth 0).

    Chains of agents that one agent each spawned are jumped by doubling (:func:`_from_roots`). Agents that no root
    reaches hang on a cycle; each of them belongs to the first-seen agent that
    reaches it, found by spreading the smallest first-seen order along the edges.
    A spawn mentions the spawned agent before the one that spawned it.
    """
    agents = cut_lineage(agent_order(stated))
    spawned = stated.select(REC, F.explode("edges").alias("e")).where("e.kind = 'delegation'")
    links = cut_lineage(spawned.select(REC, F.col("e.src").alias("source"), F.col("e.dst").alias("target")).distinct())
    children = links.select(REC, F.col("target").alias("node_id")).distinct()
    roots = agents.join(children, [REC, "node_id"], "left_anti").select(REC, "node_id", F.lit(0).alias("depth"))
    reached = _from_roots(agents.select(REC, "node_id"), roots.select(REC, "node_id"), links)

    left = cut_lineage(agents.join(reached, [REC, "node_id"], "left_anti").withColumn("owner", F.col("seen")))
    if left.isEmpty():
        return reached
    inner = links.join(left.select(REC, F.col("node_id").alias("source")), [REC, "source"], "left_semi")
    inner = cut_lineage(inner.join(left.select(REC, F.col("node_id").alias("target")), [REC, "target"], "left_semi"))
    while True:
        offers = inner.join(left.select(REC, F.col("node_id").alias("source"), "owner"), [REC, "source"]).groupBy(REC, F.col("target").alias("node_id")).agg(
            F.min("owner").alias("offer")
        )
        spread = left.join(offers, [REC, "node_id"], "left").select(
            REC, "node_id", "seen", F.least("owner", "offer").alias("owner"), F.coalesce(F.col("offer") < F.col("owner"), F.lit(False)).alias("changed")
        )
        spread = cut_lineage(spread)
        changed = not spread.where("changed").isEmpty()
        left = spread.drop("changed")
        if not changed:
            break
    starts = left.where(F.col("owner.node_id") == F.col("node_id")).select(REC, "node_id", F.lit(0).alias("depth"))
    return reached.unionByName(_breadth_first(starts, inner, left.select(REC, "node_id", "owner")))


def _chain_tops(agents: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, top, dist): the nearest agent above that has no spawner or several, and the steps to it.

    An agent with one spawner points at it; pointers are doubled, so a chain of n agents takes log n rounds. Those that circle never arrive and are left out.
    """
    one = links.groupBy(REC, F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("spawners"), F.min("source").alias("by")).where("spawners = 1")
    state = agents.join(one, [REC, "node_id"], "left").select(REC, "node_id", F.coalesce("by", "node_id").alias("top"), F.when(F.col("by").isNull(), 0).otherwise(1).cast("bigint").alias("dist"), F.col("by").isNotNull().alias("open"))
    state = cut_lineage(state)
    for _ in range(max(1, state.count()).bit_length() + 1):
        above = state.select(REC, F.col("node_id").alias("top"), F.col("top").alias("higher"), F.col("dist").alias("more"), F.col("open").alias("goes_on"))
        step = state.where("open").join(above, [REC, "top"])
        moved = step.select(REC, "node_id", F.col("higher").alias("top"), (F.col("dist") + F.col("more")).alias("dist"), F.col("goes_on").alias("open"))
        state = cut_lineage(state.where("NOT open").unionByName(moved))
        if state.where("open").isEmpty():
            break
    return state.where("NOT open").select(REC, "node_id", "top", "dist")


def _from_roots(agents: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Shortest distance of every agent that a root reaches.

    Chains shrink to one weighted step between the agents that end them; distances are relaxed over those alone, as often as a shortest path meets
    an agent with several spawners.
    """
    tops = cut_lineage(_chain_tops(agents, links))
    joints = links.groupBy(REC, F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("spawners")).where("spawners > 1").select(REC, "node_id")
    into = links.join(joints.withColumnRenamed("node_id", "target"), [REC, "target"]).join(tops.withColumnRenamed("node_id", "source"), [REC, "source"])
    steps = cut_lineage(into.groupBy(REC, "top", "target").agg((F.min("dist") + 1).alias("cost")))
    near = cut_lineage(roots.withColumn("depth", F.lit(0).cast("bigint")).withColumn("new", F.lit(True)))
    while True:
        offers = near.where("new").select(REC, F.col("node_id").alias("top"), "depth").join(steps, [REC, "top"])
        offers = offers.groupBy(REC, F.col("target").alias("node_id")).agg(F.min(F.col("depth") + F.col("cost")).alias("offer"))
        both = near.select(REC, "node_id", "depth").join(offers, [REC, "node_id"], "full_outer")
        better = F.col("offer").isNotNull() & (F.col("depth").isNull() | (F.col("offer") < F.col("depth")))
        near = cut_lineage(both.select(REC, "node_id", F.when(better, F.col("offer")).otherwise(F.col("depth")).alias("depth"), better.alias("new")))
        if near.where("new").isEmpty():
            break
    return tops.join(near.select(REC, F.col("node_id").alias("top"), "depth"), [REC, "top"]).select(REC, "node_id", (F.col("depth") + F.col("dist")).cast("int").alias("depth"))


def _breadth_first(starts: DataFrame, links: DataFrame, owners: DataFrame | None) -> DataFrame:
    """Shortest distance from the start nodes; with ``owners`` paths stay inside one owner."""
    if owners is not None:
        a = owners.select(REC, F.col("node_id").alias("source"), F.col("owner").alias("so"))
        b = owners.select(REC, F.col("node_id").alias("target"), F.col("owner").alias("to"))
        links = links.join(a, [REC, "source"]).join(b, [REC, "target"]).where("so = to").select(REC, "source", "target")
    hops = links.select(REC, F.col("source").alias("node_id"), F.col("target").alias("next_id"))
    reached, level = cut_lineage(starts), 0
    while True:
        step = reached.where(F.col("depth") == level).join(hops, [REC, "node_id"]).select(REC, F.col("next_id").alias("node_id")).distinct()
        fresh = step.join(reached.select(REC, "node_id"), [REC, "node_id"], "left_anti").withColumn("depth", F.lit(level + 1))
        grown = cut_lineage(reached.unionByName(fresh))
        if grown.where(F.col("depth") == level + 1).isEmpty():
            return grown
        reached, level = grown, level + 1
