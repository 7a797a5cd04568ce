"""State of a recording at each of many cursors, with the events read once.

Cursors cut a recording into intervals. Every event belongs to the interval that ends at the first cursor not before it; events of one interval
are folded to one partial state per entity, combined before the shuffle, and the state at a cursor is the prefix of the partial states up to
it. An entity has a row for each interval that changes it, valid until its next one, so the work follows the events and the changes, not cursors times events.
Totals over entities are prefix sums of what each change adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.classify import is_error
from beaconlake.functions.identity import with_stream
from beaconlake.operators import gpu
from beaconlake.operators import topology as T
from beaconlake.operators.metrics import OCTAVE_BUCKETS, call_id
from beaconlake.operators.scans import Scan, running
from beaconlake.schema import ord_col
from beaconlake.session import stored

REC = "recording_id"
_PLACE = ("mono_ns", "side", "sequence", "event_id")


@dataclass(frozen=True)
class Fold:
    """One mergeable value: sum, min, max, or the first or last known value in replay order."""

    out: str
    kind: str
    value: Column

    def partial(self) -> Column:
        if self.kind in ("first", "last"):
            return (F.min if self.kind == "first" else F.max)(F.when(self.value.isNotNull(), F.struct(ord_col().alias("at"), self.value.alias("v")))).alias(self.out)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value).alias(self.out)

    def prefix(self, window) -> Column:
        merge = {"sum": F.sum, "min": F.min, "max": F.max, "first": F.min, "last": F.max}[self.kind](self.out).over(window)
        return (merge["v"] if self.kind in ("first", "last") else merge).alias(self.out)


def numbered(cursors: DataFrame) -> DataFrame:
    """Cursors (``recording_id, cursor_id, at_ns``) with their number ``n`` in their recording and the ``last`` number."""
    of = Window.partitionBy(REC)
    return cursors.withColumn("n", F.row_number().over(of.orderBy("at_ns", "cursor_id")).cast("bigint")).withColumn("last", F.count(F.lit(1)).over(of))


def in_intervals(rows: DataFrame, cursors: DataFrame) -> DataFrame:
    """``rows`` with the number ``n`` of the first cursor at or after them; rows after the last cursor are left out.

    ``cursors`` come from :func:`numbered`. Rows need the replay position; only narrow rows should pass here, as they are shuffled.
    """
    columns = rows.columns
    marks = cursors.select(REC, F.col("at_ns").alias("mono_ns"), F.lit(1).alias("side"), F.col("n").alias("sequence"), F.lit("").alias("event_id"), "n")
    both = rows.withColumn("side", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    found = running(both, [REC], [Scan("__n", "next", F.col("n"))], order=_PLACE)
    return found.where("side = 0 AND __n IS NOT NULL").select(*columns, F.col("__n").alias("n"))


def prefix_states(rows: DataFrame, keys: list[str], folds: list[Fold]) -> DataFrame:
    """Per key and interval that changes it: the folds over all rows up to it, valid for cursors ``n`` to before ``until``."""
    partial = rows.groupBy(*keys, "n").agg(*(f.partial() for f in folds))
    order = Window.partitionBy(*keys).orderBy("n")
    return partial.select(*keys, "n", F.lead("n").over(order).alias("until"), *(f.prefix(order) for f in folds))


def at_each(states: DataFrame, cursors: DataFrame) -> DataFrame:
    """States at every cursor they hold at: ``recording_id`` becomes ``<recording>@<cursor>``. As many rows as the result has."""
    span = states.join(cursors.select(REC, "last").distinct(), REC)
    each = span.withColumn("n", F.explode(F.sequence("n", F.coalesce(F.col("until") - 1, F.col("last"))))).drop("until", "last")
    named = each.join(cursors.select(REC, "n", "cursor_id"), [REC, "n"])
    return named.withColumn(REC, F.concat(REC, F.lit("@"), F.col("cursor_id").cast("string"))).drop("n", "cursor_id")


def _steps(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """(recording_id, n, out): what the last known ``value`` of each key adds to the recording's total at each of its changes."""
    states = prefix_states(rows, keys, [Fold("v", "last", value)])
    before = F.coalesce(F.lag("v").over(Window.partitionBy(*keys).orderBy("n")), F.lit(0))
    return states.select(REC, "n", (F.coalesce("v", F.lit(0)) - before).alias(out))


def _narrow(events: DataFrame) -> DataFrame:
    """What the counters read of an event."""
    r, t, named = Readers(events), F.col("event_type"), R.filled("agent_id").isNotNull()
    tool = F.when(t.isin("tool.called", "tool.completed", "tool.failed"), F.substring_index(t, ".", -1))
    life = F.when(named & t.isin("agent.spawned", "agent.started"), 1).when(named & t.isin("agent.completed", "agent.cancelled"), 0)
    usage = F.when(t == "device.memory.sample", R.memory_usage(r))
    load = F.when(t == "device.compute.sample", r.num("utilization"))
    asks = R.filled("request_id").isNotNull()
    outcome = F.when(asks & t.isin(*R.OUTCOMES), F.substring_index(t, ".", -1))
    output = t == "inference.token.generated"
    rows = with_stream(events).select(
        REC, "mono_ns", "sequence", "event_id", "stream", F.when(asks, F.col("request_id")).alias("request_id"), is_error().alias("error"), tool.alias("tool"),
        F.when(tool.isNotNull(), call_id(r)).alias("call_id"), F.when(named, F.col("agent_id")).alias("agent_id"), life.alias("life"),
        (t.startswith("agent.") | t.startswith("route.")).alias("moves"), (named & (t == "agent.spawned")).alias("spawned"), (named & (t == "agent.completed")).alias("completed"),
        t.isin("kv.pressure", "guard.budget_pressure").alias("pressure"), usage.alias("u"), load.alias("load"),
        F.when(t == "telemetry.dropped", R.dropped_count(r)).alias("dropped"), (asks & (t == "request.started")).alias("starts"), outcome.alias("outcome"),
        F.when(asks & output, R.output_token_count(r)).alias("tokens"),
    )
    return rows.withColumn("fraction", F.when(F.col("u.used").isNotNull(), F.col("u.fraction"))).drop("u")


def request_visits(rows: DataFrame) -> DataFrame:
    """Started instances of requests: seen from cursor ``n`` to before ``until``, ended from ``n_end`` on, with latency and outcome.

    At a cursor a request is the latest instance started by then; one that is superseded before the next cursor is never seen.
    """
    key = [REC, "stream", "request_id"]
    asked = rows.where(F.col("request_id").isNotNull() & (F.col("starts") | F.col("outcome").isNotNull() | F.col("tokens").isNotNull()))
    one = F.when(F.col("starts"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    instances = running(asked, key, [Scan("instance", "sum", one)]).where("instance > 0")
    ended = F.when(F.col("outcome").isNotNull(), F.struct(ord_col().alias("at"), "n", "outcome"))
    folded = instances.groupBy(*key, "instance").agg(F.min(F.when(F.col("starts"), F.struct("mono_ns", "n"))).alias("s"), F.min(ended).alias("e"))
    until = F.lead("s.n").over(Window.partitionBy(*key).orderBy("instance"))
    return folded.select(*key, "instance", F.col("s.n").alias("n"), until.alias("until"), F.col("e.n").alias("n_end"), F.col("e.outcome").alias("outcome"), (F.col("e.at.mono_ns") - F.col("s.mono_ns")).alias("ns")).where("until IS NULL OR until > n")


def _validity(visits: DataFrame, since: str, out: str, when: Column | None = None) -> DataFrame:
    """+1 where a visit begins to count, -1 where it ends."""
    rows = visits.where(F.col(since).isNotNull() & (F.col("until").isNull() | (F.col(since) < F.col("until"))))
    rows = rows if when is None else rows.where(when)
    both = F.array(F.struct(F.col(since).alias("n"), F.lit(1).alias("d")), F.struct(F.col("until").alias("n"), F.lit(-1).alias("d")))
    return rows.select(REC, F.explode(both).alias("c")).select(REC, "c.n", F.col("c.d").alias(out)).where("n IS NOT NULL")


def latency_at(visits: DataFrame, cursors: DataFrame, percentiles: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(recording_id, n, count, p50_ns, p95_ns, max_ns) of the finished requests at each cursor, exact nearest ranks.

    Histograms by 1/1024 octave are summed along the cursors; the bucket that holds a rank is chosen for each cursor, and only its values are ordered.
    """
    done = visits.where("n_end IS NOT NULL AND (until IS NULL OR n_end < until)").select(REC, "ns", F.greatest("n", "n_end").alias("since"), "until")
    done = done.withColumn("b", F.floor(F.log2(F.greatest("ns", F.lit(0)) + 1) * OCTAVE_BUCKETS).cast("bigint"))
    change = F.array(F.struct(F.col("since").alias("n"), F.lit(1).alias("d")), F.struct(F.col("until").alias("n"), F.lit(-1).alias("d")))
    steps = done.select(REC, "b", F.explode(change).alias("c")).where("c.n IS NOT NULL").groupBy(REC, "b", F.col("c.n").alias("n")).agg(F.sum("c.d").alias("d"))
    order = Window.partitionBy(REC, "b").orderBy("n")
    held = steps.select(REC, "b", "n", F.lead("n").over(order).alias("until"), F.sum("d").over(order).alias("m")).where("m > 0")
    limits = cursors.select(REC, "last").distinct()
    held = held.join(limits, REC).withColumn("n", F.explode(F.sequence("n", F.coalesce(F.col("until") - 1, F.col("last"))))).select(REC, "n", "b", "m")
    at = Window.partitionBy(REC, "n")
    summed = held.withColumn("upto", F.sum("m").over(at.orderBy("b"))).withColumn("count", F.sum("m").over(at))
    rank = lambda p: F.greatest(F.ceil(F.lit(p / 100.0) * F.col("count")), F.lit(1))
    pick = lambda name, r: F.struct(F.lit(name).alias("p"), F.min(F.when(F.col("upto") >= r, F.struct("b", (r - F.col("upto") + F.col("m")).alias("left")))).alias("at"))
    picks = F.array(*(pick(f"p{p}", rank(p)) for p in percentiles), pick("max", F.col("count")))
    chosen = summed.groupBy(REC, "n", "count").agg(picks.alias("w")).select(REC, "n", "count", F.explode("w").alias("w"))
    chosen = chosen.select(REC, "n", "count", F.col("w.p").alias("p"), F.col("w.at.b").alias("b"), F.col("w.at.left").alias("left"))
    near = chosen.join(done, [REC, "b"]).where((F.col("since") <= F.col("n")) & (F.col("until").isNull() | (F.col("until") > F.col("n"))))
    place = F.row_number().over(Window.partitionBy(REC, "n", "p").orderBy("ns"))
    found = near.withColumn("place", place).where("place = left")
    value = lambda name: F.max(F.when(F.col("p") == name, F.col("ns"))).alias(f"{name}_ns")
    return found.groupBy(REC, "n").agg(F.max("count").alias("count"), *(value(f"p{p}") for p in percentiles), value("max"))


def metrics_at(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Counters, resources and request latency of a recording at each cursor (``recording_id, cursor_id, at_ns``), one row each.

    The recording at a cursor holds the events not after it. A value without evidence is null, a counter without events 0.
    """
    marks = numbered(cursors)
    rows = stored(in_intervals(_narrow(events), marks), "at-cursors")
    count = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    tools = [Fold(f"tools_{n}", "sum", count(F.col("tool").eqNullSafe(n))) for n in ("called", "completed", "failed")]
    folds = [
        Fold("events", "sum", F.lit(1).cast("bigint")), Fold("errors", "sum", count(F.col("error"))), *tools, Fold("agent_transitions", "sum", count(F.col("moves"))),
        Fold("agents_spawned", "sum", count(F.col("spawned"))), Fold("agents_completed", "sum", count(F.col("completed"))), Fold("pressure_events", "sum", count(F.col("pressure"))),
        Fold("peak_fraction", "max", F.col("fraction")), Fold("latest_fraction", "last", F.col("fraction")), Fold("latest_compute", "last", F.col("load")),
    ]
    plain = prefix_states(rows, [REC], folds)
    visits = stored(request_visits(rows), "visits")
    totals = {
        "agents_active": _steps(rows.where("life IS NOT NULL"), [REC, "agent_id"], F.col("life"), "agents_active"),
        "tools_active": _steps(rows.where("call_id IS NOT NULL"), [REC, "call_id"], F.when(F.col("tool") == "called", 1).otherwise(0), "tools_active"),
        "dropped_events": _steps(rows.where("dropped IS NOT NULL"), [REC, "stream"], F.col("dropped"), "dropped_events"),
        "requests": _validity(visits, "n", "requests"),
        **{f"requests_{o}": _validity(visits, "n_end", f"requests_{o}", F.col("outcome") == o) for o in ("completed", "failed", "cancelled")},
    }
    changes = [d.select(REC, "n", F.lit(name).alias("what"), F.col(name).cast("double").alias("d")) for name, d in totals.items()]
    whole = changes[0]
    for d in changes[1:]:
        whole = whole.unionByName(d)
    per = whole.groupBy(REC, "n").agg(*(F.sum(F.when(F.col("what") == name, F.col("d"))).alias(name) for name in totals))
    upto = Window.partitionBy(REC).orderBy("n")  # one row per cursor
    grid = marks.select(REC, "n", "cursor_id").join(per, [REC, "n"], "left")
    grid = grid.select(REC, "n", "cursor_id", *(F.coalesce(F.sum(name).over(upto), F.lit(0.0)).alias(name) for name in totals))
    names = [f.out for f in folds]
    limits = marks.select(REC, "last").distinct()
    filled = plain.join(limits, REC).withColumn("n", F.explode(F.sequence("n", F.coalesce(F.col("until") - 1, F.col("last"))))).select(REC, "n", *names)
    out = grid.join(filled, [REC, "n"], "left").join(latency_at(visits, marks), [REC, "n"], "left")
    counters = [f.out for f in folds if f.kind == "sum"]
    whole_numbers = [name for name in totals if name != "dropped_events"]
    return out.select(
        F.concat(REC, F.lit("@"), F.col("cursor_id").cast("string")).alias(REC), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counters),
        *(F.col(c).cast("bigint").alias(c) for c in whole_numbers), "dropped_events", "peak_fraction", "latest_fraction", "latest_compute",
        F.coalesce("count", F.lit(0)).cast("bigint").alias("finished"), *((F.col(f"{c}_ns") / 1e6).alias(f"{c}_ms") for c in ("p50", "p95", "max")),
    )


def topology_nodes_at(stated: DataFrame, cursors: DataFrame) -> DataFrame:
    """Nodes of :func:`topology.topology_nodes` at each cursor; ``stated`` comes from ``topology.mentions``.

    A tool's end whose call comes only after a cursor is told apart there by its own names alone in the prefix; here it keeps the call's.
    """
    marks = numbered(cursors)
    label = F.when(F.col("label") != F.col("entity"), F.col("label"))
    said = T.node_mentions(stated).withColumn("label", label).withColumn("firm", F.when(F.col("status") != "pending", F.col("status"))).withColumn("wait", F.coalesce(F.col("status") == "pending", F.lit(False)))
    said = stored(said.select(REC, "mono_ns", "sequence", "event_id", "node_id", "kind", "entity", "label", "role", "firm", "wait"), "nodes")
    rows = in_intervals(said, marks)
    states = prefix_states(rows, [REC, "node_id", "kind", "entity"], [
        Fold("label", "first", F.col("label")), Fold("role", "last", F.col("role")), Fold("firm", "last", F.col("firm")), Fold("pending", "max", F.col("wait")),
        Fold("first_ns", "min", F.col("mono_ns")), Fold("last_ns", "max", F.col("mono_ns")),
    ])
    status = F.coalesce("firm", F.when(F.col("pending"), "pending"), F.lit("unknown"))
    return at_each(states, marks).select(REC, "node_id", "kind", F.col("entity").alias("entity_id"), F.coalesce("label", "entity").alias("label"), "role", status.alias("status"), "first_ns", "last_ns")


def topology_edges_at(stated: DataFrame, cursors: DataFrame) -> DataFrame:
    """Edges of :func:`topology.topology_edges` at each cursor."""
    marks = numbered(cursors)
    edges = T.edge_mentions(stored(stated.select(REC, "mono_ns", "sequence", "event_id", "edges"), "stated"))
    said = stored(edges.select(REC, "mono_ns", "sequence", "event_id", "edge_id", "kind", "src", "dst", "count", "fail", "tokens", "status"), "edges")
    rows = in_intervals(said, marks)
    at = ord_col()
    states = prefix_states(rows, [REC, "edge_id", "kind", "src", "dst"], [
        Fold("count", "sum", F.col("count")), Fold("failures", "sum", F.col("fail")), Fold("tokens", "sum", F.col("tokens")), Fold("status", "last", F.col("status")),
        Fold("first_ns", "min", F.col("mono_ns")), Fold("last_ns", "max", F.col("mono_ns")), Fold("s", "min", F.when(F.col("count") > 0, at)), Fold("d", "min", F.when(F.col("status") == "ok", at)),
    ])
    early = (F.col("kind") == "memory_retrieval") & F.col("d").isNotNull() & (F.col("s").isNull() | (F.col("d") < F.col("s")))
    return at_each(states, marks).select(
        REC, "edge_id", "kind", F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("status", F.lit("active")).alias("status"),
        (F.col("count") + F.when(early, 1).otherwise(0)).alias("count"), "failures", "tokens", "first_ns", "last_ns",
    )


def gpu_at(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Backends of :func:`gpu.gpu_backends` at each cursor: samples, latest sample and fitted context, number of warning codes."""
    marks = numbered(cursors)
    r = gpu.gpu_rows(events)
    sample = F.col("sample").isNotNull()
    latest = F.when(sample, F.struct("event_id", "sample.dedicated_bytes", "sample.shared_bytes", "sample.spilled"))
    narrow = r.select(*gpu.KEY, "mono_ns", "sequence", "event_id", "code", "backend", sample.cast("bigint").alias("is_sample"), latest.alias("latest"), F.when(sample & F.col("has_context"), F.struct("sample.fitted_ctx")).alias("context"))
    rows = in_intervals(narrow, marks)
    # A code counts from the interval that brings it first.
    codes = rows.where("code IS NOT NULL").groupBy(*gpu.KEY, "code").agg(F.min("n").alias("n")).groupBy(*gpu.KEY, "n").agg(F.count(F.lit(1)).alias("codes"))
    partial = rows.select(*gpu.KEY, "n", "mono_ns", "sequence", "event_id", "backend", "is_sample", "latest", "context", F.lit(0).cast("bigint").alias("codes"))
    extra = codes.select(*gpu.KEY, "n", "codes")
    states = prefix_states(partial.unionByName(extra, allowMissingColumns=True), gpu.KEY, [
        Fold("backend", "max", F.col("backend")), Fold("samples", "sum", F.coalesce("is_sample", F.lit(0)).cast("bigint")), Fold("latest", "last", F.col("latest")), Fold("context", "last", F.col("context")),
        Fold("warning_codes", "sum", F.col("codes")),
    ])
    return at_each(states, marks).select(
        *gpu.KEY, "backend", "samples", F.col("latest.event_id").alias("latest_event_id"), "latest.dedicated_bytes", "latest.shared_bytes", "latest.spilled", F.col("context.fitted_ctx").alias("fitted_ctx"), "warning_codes"
    )
