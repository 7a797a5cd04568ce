"""Request pipeline: stages, requests, lanes, links, KV pools, layers, operators, output and token candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.dialect import DEFAULT, Dialect
from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.identity import producer_instance, with_stream
from beaconlake.operators.scans import Scan, clamped_sum, running
from beaconlake.schema import ord_col

REC = "recording_id"
KEY = [REC, "stream", "request_id"]
RATE_WINDOW_NS = 5_000_000_000
MAX_CHUNKS, MAX_TOKENS, MAX_FINISHED = 160, 40, 120
_ROW = ("mono_ns", "sequence", "event_id")


def _latest(value: Column, name: str) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), ord_col())).alias(name)


def _first(value: Column, name: str) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), ord_col())).alias(name)


def staged(events: DataFrame, dialect: Dialect = DEFAULT) -> DataFrame:
    """Events with their stream, the role their producer stated last, and the stage they stand for."""
    role = F.when(F.col("producer.role").isNotNull(), F.col("producer.role"))
    synthetic = F.coalesce(F.col("producer.synthetic"), F.lit(False)) | F.coalesce(Readers(events).flag("synthetic"), F.lit(False))
    scanned = running(with_stream(events), [REC, "stream"], [Scan("role", "last", role), Scan("synthetic", "max", synthetic)])
    runtime = scanned.withColumn("runtime", R.is_runtime(F.col("role"), F.col("producer.name"), dialect))
    return runtime.withColumn("at", R.stage_of_event(Readers(runtime), F.col("runtime"))).select(
        "*", F.col("at.stage").alias("stage"), F.coalesce("at.moves", F.lit(False)).alias("moves")
    ).drop("at")


def stage_order(stage: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(R.STAGES):
        out = F.when(stage == name, i).otherwise(out)
    return out


def relevant(rows: DataFrame) -> DataFrame:
    """Events that describe a request, from the event that brought it into being on."""
    t = F.col("event_type")
    about = F.col("stage").isNotNull() | t.startswith("request.") | t.startswith("kv.") | t.startswith("scheduler.") | (t == "inference.token.generated")
    mine = rows.where(F.col("request_id").isNotNull() & about)
    born = mine.where("moves").groupBy(*KEY).agg(F.min(ord_col()).alias("born"))
    return mine.join(born, KEY).where(ord_col() >= F.col("born"))


def pipeline_requests(rows: DataFrame) -> DataFrame:
    """One row per request born by a stage-moving event. ``rows`` are :func:`staged` events."""
    r, t = Readers(rows), F.col("event_type")
    counted = (t == "inference.decode.completed") | F.coalesce(r.flag("token_counts_from_backend"), F.lit(False)) | F.col("runtime")
    ends = t.isin(*R.OUTCOMES)
    output = t == "inference.token.generated"
    # A runtime producer's output event counts but says nothing else of the request.
    states = ~(output & F.col("runtime"))
    facts = relevant(rows).select(
        *KEY, *_ROW, "born", "stage", "moves", "runtime", "role", "synthetic", states.alias("states"), output.alias("output"),
        F.when(ord_col() == F.col("born"), F.struct(F.col("producer.name").alias("producer"), F.col("producer.node_id").alias("node_id"), "role", "session_id", "synthetic")).alias("birth"),
        F.when(states, R.filled("run_id")).alias("run"), F.when(states, R.filled("model_instance_id")).alias("instance"),
        F.when(states, F.col("device_id")).alias("device"), F.when(states, r.name("parent_request_id")).alias("parent"),
        F.when(states, r.name("kind")).alias("kind"), F.when(t == "route.selected", r.name("model")).alias("route_model"),
        F.when(t == "request.started", r.name("requested_model")).alias("requested_model"), F.when(states, r.whole("prompt_tokens")).alias("prompt"),
        F.when(states & counted, r.whole("completion_tokens")).alias("completion"), F.when(ends, F.substring_index(t, ".", -1)).alias("outcome"),
        F.when(ends, r.name("model")).alias("outcome_model"), (F.col("moves") & (t == "scheduler.preempted")).alias("preempted"),
    )
    # Without an output event, the stage is the furthest one moved to since the last preemption.
    preempted = facts.where("preempted").groupBy(*KEY).agg(F.max(ord_col()).alias("last_preempt"))
    placed = facts.join(preempted, KEY, "left")
    since = F.col("moves") & (F.col("last_preempt").isNull() | (ord_col() >= F.col("last_preempt")))
    folded = placed.groupBy(*KEY, "born").agg(
        F.first("birth", ignorenulls=True).alias("birth"), F.max(F.when(F.col("states"), ord_col())).alias("last"), F.count_if("states").alias("events"),
        F.count_if("output").alias("output_events"), _first(F.col("instance"), "instance"), _first(F.col("device"), "device_id"),
        F.min("parent").alias("parent_lo"), F.max("parent").alias("parent_hi"), F.min("run").alias("run_lo"), F.max("run").alias("run_hi"), _first(F.col("run"), "run_id"),
        _first(F.col("kind"), "kind"), _latest(F.col("route_model"), "route_model"), _latest(F.col("requested_model"), "requested_model"),
        _latest(F.col("outcome_model"), "outcome_model"), _latest(F.col("prompt"), "prompt_tokens"), _latest(F.col("completion"), "completion_tokens"),
        F.max_by(F.struct("outcome", "mono_ns"), F.when(F.col("outcome").isNotNull(), ord_col())).alias("end"),
        F.max(F.when(since, stage_order(F.col("stage")))).alias("furthest"),
    )
    names = F.array(*[F.lit(s) for s in R.STAGES])
    one_parent = F.col("parent_lo") == F.col("parent_hi")
    return folded.select(
        *KEY, "born", F.col("birth.producer").alias("producer"), F.col("birth.node_id").alias("node_id"), F.col("birth.role").alias("role"),
        F.col("birth.session_id").alias("session_id"), F.col("birth.synthetic").alias("synthetic"), "instance", "device_id", "kind", "route_model", "requested_model",
        "outcome_model", "prompt_tokens", "completion_tokens", "output_events", F.col("born.mono_ns").alias("start_ns"), F.col("last.mono_ns").alias("last_ns"),
        F.col("last.event_id").alias("last_event_id"), F.col("end.mono_ns").alias("end_ns"), F.coalesce("end.outcome", F.lit("active")).alias("state"),
        F.when(one_parent, F.col("parent_lo")).alias("parent_request_id"), F.coalesce(~one_parent, F.lit(False)).alias("parent_conflict"), "run_id",
        F.coalesce(F.col("run_lo") != F.col("run_hi"), F.lit(False)).alias("run_conflict"),
        F.when(F.col("end").isNotNull(), "output").otherwise(F.element_at(names, F.col("furthest") + 1)).alias("stage"),
    )


def request_stage(rows: DataFrame) -> DataFrame:
    """Time a request entered each stage last; it moves back only on preemption and stays once it gave output."""
    moving = relevant(rows).where("moves").select(*KEY, *_ROW, stage_order(F.col("stage")).alias("o"), (F.col("event_type") == "scheduler.preempted").alias("back"))
    done = len(R.STAGES) - 1
    ended = moving.where(F.col("o") == done).groupBy(*KEY).agg(F.min(ord_col()).alias("ended"))
    live = moving.join(ended, KEY, "left").where(F.col("ended").isNull() | (ord_col() <= F.col("ended"))).drop("ended")
    epochs = running(live, KEY, [Scan("epoch", "sum", F.col("back").cast("bigint"))])
    keys = [*KEY, "epoch"]
    # Inside an epoch the stage never falls, so an entry is a new maximum.
    peaks = running(epochs, keys, [Scan("before", "max", F.col("o"), inclusive=False)])
    # The preempted row opens an epoch: it is an entry unless the request was queued already.
    last = epochs.groupBy(*keys).agg(F.max("o").alias("top")).select(*KEY, (F.col("epoch") + 1).alias("epoch"), F.col("top").alias("came_from"))
    tied = peaks.join(last, keys, "left")
    entry = F.coalesce(F.col("o") > F.col("before"), ~F.col("back") | F.coalesce(F.col("came_from") != F.col("o"), F.lit(True)))
    entered = tied.where(entry).withColumn("stage", F.element_at(F.array(*[F.lit(s) for s in R.STAGES]), F.col("o") + 1))
    return entered.groupBy(*KEY, "stage").agg(F.max("mono_ns").alias("entered_ns"))


def with_model(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Model of each request by precedence, with the source it was read from."""
    r, t = Readers(events), F.col("event_type")
    named = events.where(t.isin("session.created", "model.unload") | t.startswith("model.load.")).select(
        REC, *_ROW, "event_type", "session_id", R.filled("model_instance_id").alias("instance"), r.name("model").alias("model")
    ).where("model IS NOT NULL")
    sessions = named.where(t == "session.created").groupBy(REC, "session_id").agg(F.max_by("model", ord_col()).alias("session_model"))
    loads = named.where((t != "session.created") & F.col("instance").isNotNull()).groupBy(REC, "instance").agg(F.max_by("model", ord_col()).alias("load_model"))
    joined = requests.join(sessions, [REC, "session_id"], "left").join(loads, [REC, "instance"], "left")
    rules = (("route_model", "route.selected"), ("outcome_model", "route.selected"), ("requested_model", "requested_model"), ("session_model", "session.created"),
             ("load_model", "model.load"), ("instance", "model_instance_id"))
    source = F.lit("unknown")
    for column, name in reversed(rules):
        source = F.when(F.col(column).isNotNull(), name).otherwise(source)
    model = F.coalesce(*[F.col(c) for c, _ in rules], F.lit("unknown model"))
    return joined.withColumn("model", model).withColumn("model_source", source).drop("session_model", "load_model")


def lanes(requests: DataFrame) -> DataFrame:
    """(node, model) lanes with their order; members are listed by :func:`lane_members`."""
    weak = F.col("model_source").isin("unknown", "model_instance_id")
    folded = requests.groupBy(REC, "node_id", "model").agg(
        F.count(F.lit(1)).alias("requests"), F.min_by("model_source", F.when(~weak, F.col("born"))).alias("firm"), F.max_by("model_source", "born").alias("last")
    )
    # One row per lane: a short table next to its requests.
    w = Window.partitionBy(REC).orderBy("node_id", "model")
    n = Window.partitionBy(REC).orderBy("node_id")
    return folded.select(
        REC, "node_id", "model", F.coalesce("firm", "last").alias("model_source"), "requests", (F.row_number().over(w) - 1).alias("lane_index"), (F.dense_rank().over(n) - 1).alias("node_index")
    )


def lane_members(requests: DataFrame) -> DataFrame:
    """Producers, roles and devices of each lane with the number of their requests."""
    named = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (
        ("producer", F.col("producer")), ("role", F.coalesce("role", F.lit("unstated"))), ("device", R.filled("device_id")))])
    rows = requests.select(REC, "node_id", "model", F.explode(named).alias("m")).where("m.value IS NOT NULL")
    return rows.groupBy(REC, "node_id", "model", "m.kind", "m.value").agg(F.count(F.lit(1)).alias("requests"))


def shown_requests(requests: DataFrame, max_finished: int = MAX_FINISHED) -> DataFrame:
    """All active requests and the most recently finished ones.

    The rank filter lets Spark keep the top rows of each task before the shuffle.
    """
    w = Window.partitionBy(REC).orderBy(F.coalesce("end_ns", "last_ns").desc(), "start_ns", "stream", "request_id")
    active = requests.where("state = 'active'")
    recent = requests.where("state <> 'active'").withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= max_finished).drop("__rank")
    return active.unionByName(recent)


def runtime_links(requests: DataFrame, dialect: Dialect = DEFAULT) -> DataFrame:
    """Child request -> runtime request it names as parent, only where exactly one compatible candidate exists."""
    runtime = requests.where(R.is_runtime(F.col("role"), F.col("producer"), dialect) & ~F.col("run_conflict")).select(
        REC, F.col("request_id").alias("parent_request_id"), F.col("stream").alias("p_stream"), F.col("run_id").alias("p_run")
    )
    # Candidates are counted per (parent id, run), so no pair is built to find out that it is ambiguous.
    per_run = runtime.groupBy(REC, "parent_request_id", "p_run").agg(F.count(F.lit(1)).alias("n"), F.min("p_stream").alias("lo"), F.max("p_stream").alias("hi"))
    total = per_run.groupBy(REC, "parent_request_id").agg(
        F.sum("n").alias("all_n"), F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi"), F.sum(F.when(F.col("p_run").isNull(), F.col("n"))).alias("free_n"),
        F.min(F.when(F.col("p_run").isNull(), F.col("lo"))).alias("free_lo"), F.max(F.when(F.col("p_run").isNull(), F.col("hi"))).alias("free_hi"),
    )
    own = per_run.where("p_run IS NOT NULL").select(REC, "parent_request_id", F.col("p_run").alias("run_id"), F.col("n").alias("run_n"), F.col("lo").alias("run_lo"), F.col("hi").alias("run_hi"))
    me = runtime.select(REC, F.col("parent_request_id").alias("request_id"), F.col("p_stream").alias("stream"), F.col("p_run").alias("self_run"), F.lit(1).alias("is_runtime"))
    child = requests.where("parent_request_id IS NOT NULL AND NOT run_conflict").join(total, [REC, "parent_request_id"]).join(own, [REC, "parent_request_id", "run_id"], "left").join(me, KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    free = F.col("run_id").isNull()
    # A request that names itself is not its own candidate.
    itself = F.when((F.col("parent_request_id") == F.col("request_id")) & (F.col("is_runtime") == 1), 1).otherwise(0)
    n = F.when(free, F.col("all_n")).otherwise(zero("free_n") + zero("run_n")) - itself
    low = F.when(free, F.col("all_lo")).otherwise(F.least("free_lo", "run_lo"))
    high = F.when(free, F.col("all_hi")).otherwise(F.greatest("free_hi", "run_hi"))
    stream = F.when((itself == 1) & (low == F.col("stream")), high).otherwise(low)
    return child.where(n == 1).select(*KEY, stream.alias("parent_stream"), "parent_request_id")


def stage_summary(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests now in each stage, events of the stage and their rate over the trailing window."""
    now = rows.groupBy(REC).agg(F.max("mono_ns").alias("now"), F.count_if((F.col("stage") == "layers") & F.col("event_type").startswith("backend.layer.") & (Readers(rows).whole("layer") >= 0)).alias("layer_rows"))
    acts = rows.where("stage IS NOT NULL").join(now, REC).groupBy(REC, "stage").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("mono_ns") > F.col("now") - RATE_WINDOW_NS).alias("recent")
    )
    held = requests.groupBy(REC, "stage").agg(F.count(F.lit(1)).alias("requests"))
    grid = now.select(REC, "layer_rows", F.explode(F.array(*[F.lit(s) for s in R.STAGES])).alias("stage")).where("stage <> 'layers' OR layer_rows > 0")
    joined = grid.join(acts, [REC, "stage"], "left").join(held, [REC, "stage"], "left").fillna(0, ["events", "recent", "requests"])
    return joined.select(REC, "stage", "requests", "events", (F.col("recent") / (RATE_WINDOW_NS / 1e9)).alias("rate_per_sec"))


def layers(events: DataFrame) -> DataFrame:
    r = Readers(events)
    rows = with_stream(events.where(F.col("event_type").startswith("backend.layer."))).select(
        REC, "stream", *_ROW, r.whole("layer").alias("layer"), r.whole("layer_count").alias("layer_count"), r.num("duration_ms").alias("duration_ms"),
        r.num("activation_rms").alias("activation_rms"), r.num("attention_entropy").alias("attention_entropy"),
    ).where("layer >= 0")
    return _with_rate(events, rows, [REC, "stream", "layer"], [
        _latest(F.col("layer_count"), "layer_count"), _latest(F.col("duration_ms"), "last_duration_ms"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_duration_ms"),
        _latest(F.col("activation_rms"), "activation_rms"), _latest(F.col("attention_entropy"), "attention_entropy"),
    ])


def operators(events: DataFrame) -> DataFrame:
    r = Readers(events)
    rows = with_stream(events.where(F.col("event_type").startswith("backend.operator."))).select(
        REC, "stream", *_ROW, r.name("operator").alias("operator"), r.whole("layer").alias("layer"), r.num("duration_ms").alias("duration_ms")
    ).where("operator IS NOT NULL")
    return _with_rate(events, rows, [REC, "stream", "operator", "layer"], [F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_duration_ms")])


def _with_rate(events: DataFrame, rows: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    now = events.groupBy(REC).agg(F.max("mono_ns").alias("now"))
    recent = F.count_if(F.col("mono_ns") > F.col("now") - RATE_WINDOW_NS) / (RATE_WINDOW_NS / 1e9)
    return rows.join(now, REC).groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), *aggregates, recent.alias("rate_per_sec"))


def kv_pools(events: DataFrame) -> DataFrame:
    """KV blocks in use per stream (never below zero), total, occupancy, level and reused tokens."""
    r, t = Readers(events), F.col("event_type")
    configured = F.when(t == "scheduler.configured", r.whole("kv_num_blocks"))
    pressure = t == "kv.pressure"
    blocks = F.coalesce(r.whole("blocks"), F.lit(0))
    rows = with_stream(events.where(t.startswith("kv.") | configured.isNotNull())).select(
        REC, "stream", *_ROW, F.when(t == "kv.allocated", blocks).when(t == "kv.freed", -blocks).alias("step"),
        F.coalesce(configured, F.when(pressure, r.whole("total_blocks"))).alias("total"), F.when(pressure, r.num("occupancy", "utilization")).alias("occupancy"),
        F.when(pressure, r.name("level")).alias("level"), F.when(t == "kv.reused", F.coalesce(r.whole("tokens"), F.lit(0))).alias("reused"),
    )
    used = clamped_sum(rows, [REC, "stream"], F.col("step"), "used")
    return used.groupBy(REC, "stream").agg(
        F.coalesce(_plain_latest("used"), F.lit(0)).alias("used_blocks"), _latest(F.col("total"), "total_blocks"), _latest(F.col("occupancy"), "occupancy"),
        _latest(F.col("level"), "level"), F.coalesce(F.sum("reused"), F.lit(0)).alias("reused_tokens"),
    )


def _plain_latest(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), ord_col()))


def text_allowed(events: DataFrame) -> DataFrame:
    """Events with ``text_ok``: the policy of their session so far, else of their stream, lets text be shown."""
    declares = F.col("event_type").isin("session.created", "session.started", "engine.started")
    policy = F.when(declares, Readers(events).name("text_capture"))
    marked = with_stream(events).withColumn("__allows", F.when(policy.isNotNull(), R.capture_allows_text(policy)))
    scanned = running(marked, [REC, "stream"], [Scan("__any", "max", F.col("__allows"))])
    both = running(scanned, [REC, "stream", "session_id"], [Scan("__own", "last", F.col("__allows"))])
    return both.withColumn("text_ok", F.coalesce("__own", "__any", F.lit(False))).drop("__allows", "__any", "__own")


def _top(rows: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(REC).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= limit).drop("__rank")


def top_chunks(events: DataFrame, limit: int | None = MAX_CHUNKS) -> DataFrame:
    """Most recent output events of each recording, text only where the policy lets it through."""
    rows = text_allowed(events.where(F.col("event_type").isin("inference.token.generated", "session.created", "session.started", "engine.started"))).where(
        F.col("event_type") == "inference.token.generated"
    )
    r = Readers(rows)
    raw = r.text("text")
    chunks = rows.select(
        REC, "stream", "request_id", *_ROW, r.whole("index").alias("index"), r.whole("bytes").alias("bytes"), r.num("elapsed_ms").alias("elapsed_ms"),
        F.coalesce(r.name("unit"), F.lit("token")).alias("unit"), R.output_token_count(r).alias("tokens"), r.num("probability").alias("probability"),
        F.when(F.col("text_ok"), raw).alias("text"), (raw.isNotNull() & ~F.col("text_ok")).alias("text_withheld"),
    )
    return chunks if limit is None else _top(chunks, limit, [F.col(c).desc() for c in _ROW])


def token_candidates(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Token probabilities joined with the candidates sampled for the same request and index."""
    t = F.col("event_type")
    used = events.where(t.isin("inference.token.generated", "inference.sampling.candidates", "session.created", "session.started", "engine.started"))
    rows = text_allowed(used)
    r = Readers(rows)
    is_token = t == "inference.token.generated"
    alternatives = F.when(t == "inference.sampling.candidates", R.read_alternatives(r, F.col("text_ok")))
    p = F.when(is_token, r.num("probability"))
    suffix = F.coalesce(r.whole("index").cast("string"), F.col("event_id"))
    scope = F.when(F.col("request_id").isNotNull(), F.to_json(F.array(F.lit("r"), "stream", "request_id", suffix))).otherwise(F.to_json(F.array(F.lit("s"), "session_id", suffix)))
    pairs = rows.select(
        REC, "stream", "request_id", *_ROW, scope.alias("pair"), r.whole("index").alias("index"), r.whole("token_id").alias("token_id"), p.alias("probability"),
        F.when(F.col("text_ok"), r.text("text")).alias("text"), alternatives.alias("alternatives"),
    ).where("probability IS NOT NULL OR alternatives IS NOT NULL")
    token = F.struct("event_id", "token_id", "probability", "text", "mono_ns")
    folded = pairs.groupBy(REC, "pair").agg(
        F.min(ord_col()).alias("born"), F.min_by("index", ord_col()).alias("index"), F.min_by(F.struct("stream", "request_id"), ord_col()).alias("req"),
        F.max_by(token, F.when(F.col("probability").isNotNull(), ord_col())).alias("tok"),
        F.max_by(F.struct("event_id", "alternatives"), F.when(F.col("alternatives").isNotNull(), ord_col())).alias("alt"),
    )
    out = folded.select(
        REC, "born", "req.stream", "req.request_id", F.coalesce("tok.event_id", "born.event_id").alias("event_id"), "index", "tok.token_id", "tok.probability", "tok.text",
        F.coalesce("tok.mono_ns", "born.mono_ns").alias("ns"), F.col("alt.event_id").alias("candidates_event_id"), "alt.alternatives",
    )
    return out if limit is None else _top(out, limit, [F.col("born").desc()])


def top_tokens(events: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    return token_candidates(events, limit)


def bounded_evidence(rows: DataFrame, keys: list[str], head: int = 5, keep: int = 60) -> DataFrame:
    """The first few and the latest events of each key, ``keep`` at most."""
    first = Window.partitionBy(*keys).orderBy(*_ROW)
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in _ROW])
    heads = rows.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= head).drop("__rank")
    tails = rows.withColumn("__rank", F.row_number().over(last)).where(F.col("__rank") <= keep - head).drop("__rank")
    return heads.unionByName(tails).distinct()


# Panels of a producer stream.
PANELS = ("pipeline", "layers", "operators", "probabilities", "alternatives", "kv", "output-text")


def producer_capabilities(events: DataFrame, requests: DataFrame, dialect: Dialect = DEFAULT) -> DataFrame:
    """What each producer stream can feed: one row per stream and panel with its status."""
    marked = text_allowed(events)
    r, t = Readers(marked), F.col("event_type")
    backend = r.name("backend")
    capabilities = _text_array(r, "capabilities")
    out = t == "inference.token.generated"
    policy = F.when(t.isin("session.created", "session.started", "engine.started"), r.name("text_capture"))
    alternatives = F.when(t == "inference.sampling.candidates", R.read_alternatives(r, F.lit(False)))
    level = F.when(F.col("sampling.level") == "off", 0).when(F.col("sampling.level") == "metrics", 1).when(F.col("sampling.level") == "standard", 2).when(F.col("sampling.level") == "deep", 3)
    rows = marked.select(
        REC, "stream", *_ROW, F.col("producer.name").alias("producer"), F.col("producer.node_id").alias("node_id"), F.col("producer.role").alias("role"), producer_instance().alias("instance_id"),
        F.when((t == "session.created") | t.startswith("model.load.") | (t == "model.unload"), backend).alias("used_backend"),
        F.when(t == "backend.registered", backend).alias("reg_backend"), F.when(t == "backend.registered", capabilities).alias("caps"),
        F.when(t == "request.started", r.name("sampler")).alias("sampler"), level.alias("level"), policy.alias("policy"),
        t.startswith("backend.layer.").alias("is_layer"), t.startswith("backend.operator.").alias("is_operator"), (out & r.num("probability").isNotNull()).alias("is_probability"),
        alternatives.isNotNull().alias("is_alternative"), t.startswith("kv.").alias("is_kv"), (t == "scheduler.configured").alias("is_configured"), (out & r.text("text").isNotNull() & F.col("text_ok")).alias("is_text"),
    )
    counts = {f"{n}_events": F.count_if(f"is_{n}") for n in ("layer", "operator", "probability", "alternative", "kv", "text")}
    facts = rows.groupBy(REC, "stream").agg(
        F.max("producer").alias("producer"), F.max("node_id").alias("node_id"), _latest(F.col("role"), "role"), F.max("level").alias("level"), F.max("is_configured").alias("configured"),
        F.max(F.coalesce(F.col("sampler") == "backend", F.lit(False))).alias("backend_samples"), F.max(F.coalesce(F.col("sampler") == dialect.vendor, F.lit(False))).alias("own_samples"),
        F.max(R.capture_allows_text(F.col("policy"))).alias("text_on"), F.count("policy").alias("policies"), *[v.alias(k) for k, v in counts.items()],
    )
    # Capabilities of the backends in use; a single advertised backend stands in when none is named.
    registered = rows.where("reg_backend IS NOT NULL AND caps IS NOT NULL").groupBy(REC, "stream", "reg_backend").agg(F.max_by("caps", ord_col()).alias("caps"))
    named = rows.where("used_backend IS NOT NULL").select(REC, "stream", "used_backend").distinct()
    alone = registered.groupBy(REC, "stream").agg(F.count(F.lit(1)).alias("n"), F.min("reg_backend").alias("used_backend")).where("n = 1").drop("n")
    in_use = named.unionByName(alone.join(named.select(REC, "stream").distinct(), [REC, "stream"], "left_anti"))
    known = in_use.join(registered.withColumnRenamed("reg_backend", "used_backend"), [REC, "stream", "used_backend"], "left")
    every = lambda c: F.when(F.count_if(F.col("caps").isNull()) == 0, F.min(F.array_contains("caps", c)))
    able = known.groupBy(REC, "stream").agg(every("layer_telemetry").alias("has_layers"), every("token_logits").alias("has_logits"))
    served = requests.groupBy(REC, "stream").agg(F.count(F.lit(1)).alias("requests"))
    full = facts.join(able, [REC, "stream"], "left").join(served, [REC, "stream"], "left").withColumn("panel", F.explode(F.array(*[F.lit(p) for p in PANELS])))
    p = F.col("panel")
    runtime = R.is_runtime(F.col("role"), F.col("producer"), dialect)
    deep_seen = F.when(p == "layers", F.col("layer_events")).otherwise(F.col("operator_events"))
    token_seen = F.when(p == "probabilities", F.col("probability_events")).otherwise(F.col("alternative_events"))
    only_backend = F.col("backend_samples") & ~F.col("own_samples")
    can_logits = F.coalesce(F.col("has_logits"), F.lit(False)) | F.col("own_samples")
    no_logits = F.coalesce(~F.col("has_logits"), only_backend)
    status = (
        F.when(p == "pipeline", F.when(F.coalesce("requests", F.lit(0)) > 0, "available").otherwise("waiting"))
        .when(runtime & (p != "output-text"), "not-applicable")
        .when(p.isin("layers", "operators"), F.when(deep_seen > 0, "available").when(F.coalesce("has_layers", F.lit(False)) & F.coalesce(F.col("level") == 3, F.lit(False)), "waiting").otherwise("unavailable"))
        .when(p.isin("probabilities", "alternatives"), F.when(token_seen > 0, "available").when(no_logits | (p == "alternatives"), "unavailable").when(can_logits, "waiting").otherwise("unavailable"))
        .when(p == "kv", F.when(F.col("kv_events") > 0, "available").when(F.col("configured"), "waiting").otherwise("unavailable"))
        .otherwise(F.when((F.col("text_events") > 0) & F.col("text_on"), "available").when(F.col("text_on"), "waiting").otherwise("unavailable"))
    )
    return full.select(REC, "stream", "producer", "node_id", "role", "panel", status.alias("status"))


def _text_array(r: Readers, key: str) -> Column:
    """Strings of an array attribute, or null when it is not an array."""
    value, kind = r._lookup(key)
    if kind is None:
        items = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        texts = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
        return F.filter(texts, lambda x: x.isNotNull())
    return value if kind.simpleString() == "array<string>" else F.lit(None).cast("array<string>")
