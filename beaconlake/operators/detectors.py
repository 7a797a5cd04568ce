"""Ten diagnostic detectors.

Every detector gives ``Found(findings, evidence)``. A finding row holds its
facts; its evidence is a table with one row per cited event, so a finding over
millions of events never becomes one huge array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.classify import is_failure
from beaconlake.operators.islands import bursts, episodes, runs
from beaconlake.operators.scans import Scan, clamped_sum, lagged, positioned, row_blocks, running
from beaconlake.schema import ord_col
from beaconlake.session import cut_lineage

REC = "recording_id"
EVIDENCE = [REC, "finding_id", "event_id", "mono_ns", "sequence"]
SEVERITIES = ("info", "warning", "critical")


# -- configuration (fixed default thresholds) ---------------------------------


@dataclass(frozen=True)
class Fractions:
    warn: float = 0.8
    critical: float = 0.95


@dataclass(frozen=True)
class Burst:
    count: int
    window_ms: int

    @property
    def window_ns(self) -> int:
        return self.window_ms * 1_000_000


@dataclass(frozen=True)
class CacheThrash:
    window_ms: int = 5_000
    min_lookups: int = 10
    baseline_hit_rate: float = 0.5
    drop_ratio: float = 0.5
    eviction_count: int = 20


@dataclass(frozen=True)
class Latency:
    baseline_size: int = 20
    min_baseline: int = 5
    factor: float = 2.0
    min_excess_ms: float = 250.0


@dataclass(frozen=True)
class Config:
    budget: Fractions = Fractions()
    compaction: Burst = Burst(3, 60_000)
    no_progress_repeats: int = 3
    task_keys: tuple[str, ...] = ("task_hash", "task", "objective_hash")
    retry_storm: Burst = Burst(3, 10_000)
    cache_thrash: CacheThrash = CacheThrash()
    model_churn: Burst = Burst(4, 60_000)
    latency: Latency = Latency()
    error_burst: Burst = Burst(3, 5_000)
    resource: Fractions = Fractions(warn=0.85)

    def override(self, **changes: dict | object) -> "Config":
        """Partial override: a dict changes only the named members of a section."""
        known = {f.name for f in fields(self)}
        merged = {k: replace(getattr(self, k), **v) if isinstance(v, dict) else v for k, v in changes.items() if k in known}
        return replace(self, **merged)


@dataclass(frozen=True)
class Found:
    findings: DataFrame
    evidence: DataFrame
    subjects: DataFrame | None = field(default=None)


# -- building blocks ----------------------------------------------------------


def round_ms(ns: Column) -> Column:
    return F.round(ns / 1e6).cast("bigint")


def _plain(number: Column) -> Column:
    """Whole doubles as text without a fraction."""
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def finding_rows(
    rows: DataFrame, kind: str, severity: Column, facts: dict[str, Column], provenance: str = "derived", events: Column | None = None
) -> DataFrame:
    """``rows`` must carry recording_id, finding_id, start_ns and end_ns."""
    pairs = [c for key, value in facts.items() for c in (F.lit(key), value.cast("string"))]
    fact_map = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(
        REC, "finding_id", F.lit(kind).alias("kind"), severity.alias("severity"), "start_ns", "end_ns",
        F.lit(provenance).alias("provenance"), fact_map.alias("facts"), (events if events is not None else F.lit(1)).cast("bigint").alias("evidence_count"),
    )


def _id(kind: str, event: Column, part: str = "") -> Column:
    return F.concat(F.lit(f"{kind}:{part}"), event)


def _single(events: DataFrame, kind: str) -> DataFrame:
    """Findings that restate one event each."""
    return events.withColumn("finding_id", _id(kind, F.col("event_id"))).withColumn("start_ns", F.col("mono_ns")).withColumn("end_ns", F.col("mono_ns"))


def _join(*found: Found) -> Found:
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    subjects = [f.subjects for f in found if f.subjects is not None]
    return Found(union([f.findings for f in found]), union([f.evidence for f in found]), union(subjects) if subjects else None)


def _cited(rows: DataFrame) -> DataFrame:
    return rows.select(*EVIDENCE)


def _subjects(members: DataFrame, key: str, value: Column) -> DataFrame:
    """Distinct subjects of each finding with the place of their first mention."""
    return members.select(REC, "finding_id", F.lit(key).alias("fact"), value.alias("subject"), ord_col().alias("o")).groupBy(
        REC, "finding_id", "fact", "subject"
    ).agg(F.min("o").alias("first_ord"))


def _burst_found(
    rows: DataFrame, keys: list[str], rule: Burst, kind: str, part: str, facts: Callable[[], dict[str, Column]],
    aggregates: Iterable[Column] = (), severity: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, members) of the bursts of ``rows``."""
    members = bursts(rows, keys, rule.count, rule.window_ns).withColumn("finding_id", _id(kind, F.col("island.event_id"), part))
    stats = members.groupBy(*keys, "finding_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("mono_ns").alias("start_ns"), F.max("mono_ns").alias("end_ns"), *aggregates
    ).withColumn("span_ms", round_ms(F.col("end_ns") - F.col("start_ns")))
    level = severity if severity is not None else F.when(F.col("n") >= rule.count * 2, "critical").otherwise("warning")
    return finding_rows(stats, kind, level, facts(), events=F.col("n")), members


def _peak(value: str, *columns: str) -> Column:
    """First row with the highest value."""
    order = F.struct((-F.col(value)).alias("v"), ord_col().alias("o"))
    return F.min_by(F.struct(value, *columns), order).alias("peak")


# -- detectors ----------------------------------------------------------------


def budget_pressure(events: DataFrame, config: Config = Config()) -> Found:
    kind, cfg, r = "budget-pressure", config.budget, Readers(events)
    guard = events.where(F.col("event_type") == "guard.budget_pressure").withColumn("f", r.num("used_fraction", "fraction")).withColumn(
        "budget", F.coalesce(r.name("budget"), F.lit("unspecified"))
    )
    reported = _single(guard, kind)
    level = F.when(F.col("f").isNull(), "warning").otherwise(F.coalesce(R.severity_for(F.col("f"), cfg.warn, cfg.critical), F.lit("info")))
    guards = Found(finding_rows(reported, kind, level, {"budget": F.col("budget"), "used_fraction": F.col("f")}, "producer-reported"), _cited(reported))

    used = r.num("used_tokens", "context_tokens", "tokens_used")
    limit = r.num("limit_tokens", "context_limit", "max_tokens", "context_window")
    samples = events.where(~F.col("event_type").startswith("guard.")).select(
        REC, "mono_ns", "sequence", "event_id", R.scope_key(r).alias("scope"), used.alias("used"), limit.alias("limit")
    ).where("used IS NOT NULL AND limit > 0").withColumn("fraction", F.col("used") / F.col("limit"))
    members = episodes(samples, [REC, "scope"], F.col("fraction") >= cfg.warn).withColumn("finding_id", _id(kind, F.col("island.event_id")))
    stats = members.groupBy(REC, "scope", "finding_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("mono_ns").alias("start_ns"), F.max("mono_ns").alias("end_ns"), _peak("fraction", "used", "limit")
    )
    facts = {
        "scope": F.col("scope"), "samples": F.col("n"), "peak_used_tokens": _plain(F.col("peak.used")), "limit_tokens": _plain(F.col("peak.limit")),
        "peak_fraction": F.col("peak.fraction"),
    }
    level = F.coalesce(R.severity_for(F.col("peak.fraction"), cfg.warn, cfg.critical), F.lit("warning"))
    return _join(guards, Found(finding_rows(stats, kind, level, facts, events=F.col("n")), _cited(members)))


def resource_pressure(events: DataFrame, config: Config = Config()) -> Found:
    kind, cfg, r = "resource-pressure", config.resource, Readers(events)
    device = F.coalesce("device_id", F.lit("unknown-device"))
    samples = events.where(F.col("event_type") == "device.memory.sample").select(
        REC, "mono_ns", "sequence", "event_id", F.concat(device, F.lit("/"), F.coalesce(r.name("kind"), F.lit("memory"))).alias("scope"), R.memory_usage(r).alias("u")
    ).where("u IS NOT NULL").select(REC, "mono_ns", "sequence", "event_id", "scope", "u.used", "u.total", "u.fraction")
    members = episodes(samples, [REC, "scope"], F.col("fraction") >= cfg.warn).withColumn("finding_id", _id(kind, F.col("island.event_id")))
    stats = members.groupBy(REC, "scope", "finding_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("mono_ns").alias("start_ns"), F.max("mono_ns").alias("end_ns"), _peak("fraction", "used", "total")
    )
    facts = {"scope": F.col("scope"), "samples": F.col("n"), "peak_fraction": F.col("peak.fraction")}
    level = F.coalesce(R.severity_for(F.col("peak.fraction"), cfg.warn, cfg.critical), F.lit("warning"))
    derived = Found(finding_rows(stats, kind, level, facts, events=F.col("n")), _cited(members))

    kv = _single(events.where(F.col("event_type") == "kv.pressure").withColumn("o", r.num("occupancy", "used_fraction")), kind)
    level = F.when(F.col("o").isNull(), "warning").otherwise(F.coalesce(R.severity_for(F.col("o"), cfg.warn, cfg.critical), F.lit("info")))
    return _join(derived, Found(finding_rows(kv, kind, level, {"occupancy": F.col("o")}, "producer-reported"), _cited(kv)))


def pair_compactions(events: DataFrame) -> DataFrame:
    """Compaction events per scope; an end carries the latest open start (``s_*``), an unended start has ``dangling``."""
    r = Readers(events)
    step = F.substring_index("event_type", ".", -1)
    rows = events.where(F.col("event_type").startswith("context.compaction.")).select(
        REC, "mono_ns", "sequence", "event_id", R.scope_key(r).alias("scope"), step.alias("step"),
        r.num("tokens_before", "before_tokens").alias("before"), r.num("tokens_after", "after_tokens").alias("after"),
    ).where(F.col("step").isin("started", "completed", "failed"))
    keys = [REC, "scope"]
    is_start = F.col("step") == "started"
    # Open starts after and before the event; an end on an empty stack leaves it empty.
    depth = clamped_sum(rows, keys, F.when(is_start, 1).otherwise(-1).cast("bigint"), "depth", before="depth_before")
    levelled = depth.withColumn("level", F.when(is_start, F.col("depth")).otherwise(F.coalesce("depth_before", F.lit(0))))
    mark = F.struct("step", "mono_ns", "sequence", "event_id", "before")
    paired = running(levelled, [*keys, "level"], [Scan("p", "last", mark, inclusive=False), Scan("nx", "next", F.col("step"), inclusive=False)])
    start = F.when(~is_start & (F.col("level") > 0) & (F.col("p.step") == "started"), F.col("p"))
    return paired.withColumn("start", start).withColumn("dangling", is_start & F.col("nx").isNull()).drop("depth", "depth_before", "p", "nx")


def compaction(events: DataFrame, config: Config = Config()) -> Found:
    kind = "compaction"
    pairs = pair_compactions(events)
    ends = pairs.where("step <> 'started' OR dangling").withColumn("finding_id", _id(kind, F.coalesce("start.event_id", F.col("event_id")))).withColumn(
        "start_ns", F.coalesce("start.mono_ns", F.col("mono_ns"))
    ).withColumn("end_ns", F.col("mono_ns"))
    done = F.col("step") == "completed"
    took = F.when(done & F.col("start").isNotNull(), round_ms(F.col("mono_ns") - F.col("start.mono_ns")))
    before, after = F.coalesce(F.col("before"), F.col("start.before")), F.col("after")
    both = done & before.isNotNull() & after.isNotNull()
    facts = {"scope": F.col("scope"), "duration_ms": took, "tokens_before": F.when(both, _plain(before)), "tokens_after": F.when(both, _plain(after))}
    cited = F.when(F.col("start").isNotNull(), 2).otherwise(1)
    rows = finding_rows(ends, kind, F.when(done, "info").otherwise("warning"), facts, events=cited)
    opened = ends.where("start IS NOT NULL").select(REC, "finding_id", "start.event_id", "start.mono_ns", "start.sequence")
    single = Found(rows, _cited(ends).unionByName(opened))

    rule = config.compaction
    completed = pairs.where(done).select(REC, "scope", "mono_ns", "sequence", "event_id")
    churn, members = _burst_found(
        completed, [REC, "scope"], rule, kind, "churn:", lambda: {"scope": F.col("scope"), "compactions": F.col("n")},
        severity=F.lit("warning"),
    )
    return _join(single, Found(churn, _cited(members)))


def no_progress(events: DataFrame, config: Config = Config()) -> Found:
    kind, least, r = "no-progress-loop", config.no_progress_repeats, Readers(events)
    guard = _single(events.where(F.col("event_type") == "guard.no_progress"), kind)
    found = [Found(finding_rows(guard, kind, F.lit("warning"), {}, "producer-reported"), _cited(guard))]
    outcomes = events.where(F.col("event_type").isin("tool.completed", "tool.failed")).select(
        REC, r.name("tool_call_id").alias("call_id"), "event_id", "mono_ns", "sequence"
    ).where("call_id IS NOT NULL")
    for event_type, part, signature, phrase in (
        ("tool.called", "calls:", R.call_signature(r), None), ("tool.completed", "outputs:", R.output_signature(r), "output")
    ):
        rows = events.where(F.col("event_type") == event_type).select(
            REC, "mono_ns", "sequence", "event_id", R.actor_key().alias("actor"), signature.alias("signature"), r.name("tool_call_id").alias("call_id")
        )
        grouped = runs(rows, [REC, "actor"], F.col("signature")).withColumn("finding_id", _id(kind, F.col("island.event_id"), part))
        stats = grouped.groupBy(REC, "actor", "finding_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("mono_ns").alias("start_ns"), F.max("mono_ns").alias("run_end"), F.first("sig").alias("sig")
        ).where(F.col("n") >= least).withColumn("tool", F.substring_index("sig", "|", 1))
        cited = grouped.join(stats.select(REC, "finding_id"), [REC, "finding_id"], "left_semi")
        evidence = _cited(cited)
        if phrase is None:
            ids = cited.where("call_id IS NOT NULL").select(REC, "finding_id", "call_id").distinct()
            evidence = evidence.unionByName(ids.join(outcomes, [REC, "call_id"]).select(*EVIDENCE))
        spans = evidence.groupBy(REC, "finding_id").agg(F.min("mono_ns").alias("lo"), F.max("mono_ns").alias("hi"), F.count(F.lit(1)).alias("m"))
        full = stats.join(spans, [REC, "finding_id"]).withColumn("start_ns", F.col("lo")).withColumn("end_ns", F.col("hi"))
        level = F.when(F.col("n") >= least * 2, "critical").otherwise("warning")
        facts = {"actor": F.col("actor"), "tool": F.col("tool"), "repeats": F.col("n")}
        found.append(Found(finding_rows(full, kind, level, facts, events=F.col("m")), evidence))
    return _join(*found)


def duplicate_worker(events: DataFrame, config: Config = Config()) -> Found:
    """Agents active on one task at the same time.

    Per task the set of active agents is a running sum of +1/-1 steps; a cluster
    opens at the first spawn that meets an active agent and lasts until none is active.
    """
    kind, r = "duplicate-worker", Readers(events)
    guard = _single(events.where(F.col("event_type") == "guard.duplicate_work"), kind)
    guards = Found(
        finding_rows(guard, kind, F.lit("warning"), {}, "producer-reported"), _cited(guard),
        guard.select(REC, "finding_id", F.lit("agents").alias("fact"), F.lit("").alias("subject"), ord_col().alias("first_ord")).where(F.lit(False)),
    )
    spawn = F.col("event_type") == "agent.spawned"
    life = events.where(F.col("event_type").isin("agent.spawned", "agent.completed", "agent.cancelled") & R.filled("agent_id").isNotNull()).select(
        REC, "mono_ns", "sequence", "event_id", "event_type", "agent_id", F.when(spawn, R.task_key(r, config.task_keys)).alias("own_task")
    ).where(~spawn | F.col("own_task").isNotNull())
    tasked = running(life, [REC, "agent_id"], [Scan("task", "last", F.col("own_task"))]).where("task IS NOT NULL")
    inside = running(tasked, [REC, "task", "agent_id"], [Scan("was_in", "last", spawn, inclusive=False)])
    was_in = F.coalesce("was_in", F.lit(False))
    step = F.when(spawn & ~was_in, 1).when(~spawn & was_in, -1).otherwise(0).cast("bigint")
    stepped = cut_lineage(inside.withColumn("step", step))
    sized = running(stepped, [REC, "task"], [Scan("size", "sum", F.col("step"))]).withColumn("size_before", F.col("size") - F.col("step"))
    begins = (F.col("size_before") == 0) & (F.col("step") == 1)
    period = cut_lineage(
        running(sized, [REC, "task"], [Scan("period", "last", F.when(begins, ord_col()))]).where("size_before > 0 OR step = 1")
    )
    keys = [REC, "task", "period"]
    opening = period.where("step = 1 AND size_before > 0").groupBy(*keys).agg(F.min(ord_col()).alias("opens"))
    rows = period.join(opening, keys)
    later = rows.where(ord_col() >= F.col("opens")).where("event_type <> 'agent.spawned' OR step = 1")
    earlier = rows.where(ord_col() < F.col("opens")).groupBy(*keys, "agent_id").agg(
        F.max_by(F.struct("event_id", "mono_ns", "sequence", "event_type"), ord_col()).alias("e")
    )
    held = earlier.where("e.event_type = 'agent.spawned'").select(*keys, "agent_id", "e.*")
    members = held.unionByName(later.select(*held.columns))
    stats = members.groupBy(*keys).agg(
        F.min(ord_col()).alias("first"), F.max("mono_ns").alias("end_ns"), F.count(F.lit(1)).alias("n")
    ).withColumn("finding_id", _id(kind, F.col("first.event_id"))).withColumn("start_ns", F.col("first.mono_ns"))
    named = members.join(stats.select(*keys, "finding_id"), keys)
    subjects = _subjects(named.where("event_type = 'agent.spawned'"), "agents", F.col("agent_id"))
    agents = subjects.groupBy(REC, "finding_id").agg(F.count(F.lit(1)).alias("agents"))
    full = stats.join(agents, [REC, "finding_id"])
    level = F.when(F.col("agents") >= 3, "critical").otherwise("warning")
    rows = finding_rows(full, kind, level, {"task": F.col("task"), "agents": F.col("agents")}, events=F.col("n"))
    return _join(guards, Found(rows, _cited(named), subjects))


def retry_storm(events: DataFrame, config: Config = Config()) -> Found:
    kind, r = "retry-storm", Readers(events)
    target = F.coalesce(r.name("tool_call_id"), F.col("request_id"), F.col("task_id"), F.col("agent_id"), F.lit("unscoped"))
    rows = events.where(F.col("event_type") == "retry.scheduled").select(REC, "mono_ns", "sequence", "event_id", target.alias("target"))
    rule = config.retry_storm
    members = bursts(rows, [REC], rule.count, rule.window_ns).withColumn("finding_id", _id(kind, F.col("island.event_id")))
    return _with_subjects(members, kind, rule, "targets", F.col("target"), {}, "retries")


def _with_subjects(members: DataFrame, kind: str, rule: Burst, key: str, subject: Column, extra: dict[str, Column], what: str) -> Found:
    subjects = _subjects(members, key, subject)
    distinct = subjects.groupBy(REC, "finding_id").agg(F.count(F.lit(1)).alias("subjects"))
    stats = members.groupBy(REC, "finding_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("mono_ns").alias("start_ns"), F.max("mono_ns").alias("end_ns"), *[c.alias(k) for k, c in extra.items()]
    ).join(distinct, [REC, "finding_id"]).withColumn("span_ms", round_ms(F.col("end_ns") - F.col("start_ns")))
    level = F.when(F.col("n") >= rule.count * 2, "critical").otherwise("warning")
    if kind == "model-churn":
        facts = {"loads": F.col("loads"), "unloads": F.col("n") - F.col("loads"), "span_ms": F.col("span_ms"), f"{key}_count": F.col("subjects")}
    else:
        facts = {what: F.col("n"), "span_ms": F.col("span_ms"), f"{key}_count": F.col("subjects")}
    return Found(finding_rows(stats, kind, level, facts, events=F.col("n")), _cited(members), subjects)


def model_churn(events: DataFrame, config: Config = Config()) -> Found:
    kind, r, t = "model-churn", Readers(events), F.col("event_type")
    rows = events.where(((t == "model.load.completed") & ~R.is_request_scoped_load()) | (t == "model.unload")).select(
        REC, "mono_ns", "sequence", "event_id", "event_type", F.coalesce(F.col("model_instance_id"), r.name("model"), F.lit("unknown")).alias("model")
    )
    rule = config.model_churn
    members = bursts(rows, [REC], rule.count, rule.window_ns).withColumn("finding_id", _id(kind, F.col("island.event_id")))
    loads = F.count_if(F.col("event_type") == "model.load.completed")
    return _with_subjects(members, kind, rule, "models", F.col("model"), {"loads": loads}, "models")


def error_burst(events: DataFrame, config: Config = Config()) -> Found:
    kind, rule = "error-burst", config.error_burst
    rows = events.where(is_failure()).select(REC, "mono_ns", "sequence", "event_id", "event_type")
    members = bursts(rows, [REC], rule.count, rule.window_ns).withColumn("finding_id", _id(kind, F.col("island.event_id")))
    by_type = members.groupBy(REC, "finding_id", "event_type").agg(
        F.count(F.lit(1)).alias("c"), F.min("mono_ns").alias("lo"), F.max("mono_ns").alias("hi")
    )
    # One entry per event type, not per event.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("rank"), F.col("event_type").alias("t"), F.col("c").alias("c"))))
    stats = by_type.groupBy(REC, "finding_id").agg(
        F.sum("c").alias("n"), F.min("lo").alias("start_ns"), F.max("hi").alias("end_ns"),
        F.array_join(F.transform(ranked, lambda x: F.concat(x["c"].cast("string"), F.lit("x "), x["t"])), ", ").alias("breakdown"),
    ).withColumn("span_ms", round_ms(F.col("end_ns") - F.col("start_ns")))
    level = F.when(F.col("n") >= rule.count * 2, "critical").otherwise("warning")
    facts = {"failures": F.col("n"), "span_ms": F.col("span_ms"), "breakdown": F.col("breakdown")}
    return Found(finding_rows(stats, kind, level, facts, events=F.col("n")), _cited(members))


def hit_rate_windows(events: DataFrame, window_ns: int, min_lookups: int) -> tuple[DataFrame, DataFrame]:
    """(lookup events with their window, qualifying windows with the rates of up to three before)."""
    rows = events.where(F.col("event_type").isin("kv.reused", "kv.allocated")).select(
        REC, "mono_ns", "sequence", "event_id", R.cache_scope().alias("scope"), (F.col("event_type") == "kv.reused").alias("hit")
    )
    anchors = rows.groupBy(REC, "scope").agg(F.min("mono_ns").alias("t0"))
    placed = rows.join(anchors, [REC, "scope"]).withColumn("w", F.floor((F.col("mono_ns") - F.col("t0")) / F.lit(window_ns)).cast("bigint")).drop("t0")
    first = F.coalesce(F.min_by("event_id", F.when(F.col("hit"), ord_col())), F.min_by("event_id", ord_col()))
    windows = placed.groupBy(REC, "scope", "w").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("lookups"), first.alias("first_id")).where(
        F.col("lookups") >= min_lookups
    ).withColumn("rate", F.col("hits") / F.col("lookups"))
    w = Window.partitionBy(REC, "scope").orderBy("w")
    past = [F.lag(F.struct("w", "rate"), i).over(w) for i in (3, 2, 1)]
    return placed, windows.withColumn("prior", F.filter(F.array(*past), lambda x: x.isNotNull()))


def cache_thrash(events: DataFrame, config: Config = Config()) -> Found:
    kind, cfg = "cache-thrash", config.cache_thrash
    placed, windows = hit_rate_windows(events, cfg.window_ms * 1_000_000, cfg.min_lookups)
    total = F.aggregate("prior", F.lit(0.0), lambda acc, x: acc + x["rate"])
    judged = windows.where(F.size("prior") > 0).withColumn("baseline", F.try_divide(total, F.size("prior"))).where(
        (F.col("baseline") >= cfg.baseline_hit_rate) & (F.col("rate") <= F.col("baseline") * cfg.drop_ratio)
    ).withColumn("finding_id", _id(kind, F.col("first_id"), "hitrate:"))
    covers = judged.select(REC, "scope", "finding_id", F.explode(F.concat(F.transform("prior", lambda x: x["w"]), F.array("w"))).alias("w"))
    members = placed.join(covers, [REC, "scope", "w"])
    ends = members.groupBy(REC, "finding_id").agg(F.min("mono_ns").alias("start_ns"), F.max("mono_ns").alias("end_ns"), F.count(F.lit(1)).alias("n"))
    stats = judged.join(ends, [REC, "finding_id"])
    facts = {"scope": F.col("scope"), "hit_rate": F.col("rate"), "baseline_hit_rate": F.col("baseline"), "lookups": F.col("lookups")}
    level = F.when(F.col("rate") == 0, "critical").otherwise("warning")
    collapse = Found(finding_rows(stats, kind, level, facts, events=F.col("n")), _cited(members))

    rule = Burst(cfg.eviction_count, cfg.window_ms)
    evicted = events.where(F.col("event_type") == "kv.evicted").select(REC, "mono_ns", "sequence", "event_id")
    rows, members = _burst_found(
        evicted, [REC], rule, kind, "evictions:", lambda: {"evictions": F.col("n")},
    )
    return _join(collapse, Found(rows, _cited(members)))


def ended_requests(events: DataFrame) -> DataFrame:
    """Completed or failed requests by bare id whose preceding lifecycle event started them."""
    life = events.where(F.col("event_type").isin("request.started", *R.OUTCOMES) & R.filled("request_id").isNotNull()).select(
        REC, "request_id", "mono_ns", "sequence", "event_id", "event_type"
    )
    mark = {"p_type": F.col("event_type"), "s_ns": F.col("mono_ns"), "s_seq": F.col("sequence"), "s_id": F.col("event_id")}
    paired = lagged(life, [REC, "request_id"], mark)
    return paired.where(F.col("event_type").isin("request.completed", "request.failed") & (F.col("p_type") == "request.started")).withColumn(
        "duration_ms", (F.col("mono_ns") - F.col("s_ns")) / 1e6
    )


def latency_outlier(events: DataFrame, config: Config = Config()) -> Found:
    kind, cfg = "latency-outlier", config.latency
    numbered = positioned(ended_requests(events), [REC])
    blocks = row_blocks(numbered, [REC], cfg.baseline_size)
    w = Window.partitionBy(REC, "__block").orderBy("pos").rowsBetween(-cfg.baseline_size, -1)
    based = blocks.withColumn("base", F.sort_array(F.collect_list("duration_ms").over(w))).where("__home")
    n = F.size("base")
    p95 = F.element_at("base", F.greatest(F.ceil(F.lit(0.95) * n), F.lit(1)).cast("int"))
    judged = based.where(n >= cfg.min_baseline).withColumn("p95", p95).withColumn("n", n).where(
        (F.col("duration_ms") > F.col("p95") * cfg.factor) & (F.col("duration_ms") - F.col("p95") >= cfg.min_excess_ms)
    )
    rows = judged.withColumn("finding_id", _id(kind, F.col("s_id"))).withColumn("start_ns", F.col("s_ns")).withColumn("end_ns", F.col("mono_ns"))
    facts = {
        "request_id": F.col("request_id"), "duration_ms": F.round("duration_ms").cast("bigint"), "baseline_p95_ms": F.round("p95").cast("bigint"),
        "baseline_requests": F.col("n"), "outcome": F.substring_index("event_type", ".", -1),
    }
    level = F.when(F.col("duration_ms") > F.col("p95") * cfg.factor * 2, "critical").otherwise("warning")
    opened = rows.select(REC, "finding_id", F.col("s_id").alias("event_id"), F.col("s_ns").alias("mono_ns"), F.col("s_seq").alias("sequence"))
    return Found(finding_rows(rows, kind, level, facts, events=F.lit(2)), _cited(rows).unionByName(opened))


DETECTORS: dict[str, Callable[[DataFrame, Config], Found]] = {
    "budget-pressure": budget_pressure,
    "compaction": compaction,
    "no-progress-loop": no_progress,
    "duplicate-worker": duplicate_worker,
    "retry-storm": retry_storm,
    "cache-thrash": cache_thrash,
    "model-churn": model_churn,
    "latency-outlier": latency_outlier,
    "error-burst": error_burst,
    "resource-pressure": resource_pressure,
}


def run_all(events: DataFrame, config: Config = Config(), kinds: Iterable[str] | None = None) -> Found:
    """Findings of all (or the named) detectors. Users may add entries to ``DETECTORS``."""
    return _join(*[DETECTORS[k](events, config) for k in (kinds or DETECTORS)])


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(REC, "start_ns", severity_rank().desc(), "finding_id")


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "critical", 2).when(F.col(column) == "warning", 1).otherwise(0)


def filter_findings(findings: DataFrame, min_severity: str = "info", kinds: Iterable[str] = ()) -> DataFrame:
    kept = findings.where(severity_rank() >= SEVERITIES.index(min_severity))
    return kept.where(F.col("kind").isin(*kinds)) if kinds else kept


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(REC).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in reversed(SEVERITIES)])


def resolve_evidence(evidence: DataFrame, events: DataFrame, cls: Column) -> DataFrame:
    """Type, class and seconds since the start of the recording of every cited event; unknown ids stay with nulls."""
    origin = events.groupBy(REC).agg(F.min("mono_ns").alias("origin"))
    facts = events.select(REC, "event_id", "event_type", cls.alias("cls"), F.col("mono_ns").alias("__ns"))
    joined = evidence.select(REC, "finding_id", "event_id").join(facts, [REC, "event_id"], "left").join(origin, REC, "left")
    return joined.select(
        REC, "finding_id", "event_id", F.coalesce("event_type", F.lit("unknown")).alias("event_type"), "cls",
        (F.round((F.col("__ns") - F.col("origin")) / 1e6) / 1e3).alias("rel_s"),
    )
