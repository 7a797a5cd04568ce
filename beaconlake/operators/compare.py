"""Baseline against candidate: request facts, unit statistics, alignment, deltas and diffs.

A comparison is a pair: every recording carries ``pair_id`` and ``side`` ('a' or
'b'), so any number of pairs is compared in one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.functions.classify import is_error
from beaconlake.operators.detectors import Found, severity_rank
from beaconlake.operators.metrics import nearest_ranks
from beaconlake.operators.scans import Scan, positioned, running
from beaconlake.operators.spans import request_spans
from beaconlake.schema import ord_col
from beaconlake.session import cut_lineage

REC = "recording_id"
MODES = ("run", "request", "turn")


def request_facts(events: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Facts of every bare request id; where streams share an id, the one started last is meant."""
    spans = request_spans(events) if spans is None else spans
    r, t = Readers(events), F.col("event_type")
    base = spans.groupBy(REC, "request_id").agg(
        F.max_by(F.struct("start_ns", "outcome", "first_token_ns", "tokens"), "first_start").alias("s"),
        F.max_by("decode", F.when(F.col("decode").isNotNull(), F.col("first_start"))).alias("decode"),
    )
    ends = t.isin(*R.OUTCOMES)
    reported = r.num("ttft_ms")
    token = (t == "inference.token.generated") & R.output_token_count(r).isNotNull()
    rows = events.where(R.filled("request_id").isNotNull()).select(
        REC, "request_id", "mono_ns", "sequence", "event_id", R.filled("run_id").alias("run_id"), R.turn_id(r).alias("turn"), R.prompt_tokens(r).alias("prompt"),
        F.when(token, F.col("mono_ns")).alias("token_ns"), R.reported_decode_rate(r).alias("rate"), F.when(ends, R.reported_completion_tokens(r)).alias("completion"),
        F.when(ends, R.cost_usd(r)).alias("cost"), F.when(ends & (reported >= 0), reported).alias("ttft"),
    )
    at = ord_col()
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    folded = rows.groupBy(REC, "request_id").agg(
        first("run_id"), first("turn"), F.max("prompt").alias("prompt_tokens"), F.max("token_ns").alias("last_token_ns"),
        F.max_by("rate", F.when(F.col("rate").isNotNull(), at)).alias("rate"), first("completion"), F.sum("cost").alias("cost_usd"), first("ttft"),
    )
    j = base.join(folded, [REC, "request_id"], "left")
    own = (F.col("s.first_token_ns") - F.col("s.start_ns")) / 1e6
    streamed, begin, stop = F.col("s.tokens"), F.col("s.first_token_ns"), F.col("last_token_ns")
    counted = F.when((streamed >= 2) & (stop > begin), (streamed - 1) / (F.nullif(stop - begin, F.lit(0)) / 1e9))
    window = F.when((F.col("decode.tokens") > 0) & (F.col("decode.ns") > 0), F.col("decode.tokens") / (F.nullif(F.col("decode.ns"), F.lit(0.0)) / 1e9))
    return j.select(
        REC, "request_id", "run_id", "turn", F.col("s.start_ns").alias("start_ns"), F.col("s.outcome").alias("outcome"), F.coalesce(own, "ttft").alias("ttft_ms"),
        F.when(own.isNotNull(), "derived").when(F.col("ttft").isNotNull(), "reported").alias("ttft_source"), streamed.alias("streamed_tokens"),
        F.coalesce("rate", counted, window).alias("decode_tok_per_sec"),
        F.when(F.col("rate").isNotNull(), "reported").when(counted.isNotNull() | window.isNotNull(), "derived").alias("decode_source"),
        "prompt_tokens", F.coalesce("completion", F.when(streamed > 0, streamed.cast("double"))).alias("completion_tokens"), "cost_usd",
    )


def keyed_units(events: DataFrame, facts: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(events, requests) with the ``unit`` they belong to; null where nothing names one.

    Turns that no producer reports are inferred: one turn per request, in start order.
    """
    turn = R.turn_id(Readers(events))
    known = facts
    if mode == "turn":
        stated = events.where(turn.isNotNull()).select(REC).distinct().withColumn("reported", F.lit(True))
        numbered = positioned(facts, [REC], order=("start_ns", "request_id"), slice_by="start_ns").join(stated, REC, "left")
        known = numbered.withColumn("unit", F.when(F.col("reported"), F.col("turn")).otherwise(F.concat(F.lit("#"), "pos"))).drop("pos", "reported")
    else:
        known = facts.withColumn("unit", F.col("request_id" if mode == "request" else "run_id"))
    joined = events.join(known.select(REC, "request_id", F.col("unit").alias("__unit"), F.lit(True).alias("__known")), [REC, "request_id"], "left")
    own = {"request": F.lit(None).cast("string"), "run": R.filled("run_id"), "turn": turn}[mode]
    return joined.withColumn("unit", F.coalesce(own, "__unit")).drop("__unit", "__known"), known


def unattributed_events(events: DataFrame, facts: DataFrame, mode: str) -> DataFrame:
    keyed, _ = keyed_units(events, facts, mode)
    return keyed.groupBy(REC).agg(F.count_if(F.col("unit").isNull()).alias("unattributed"))


def unit_stats(events: DataFrame, facts: DataFrame, mode: str = "session") -> DataFrame:
    """Statistics per unit: the session, or each run, request or turn."""
    if mode == "session":
        rows, requests = events.withColumn("unit", F.lit("session")), facts.withColumn("unit", F.lit("session"))
    else:
        rows, requests = keyed_units(events, facts, mode)
    keys = [REC, "unit"]
    lookup = R.cache_lookup()
    r = Readers(events)
    per_event = rows.where("unit IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.min("mono_ns").alias("first_event_ns"), F.count_if(F.col("event_type") == "retry.scheduled").alias("retries"),
        F.count_if(lookup == "hit").alias("cache_hits"), F.count_if(lookup == "miss").alias("cache_misses"), F.count_if(is_error()).alias("errors"),
        F.max(R.budget_pressure_fraction(r)).alias("budget_peak_fraction"), F.max_by(R.cost_budget_usd(r), F.when(R.cost_budget_usd(r).isNotNull(), ord_col())).alias("budget"),
    )
    mine = requests.where("unit IS NOT NULL")
    n = F.coalesce("completion_tokens", F.col("streamed_tokens").cast("double"))
    rated = F.when(F.col("decode_tok_per_sec").isNotNull() & (n > 0), n)
    per_request = mine.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.min("start_ns").alias("first_start_ns"), F.count_if(F.col("outcome") == "failed").alias("failed_requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"),
        F.sum(rated).alias("rated_tokens"), F.sum(rated / F.col("decode_tok_per_sec")).alias("rated_seconds"),
    )
    ttft = nearest_ranks(mine.where("ttft_ms IS NOT NULL"), keys, F.col("ttft_ms"))
    joined = per_event.join(per_request, keys, "full_outer").join(ttft, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    looked = F.col("cache_hits") + F.col("cache_misses")
    share = F.when(F.lit(mode == "session"), F.try_divide("cost_usd", "budget"))
    return joined.select(
        *keys, F.least("first_event_ns", "first_start_ns").alias("first_ns"), zero("events"), zero("requests"), zero("failed_requests"), F.col("p50").alias("ttft_ms"),
        F.col("p95").alias("ttft_p95_ms"), F.when(F.col("rated_seconds") > 0, F.try_divide("rated_tokens", "rated_seconds")).alias("decode_tok_per_sec"), "prompt_tokens",
        "completion_tokens", "cost_usd", share.alias("cost_budget_fraction"), "budget_peak_fraction", zero("retries"), zero("cache_hits"), zero("cache_misses"),
        F.when(looked > 0, F.try_divide("cache_hits", looked)).alias("cache_hit_rate"), zero("errors"),
    )


# Compared metrics as (column, direction that is better, tolerance).
METRICS = (
    ("requests", "neutral", 0.0), ("ttft_ms", "lower", 0.005), ("ttft_p95_ms", "lower", 0.005), ("decode_tok_per_sec", "higher", 0.005), ("prompt_tokens", "neutral", 0.0),
    ("completion_tokens", "neutral", 0.0), ("cost_usd", "lower", 0.005), ("cost_budget_fraction", "lower", 0.005), ("budget_peak_fraction", "lower", 0.005),
    ("retries", "lower", 0.0), ("failed_requests", "lower", 0.0), ("errors", "lower", 0.0), ("cache_hit_rate", "higher", 0.005),
)


def split_sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("side = 'a'"), rows.where("side = 'b'")


def align_units(units: DataFrame, inferred: Column | None = None) -> DataFrame:
    """Units of both sides side by side (``pair_id, side, unit, first_ns``).

    Units are matched by key where the sides share one and no key was inferred, else
    by position. ``place`` and ``b_pos`` give the display order: a unit only in B
    follows the last shared unit before it.
    """
    # The short unit table is met several times below, so it is computed once.
    ranked = cut_lineage(positioned(units.select("pair_id", "side", "unit", "first_ns"), ["pair_id", "side"], order=("first_ns", "unit"), slice_by="first_ns"))
    a, b = split_sides(ranked)
    a = a.select("pair_id", F.col("unit").alias("a_unit"), F.col("pos").alias("a_pos"))
    b = b.select("pair_id", F.col("unit").alias("b_unit"), F.col("pos").alias("b_pos"))
    met = b.join(a.select("pair_id", F.col("a_unit").alias("b_unit"), F.col("a_pos").alias("met")), ["pair_id", "b_unit"], "left")
    by_id = met.groupBy("pair_id").agg((F.count("met") > 0).alias("by_id"))
    if inferred is not None:
        by_id = by_id.withColumn("by_id", F.col("by_id") & ~inferred)
    anchored = running(met, ["pair_id"], [Scan("anchor", "last", F.col("met"))], order=("b_pos",), slice_by="b_pos", width=1_000_000)
    mode = F.coalesce("by_id", F.lit(False))
    left = a.join(by_id, "pair_id", "left").withColumn("match", F.when(mode, F.col("a_unit")).otherwise(F.col("a_pos").cast("string")))
    right = anchored.join(by_id.withColumnRenamed("by_id", "b_by_id"), "pair_id", "left").withColumn(
        "match", F.when(F.coalesce("b_by_id", F.lit(False)), F.col("b_unit")).otherwise(F.col("b_pos").cast("string"))
    )
    joined = left.join(right, ["pair_id", "match"], "full_outer")
    matched = F.coalesce("by_id", "b_by_id", F.lit(False))
    place = F.when(F.col("a_pos").isNotNull(), F.col("a_pos").cast("double")).when(matched, F.coalesce("anchor", F.lit(0)) + 0.5).otherwise(F.col("b_pos").cast("double"))
    status = F.when(F.col("a_unit").isNotNull() & F.col("b_unit").isNotNull(), "matched").when(F.col("a_unit").isNotNull(), "only-a").otherwise("only-b")
    return joined.select("pair_id", "a_unit", "b_unit", status.alias("status"), F.when(matched, "id").otherwise("position").alias("matched_by"), place.alias("place"), "b_pos")


def metric_deltas(units: DataFrame, alignment: DataFrame | None = None) -> DataFrame:
    """Delta, relative change and verdict of every metric of aligned units (of the session without an alignment)."""
    pieces = ", ".join(f"'{name}', cast({name} as double)" for name, _, _ in METRICS)
    long = units.selectExpr("pair_id", "side", "unit", f"stack({len(METRICS)}, {pieces}) AS (metric, value)")
    a, b = split_sides(long)
    a, b = a.select("pair_id", F.col("unit").alias("a_unit"), "metric", F.col("value").alias("a")), b.select("pair_id", F.col("unit").alias("b_unit"), "metric", F.col("value").alias("b"))
    if alignment is None:
        joined = a.join(b.withColumnRenamed("b_unit", "a_unit"), ["pair_id", "a_unit", "metric"], "full_outer").withColumnRenamed("a_unit", "unit")
    else:
        grid = alignment.select("pair_id", "a_unit", "b_unit").withColumn("metric", F.explode(F.array(*[F.lit(n) for n, _, _ in METRICS])))
        joined = grid.join(a, ["pair_id", "a_unit", "metric"], "left").join(b, ["pair_id", "b_unit", "metric"], "left").withColumn("unit", F.coalesce("a_unit", "b_unit"))
    polarity, tolerance = F.lit("neutral"), F.lit(0.0)
    for name, better, limit in METRICS:
        polarity = F.when(F.col("metric") == name, better).otherwise(polarity)
        tolerance = F.when(F.col("metric") == name, limit).otherwise(tolerance)
    delta = F.col("b") - F.col("a")
    relative = F.when(F.col("a") != 0, F.try_divide(delta, F.abs("a")))
    same = (delta == 0) | ((tolerance > 0) & F.coalesce(F.abs(relative) < tolerance, F.lit(False)))
    improved = F.when(polarity == "lower", delta < 0).otherwise(delta > 0)
    verdict = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), "n/a").when(F.col("a").isNull(), "only-b").when(F.col("b").isNull(), "only-a").when(same, "same")
        .when(polarity == "neutral", "changed").when(improved, "better").otherwise("worse")
    )
    return joined.select("pair_id", "unit", "metric", "a", "b", delta.alias("delta"), relative.alias("relative"), verdict.alias("verdict"))


# Facts that name the subject of a finding, in signature order.
SIGNATURE_FACTS = ("scope", "budget", "task", "actor", "tool", "models", "targets", "request_id", "kind", "device_id")
LIST_FACTS = ("models", "targets")


def finding_signatures(found: Found, subject_map: DataFrame | None = None) -> DataFrame:
    """Findings with ``signature``: kind and subject, the same for the same trouble in another recording.

    ``subject_map`` (recording_id, subject, mapped) renames request ids of this side.
    """
    findings, subjects = found.findings, found.subjects
    if subject_map is not None:
        names = subject_map.select(REC, F.col("subject").alias("__rid"), F.col("mapped").alias("__mapped"))
        findings = findings.withColumn("__rid", F.col("facts")["request_id"]).join(names, [REC, "__rid"], "left").drop("__rid")
    else:
        findings = findings.withColumn("__mapped", F.lit(None).cast("string"))
    lists = None
    if subjects is not None:
        items = subjects.where(F.col("fact").isin(*LIST_FACTS)).select(REC, "finding_id", "fact", F.trim("subject").alias("subject"))
        if subject_map is not None:
            items = items.join(subject_map.select(REC, "subject", "mapped"), [REC, "subject"], "left").withColumn("subject", F.coalesce("mapped", "subject"))
        distinct = items.where("subject <> ''").select(REC, "finding_id", "fact", "subject").distinct()
        # Two sums over digests stand for the whole list: no order, no limit, combined map-side.
        part = lambda start: F.sum(F.conv(F.substring(F.md5(F.col("subject").cast("binary")), start, 8), 16, 10).cast("bigint"))
        lists = distinct.groupBy(REC, "finding_id").agg(
            F.max("fact").alias("__list"), F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(9).cast("string")).alias("__items")
        )
        findings = findings.join(lists, [REC, "finding_id"], "left")
    parts = [F.col("kind")]
    for key in SIGNATURE_FACTS:
        value = F.nullif(F.col("facts")[key], F.lit(""))
        if key == "request_id":
            value = F.coalesce("__mapped", value)
        if key in LIST_FACTS:
            value = F.when(F.col("__list") == key, F.col("__items")) if lists is not None else F.lit(None).cast("string")
        parts.append(F.concat(F.lit(f"{key}="), value))
    signed = findings.withColumn("signature", F.concat_ws("|", *parts))
    return signed.drop("__mapped", "__list", "__items")


def diff_findings(findings: DataFrame) -> DataFrame:
    """Added, resolved and persisting findings of signed findings with ``pair_id`` and ``side``.

    Pairs within a signature: first those of equal severity in start order, then the rest in start order.
    """
    rows = findings.select("pair_id", "side", "signature", "finding_id", "kind", "severity", "start_ns")
    order = ("start_ns", "finding_id")
    first = positioned(rows, ["pair_id", "side", "signature", "severity"], "n1", order=order, slice_by="start_ns")
    a, b = split_sides(first)
    keys = ["pair_id", "signature", "severity", "n1"]
    b1 = b.select(*keys, F.col("finding_id").alias("b_id"), F.col("start_ns").alias("b_start"))
    a1 = a.select(*keys, F.col("finding_id").alias("a_id"), F.col("start_ns").alias("a_start"))
    equal = a1.join(b1, keys).select("pair_id", "signature", "a_id", "b_id", F.col("severity").alias("a_severity"), F.col("severity").alias("b_severity"))
    rest_a = a1.join(b1.select(*keys), keys, "left_anti").select("pair_id", F.lit("a").alias("side"), "signature", "severity", F.col("a_id").alias("finding_id"), F.col("a_start").alias("start_ns"))
    rest_b = b1.join(a1.select(*keys), keys, "left_anti").select("pair_id", F.lit("b").alias("side"), "signature", "severity", F.col("b_id").alias("finding_id"), F.col("b_start").alias("start_ns"))
    second = positioned(rest_a.unionByName(rest_b), ["pair_id", "side", "signature"], "n2", order=order, slice_by="start_ns")
    a2, b2 = split_sides(second)
    k2 = ["pair_id", "signature", "n2"]
    left = a2.select(*k2, F.col("finding_id").alias("a_id"), F.col("severity").alias("a_severity"))
    right = b2.select(*k2, F.col("finding_id").alias("b_id"), F.col("severity").alias("b_severity"))
    other = left.join(right, k2, "full_outer").drop("n2")
    both = equal.unionByName(other)
    change = severity_rank("b_severity") - severity_rank("a_severity")
    status = F.when(F.col("a_id").isNull(), "added").when(F.col("b_id").isNull(), "resolved").otherwise("persisting")
    trend = F.when(status == "persisting", F.when(change > 0, "escalated").when(change < 0, "eased"))
    return both.select("pair_id", "signature", "a_id", "b_id", "a_severity", "b_severity", status.alias("status"), trend.alias("severity_change"))


def diff_graph(rows: DataFrame, id_column: str, counts: tuple[str, ...] = ()) -> DataFrame:
    """Added, removed, changed or unchanged nodes (or edges with ``counts``) of ``pair_id, side, id, status``."""
    a, b = split_sides(rows.select("pair_id", "side", id_column, "status", *counts))
    a = a.select("pair_id", id_column, F.col("status").alias("a_status"), *[F.col(c).alias(f"a_{c}") for c in counts])
    b = b.select("pair_id", id_column, F.col("status").alias("b_status"), *[F.col(c).alias(f"b_{c}") for c in counts])
    deltas = [(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_delta") for c in counts]
    moved = reduce(lambda x, y: x | y, [F.col(f"a_{c}") != F.col(f"b_{c}") for c in counts], F.col("a_status") != F.col("b_status"))
    change = F.when(F.col("a_status").isNull(), "added").when(F.col("b_status").isNull(), "removed").when(moved, "changed").otherwise("same")
    return a.join(b, ["pair_id", id_column], "full_outer").select("pair_id", id_column, change.alias("change"), "a_status", "b_status", *deltas)
