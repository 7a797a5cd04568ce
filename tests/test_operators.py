"""Operators on small recordings with known results."""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import functions as F

from beaconlake.functions import readings as R
from beaconlake.functions.attrs import Readers
from beaconlake.operators import detectors as D
from beaconlake.operators import gpu
from beaconlake.operators import pipeline as P
from beaconlake.operators import topology as T
from beaconlake.operators.spans import request_spans
from beaconlake.sources.ndjson import parse_lines
from beaconlake.streaming.state import PAGE, advance, base_of, base_row, holes_of, seen_bits, settle
from events import event, lines, load


def test_bad_lines_are_rejected_with_reason_and_number(spark):
    good = json.dumps(event(1, "x.y"))
    wrong = json.dumps({**event(2, "x.y"), "sequence": -1, "run_id": 5})
    manifest = json.dumps({"format": "beacon.telemetry.recording/1"})
    parsed = parse_lines(lines(spark, [manifest, good + "\r", "", "{bad", "5", wrong, manifest, "x" * 50]), max_chars=1_000)
    assert parsed.events.count() == 1 and parsed.manifests.count() == 1
    got = {r["line"]: r["reason"] for r in parsed.rejected.collect()}
    assert got == {
        4: "invalid JSON", 5: "event must be a JSON object", 6: "sequence: must be an integer >= 0; run_id: must be a string or null",
        7: "manifest record is only allowed on line 1", 8: "invalid JSON",
    }


def test_readers_check_the_json_type(spark):
    ev = load(spark, [event(1, "x.y", {"a": 5, "b": 5.0, "c": "5", "d": None, "e": True, "f": 1.5})])
    r = Readers(ev)
    row = ev.select(*[r.num(k).alias(f"n_{k}") for k in "abcdef"], *[r.whole(k).alias(f"w_{k}") for k in "abcdef"], r.text("c").alias("t"), r.text("a").alias("ta"), r.has("d").alias("h"), r.flag("e").alias("fl")).first()
    assert [row[f"n_{k}"] for k in "abcdef"] == [5.0, 5.0, None, None, None, 1.5]
    assert [row[f"w_{k}"] for k in "abcdef"] == [5, 5, None, None, None, None]
    assert (row["t"], row["ta"], row["h"], row["fl"]) == ("5", None, True, True)


def test_span_is_the_latest_start(spark):
    rid = {"request_id": "q"}
    ev = load(spark, [
        event(0, "request.started", **rid), event(5, "inference.token.generated", **rid), event(10, "request.started", **rid), event(12, "inference.token.generated", {"count": 3}, **rid),
        event(14, "inference.token.generated", {"unit": "chunk"}, **rid), event(20, "request.completed", **rid), event(21, "request.failed", **rid), event(22, "inference.token.generated", **rid),
    ])
    s = request_spans(ev).collect()
    assert len(s) == 1
    assert (s[0]["start_ns"], s[0]["end_ns"], s[0]["outcome"], s[0]["tokens"], s[0]["chunks"], s[0]["first_token_ns"]) == (10_000_000, 20_000_000, "completed", 4, 1, 12_000_000)
    assert (s[0]["decode"]["tokens"], s[0]["decode"]["source"]) == (3, "first-output-to-end")


def test_sampler_settings_and_alternatives(spark):
    ev = load(spark, [event(1, "inference.sampling.candidates", {
        "sampling": {"temperature": None, "seed": None, "top_k": 40, "num_ctx": 0, "explicit_only": True, "nested": {"x": 1}},
        "candidates": [{"token_id": 1, "probability": 0.1, "text": "a"}, {"token_id": 2, "probability": 0.7, "text": "b"}, {"token_id": 3}, 5],
    })])
    r = Readers(ev)
    row = ev.select(R.sampler_settings(r).alias("s"), R.read_alternatives(r, F.lit(False)).alias("a"), R.read_alternatives(r, F.lit(True)).alias("b")).first()
    got = {x["key"]: (x["text"], x["model_default"]) for x in row["s"]}
    assert got == {"temperature": ("model default", True), "seed": ("unset (backend chooses)", False), "top_k": ("40", False), "num_ctx": ("model default", True)}
    assert [(x["token_id"], x["text"]) for x in row["a"]] == [(2, None), (1, None)]
    assert [x["text"] for x in row["b"]] == ["b", "a"]


def test_gpu_context_null_is_a_value_and_counts_do_not_inflate(spark):
    sample = lambda ms, **a: event(ms, "backend.gpu_memory.sample", {"backend": "b", **a})
    warn = lambda ms, **a: event(ms, "backend.warning", {"backend": "b", "code": "c", **a})
    ev = load(spark, [sample(1, samples=3, fitted_ctx=8), sample(2, samples=9, fitted_ctx=8), sample(3, samples=2, fitted_ctx=None), sample(4, samples=4), warn(5), warn(6, count=5), warn(7, count=5), warn(8), warn(9, message="m")])
    assert [r["fitted_ctx"] for r in gpu.gpu_context_changes(ev).orderBy("mono_ns").collect()] == [8, None]
    assert [r["epoch"] for r in gpu.gpu_samples(ev).orderBy("mono_ns").collect()] == [0, 0, 1, 1]
    assert gpu.gpu_warnings(ev).first()["count"] == 7


def test_duplicate_workers_by_hand(spark):
    """One task each: agents that overlap, agents that only touch, a second cluster after all have ended, one that stays open."""
    steps = {
        "overlap": [("s", "a"), ("s", "b"), ("e", "a"), ("e", "b")], "touch": [("s", "c"), ("e", "c"), ("s", "d"), ("e", "d")],
        "twice": [("s", "f"), ("s", "g"), ("e", "g"), ("e", "f"), ("s", "f2"), ("s", "g2"), ("e", "f2"), ("e", "g2")], "open": [("s", "h"), ("s", "i"), ("s", "j"), ("e", "h")],
    }
    cited = {("overlap", 0): range(4), ("twice", 0): range(4), ("twice", 4): range(4, 8), ("open", 0): range(4)}
    made, name, at = [], {}, 0
    for task, todo in steps.items():
        for i, (step, agent) in enumerate(todo):
            at += 1_500
            made.append(event(at, "agent.spawned" if step == "s" else "agent.completed", {"task": task} if step == "s" else {}, agent_id=agent))
            name[(task, i)] = made[-1]["event_id"]
    found = D.duplicate_worker(load(spark, made))
    task = {r["finding_id"]: r["facts"]["task"] for r in found.findings.collect()}
    got = {}
    for r in found.evidence.collect():
        got.setdefault(r["finding_id"], set()).add(r["event_id"])
    assert {(task[f], frozenset(ids)) for f, ids in got.items()} == {(t, frozenset(name[(t, i)] for i in places)) for (t, _), places in cited.items()}


def test_line_edges(spark):
    from beaconlake.sources.ndjson import parse_lines

    rows = [("r", "p", 1, "\ufeff{\"a\": 1}\u00a0"), ("r", "p", 2, "\u00a0\ufeff"), ("r", "p", 3, "{")]
    lines = spark.createDataFrame(rows, "recording_id string, path string, line bigint, value string")
    rejected = {r["line"]: r["reason"] for r in parse_lines(lines).rejected.collect()}
    assert set(rejected) == {1, 3} and rejected[3] == "invalid JSON" and rejected[1] != "invalid JSON"


def test_stage_goes_back_only_on_preemption(spark):
    rid = {"request_id": "q"}
    ev = load(spark, [event(1, "request.queued", **rid), event(2, "scheduler.admitted", **rid), event(3, "inference.decode.started", **rid), event(4, "kv.allocated", **rid), event(5, "scheduler.preempted", **rid), event(6, "scheduler.admitted", **rid)])
    rows = P.staged(ev)
    assert [r["stage"] for r in P.pipeline_requests(rows).collect()] == ["prefill"]
    assert {r["stage"]: r["entered_ns"] // 1_000_000 for r in P.request_stage(rows).collect()} == {"queue": 5, "prefill": 6, "decode": 3}


def test_pages_of_sequence_numbers():
    """Holes of a page, whatever order its numbers come in; a full page needs no bits."""
    rng = random.Random(1)
    for _ in range(50):
        numbers = rng.sample(range(PAGE), rng.choice([1, 5, 900, PAGE - 1]))
        held = None
        for i in range(0, len(numbers), 7):
            bits = seen_bits(held, np.array(numbers[i : i + 7]))
            held = b"" if bits.all() else np.packbits(bits).tobytes()
        seen = sorted(numbers)
        lo, hi, starts, ends = holes_of(bits)
        assert (lo, hi) == (seen[0], seen[-1]) and list(zip(starts, ends)) == [(a + 1, b - 1) for a, b in zip(seen, seen[1:]) if b > a + 1]
    assert seen_bits(b"", np.array([3])).all()


def test_span_state_does_not_depend_on_the_order_of_arrival():
    rows = [[1, 0, "a", 1, "output", 5, None, "p"], [2, 0, "b", 2, "start", None, None, "p"], [3, 0, "c", 3, "output", 2, None, "p"], [4, 0, "d", 4, "completed", None, 9, "p"],
            [6, 0, "f", 6, "start", None, None, "q"], [6, 1, "g", 6, "output", 3, None, "q"], [7, 0, "h", 7, "output", None, None, "q"], [8, 0, "i", 8, "completed", None, 4, "q"], [9, 0, "j", 9, "failed", None, 7, "q"]]
    want = {"start": [6, 0, "f"], "producer": "q", "end": [8, 0, "i", "completed", 4], "first_token_ns": 6, "tokens": 3, "chunks": 1}
    assert advance(None, rows) == want
    rng = random.Random(2)
    for _ in range(200):
        base, recent, left, newest = None, [], rng.sample(rows, len(rows)), 0
        delay = rng.choice([2, 4, 100])
        # Rows come at most ``delay`` behind the newest one before them.
        left.sort(key=lambda r: r[3] + rng.random() * (delay if delay == 100 else delay / 2))
        while left:
            n = rng.randint(1, 4)
            recent += left[:n]
            span = advance(base, recent)
            newest, left = max(newest, *(r[3] for r in left[:n])), left[n:]
            base, recent, _ = settle(base, recent, newest - delay)
            assert base is None or base_of(base_row(base)) == base
        assert span == want


def test_depth_of_agents_that_spawn_each_other(spark):
    """One event mentions the spawned agent before the one that spawned it."""
    said = [(1, "x", "b"), (2, "b", "x"), (3, "k", "r")]
    rows = [("rec", at, 0, f"e{at}", [("agent", child), ("agent", parent)], [("delegation", f"agent:{parent}", f"agent:{child}")]) for at, child, parent in said]
    stated = spark.createDataFrame(rows, "recording_id string, mono_ns bigint, sequence bigint, event_id string, nodes array<struct<kind: string, entity: string>>, edges array<struct<kind: string, src: string, dst: string>>")
    assert {r["node_id"]: r["depth"] for r in T.delegation_depth(stated).collect()} == {"agent:x": 0, "agent:b": 1, "agent:r": 0, "agent:k": 1}


def test_ranks_are_exact_however_the_values_lie(spark):
    """Nearest ranks of spread, clustered, tied, negative and single values equal those of the sorted list."""
    from beaconlake.operators.metrics import nearest_ranks

    rng = random.Random(6)
    groups = {
        "spread": [rng.randrange(10**12) for _ in range(900)], "close": [10**9 + rng.randrange(3000) for _ in range(900)], "tied": [rng.choice([5, 5, 5, 7]) for _ in range(90)],
        "signed": [rng.randrange(-50, 50) for _ in range(300)], "one": [0], "two": [3, 9], "tail": [1] * 94 + [10**15] * 6,
    }
    rows = [(k, v, v / 7) for k, some in groups.items() for v in some] + [("null", None, None), ("one", None, None)]
    table = spark.createDataFrame(rows, "k string, v bigint, x double")
    for column in ("v", "x"):
        got = {r["k"]: (r["count"], r["p50"], r["p95"], r["max"]) for r in nearest_ranks(table, ["k"], F.col(column)).collect()}
        at = lambda some, p: sorted(some)[max(1, -(-p * len(some) // 100)) - 1]
        want = {k: [x / 7 if column == "x" else x for x in some] for k, some in groups.items()}
        assert got == {k: (len(some), at(some, 50), at(some, 95), max(some)) for k, some in want.items()}


def test_depth_along_long_chains(spark):
    """A chain of 3,000 agents, side branches that meet again, and a cycle without a root."""
    spawned = [(i, i + 1) for i in range(3000)] + [(10, 5000), (5000, 5001), (5001, 2500), (2990, 20), (7000, 7001), (7001, 7000), (7001, 7002)]
    rows = [("rec", at, 0, f"e{at}", [("agent", f"{child:05}"), ("agent", f"{parent:05}")], [("delegation", f"agent:{parent:05}", f"agent:{child:05}")]) for at, (parent, child) in enumerate(spawned)]
    stated = spark.createDataFrame(rows, "recording_id string, mono_ns bigint, sequence bigint, event_id string, nodes array<struct<kind: string, entity: string>>, edges array<struct<kind: string, src: string, dst: string>>")
    near, todo, after = {0: 0}, [0], {}
    for a, b in spawned:
        after.setdefault(a, []).append(b)
    while todo:
        a = todo.pop(0)
        for b in after.get(a, ()):
            if b not in near:
                near[b] = near[a] + 1
                todo.append(b)
    want = {f"agent:{k:05}": v for k, v in near.items()} | {"agent:07001": 0, "agent:07000": 1, "agent:07002": 1}
    assert {r["node_id"]: r["depth"] for r in T.delegation_depth(stated).collect()} == want
