"""Sliced scans against plain Python folds on random histories that cross many slices."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from beaconlake.operators.islands import bursts, runs
from beaconlake.operators.scans import SLICE_NS, Scan, clamped_sum, lagged, positioned, row_blocks, running, segments
from events import flat


def history(seed: int, n: int = 300) -> list[tuple]:
    rng = random.Random(seed)
    times = sorted(rng.sample(range(0, 12 * SLICE_NS, SLICE_NS // 40), n))
    return [("r", t, f"e{i:04d}", rng.choice("ab"), rng.choice([None, -2, -1, 1, 2])) for i, t in enumerate(times)]


def by_key(rows):
    out = {}
    for row in rows:
        out.setdefault(row[3], []).append(row)
    return out


def test_running_sum_last_next_and_lag(spark):
    rows = history(1)
    df = running(flat(spark, rows), ["recording_id", "k"], [
        Scan("total", "sum", F.col("v")), Scan("held", "last", F.col("v")), Scan("ahead", "next", F.col("v"), inclusive=False), Scan("high", "max", F.col("v")),
    ])
    got = {r["event_id"]: r for r in df.collect()}
    lag = {r["event_id"]: r["p"] for r in lagged(flat(spark, rows), ["recording_id", "k"], {"p": F.col("event_id")}).collect()}
    for group in by_key(rows).values():
        seen = []
        for i, (_, _, eid, _, v) in enumerate(group):
            seen.append(v)
            known = [x for x in seen if x is not None]
            assert got[eid]["total"] == (sum(known) if known else None)
            assert got[eid]["held"] == (known[-1] if known else None)
            assert got[eid]["high"] == (max(known) if known else None)
            assert got[eid]["ahead"] == next((g[4] for g in group[i + 1:] if g[4] is not None), None)
            assert lag[eid] == (group[i - 1][2] if i else None)


def test_clamped_sum_never_falls_below_zero(spark):
    rows = history(2)
    got = {r["event_id"]: (r["used"], r["was"]) for r in clamped_sum(flat(spark, rows), ["recording_id", "k"], F.col("v"), "used", before="was").collect()}
    for group in by_key(rows).values():
        used = None
        for _, _, eid, _, v in group:
            before = used
            if v is not None:
                used = max(0, (used or 0) + v)
            assert got[eid] == (used, before)


def test_segments_and_runs(spark):
    rows = history(3)
    got = {r["event_id"]: r["start"]["event_id"] for r in segments(flat(spark, rows), ["recording_id", "k"], F.col("v"), "start").collect()}
    assert got == {r["event_id"]: r["island"]["event_id"] for r in runs(flat(spark, rows), ["recording_id", "k"], F.col("v")).collect()}
    expect = {}
    for group in by_key(rows).values():
        start, last = None, None
        for _, _, eid, _, v in group:
            if v is not None:
                start = start if v == last else eid
                expect[eid] = start
            last = v
    assert got == expect


def test_bursts(spark):
    rng = random.Random(4)
    for count, window in ((3, 5), (4, 9)):
        unit = SLICE_NS // 10
        rows = [("r", t * unit, f"e{t:04d}", "a", 1) for t in sorted(rng.sample(range(400), 120))]
        got = {r["event_id"]: r["island"]["event_id"] for r in bursts(flat(spark, rows), ["recording_id"], count, window * unit).collect()}
        times = [r[1] for r in rows]
        marked = [any(sum(1 for t in times if s <= t <= s + window * unit) >= count and s <= x <= s + window * unit for s in times) for x in times]
        expect, start, last = {}, None, None
        for (_, t, eid, _, _), inside in zip(rows, marked):
            if not inside:
                start = None
            elif start is None or t - last > window * unit:
                start = eid
            if inside:
                expect[eid] = start
            last = t
        assert got == expect


def test_row_blocks_hold_the_rows_before(spark):
    rows = history(5, 50)
    numbered = positioned(flat(spark, rows), ["recording_id"])
    blocks = [r.asDict() for r in row_blocks(numbered, ["recording_id"], 3, block=10).collect()]
    assert sum(b["__home"] for b in blocks) == 50
    for b in {b["__block"] for b in blocks}:
        mine = sorted(x["pos"] for x in blocks if x["__block"] == b)
        assert mine == list(range(max(1, 10 * b - 2), min(50, 10 * b + 10) + 1))


def test_values_ahead_are_folded_backwards_and_tied_rows_keep_one_order(spark):
    """A frame up to the end of a slice is folded anew for each of its rows: with n rows in a slice that is n squared steps."""
    rows = [("r", SLICE_NS // 100 * t, f"e{t:03d}", "a", t if t % 7 == 0 else None) for t in range(60)]
    twice = flat(spark, rows + rows)
    order = ("mono_ns", "sequence", "event_id")
    for kinds in (("next",), ("last", "next")):
        df = running(twice, ["recording_id"], [Scan(kind, kind, F.col("v"), inclusive=False) for kind in kinds], order)
        assert "unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString().lower()
        got = {}
        for r in df.collect():
            got.setdefault(r["event_id"], []).append([r[kind] for kind in kinds])
        for t, (_, _, eid, _, v) in enumerate(rows):
            ahead = next((x[4] for x in rows[t + 1:] if x[4] is not None), None)
            behind = next((x[4] for x in reversed(rows[:t]) if x[4] is not None), None)
            # Of two equal rows one comes first and has the other ahead, and the other has it behind.
            first, second = ([behind, v if v is not None else ahead], [v if v is not None else behind, ahead])
            expect = [[x[-1]] if kinds == ("next",) else x for x in (first, second)]
            assert sorted(got[eid], key=str) == sorted(expect, key=str)
