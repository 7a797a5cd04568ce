"""Stateful processors over states held in memory, which count the calls that a session would send to the JVM."""

from __future__ import annotations

import random

from beaconlake.plans import queries_ingest as qi
from beaconlake.streaming.state import PAGE, ROW, GapProcessor, SpanProcessor, packed_pages, pages_of
from pyspark.sql import Row


class Held:
    """A value or list state of every key, and the timers of a processor."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value if self.value is not None or not isinstance(self, HeldList) else iter(())

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None


class HeldList(Held):
    def appendList(self, rows):
        self.calls, self.value = self.calls + 1, (self.value or []) + rows

    put = Held.update


class Handle:
    def __init__(self):
        self.states, self.timers = [], set()

    def _made(self, state):
        self.states.append(state)
        return state

    def getValueState(self, name, schema):
        return self._made(Held())

    def getListState(self, name, schema):
        return self._made(HeldList())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def calls(self):
        return sum(s.calls for s in self.states)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_pages_come_back_as_they_were_packed():
    pages = {3: bytes(range(256)) * 2, 0: b"", 7_000_000: b"\x80" + bytes(PAGE // 8 - 1)}
    assert pages_of(packed_pages(pages)) == pages
    assert pages_of(packed_pages({})) == {}


def test_gaps_of_a_block_take_two_calls_of_the_state_a_batch():
    rng = random.Random(1)
    numbers = sorted(rng.sample(range(5 * PAGE), 300)) + list(range(6 * PAGE, 7 * PAGE))
    rng.shuffle(numbers)
    handle, processor, latest = Handle(), GapProcessor(), {}
    processor.init(handle)
    for part in range(4):
        before = handle.calls()
        for row in processor.handleInputRows(("r", "s", 0), iter([Row(sequence=n) for n in numbers[part::4]]), None):
            assert row.seen > latest[row.page].seen if row.page in latest else True
            latest[row.page] = row
        assert handle.calls() - before <= 2
    assert list(processor.handleInputRows(("r", "s", 0), iter([Row(sequence=numbers[0])]), None)) == []
    for page, row in latest.items():
        own = sorted(n for n in numbers if n // PAGE == page)
        holes = [(a + 1, b - 1) for a, b in zip(own, own[1:]) if b > a + 1]
        assert (row.seen, row.lo, row.hi, list(zip(row.gap_from, row.gap_to))) == (len(own), own[0], own[-1], holes)


def _row(ms, kind, n=None):
    return Row(**dict(zip(ROW, (ms * 10, ms, f"e{ms}", ms, kind, n, None, "p"), strict=True)))


def test_spans_are_held_over_batches_and_a_new_request_takes_one_look():
    handle, processor, key = Handle(), SpanProcessor(100), ("r", "s", "q")
    processor.init(handle)
    first = list(processor.handleInputRows(key, iter([_row(3, "output", 4)]), At(0)))
    assert handle.calls() <= 3 and (first[0].start_ns, first[0].unmatched, first[0].expired) == (None, 1, False)
    second = list(processor.handleInputRows(key, iter([_row(1, "start"), _row(5, "completed")]), At(0)))
    assert second[0].asDict() == {"recording_id": "r", "stream": "s", "request_id": "q", "start_ns": 10, "end_ns": 50, "outcome": "completed", "first_token_ns": 30, "tokens": 4, "chunks": 0, "backend_tokens": None, "producer": "p", "unmatched": 0, "expired": False}
    assert handle.timers == {6}
    assert list(processor.handleExpiredTimer(key, At(6), None)) == [] and handle.timers == {6, 105}
    third = list(processor.handleInputRows(key, iter([_row(7, "output")]), At(6)))
    assert (third[0].start_ns, third[0].tokens, third[0].chunks) == (10, 4, 1)
    gone = list(processor.handleExpiredTimer(key, At(400), None))
    assert [(r.start_ns, r.chunks, r.expired) for r in gone] == [(10, 1, True)] and all(s.value is None for s in handle.states)


def test_latency_of_a_recording_is_planned_over_stored_spans(spark, tmp_path):
    rows = [(i, 1_000 * i, 1, kind, 0, f"{i}.5") for i, kind in enumerate(("signup", "click", "purchase"))]
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t0").crossJoin(spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, k int, v string")).selectExpr(
        "event_id", "timestampadd(MICROSECOND, us, t0) AS ts", "user_id", "event_type", "CAST(v AS DOUBLE) AS value", "'{\"k\": 8}' AS props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    out = qi.recording_to_latency(spark, str(tmp_path))
    assert all("/spans-" in f for f in out.inputFiles()) and out.inputFiles()
    assert [tuple(r) for r in out.collect()] == [("r1", 1, 0.002, 0.002, 0.002)]
