"""Prefix trie against brute force: nulls, ties, repeated rows, equal and long conversations, empty tables, small slices."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from beaconlake.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, depth bigint, block bigint, n bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((-1 if turn is None else 0, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, x in made.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    children = {}
    for x in members:
        if x:
            children.setdefault(x[:-1], []).append(x)
    out = []

    def sums(x):
        below = [sums(y) for y in children.get(x, [])]
        saved = sum(s for s, _ in below) + ((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) if x else 0)
        leaves = sum(n for _, n in below) or 1
        ends = ",".join(str(c) for c in sorted(c for c in members[x] if made[c] == x))
        out.append((min(members[x]), len(x), min(members[x[:-1]]) if x else None, len(members[x]), len(children.get(x, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return saved, leaves

    if made:
        sums(())
    return sorted(out, key=lambda r: (r[0], r[1]))


def result(spark, rows):
    table = spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie.prefix_trie(table).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("slices", [prefix_trie.SLICE, 2])
def test_prefix_trie(spark, slices, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", slices)
    rng = random.Random(4)
    texts = ["hello there", "tell me more", "", " \t ", "a\nb c", None, "long " * 50]
    rows = []
    for c in [*range(0, 90), *range(200, 210), 100_003, -7, -20]:
        shared = rng.choice([0, 0, 3, 5, 9])
        talk = [("user" if i % 2 else "system", texts[i % 3]) for i in range(shared)] + [(rng.choice(["user", None]), rng.choice(texts)) for _ in range(rng.randint(0, 7))]
        rows += [(c, i if rng.random() < 0.95 or i else None, *t) for i, t in enumerate(talk)]
    rows += [(300, i, "user", f"turn {i}") for i in range(40)] + [(301, i, "user", f"turn {i}") for i in range(33)] + [(320, i, "user", f"turn {i}") for i in range(40)]
    rows += [(500, i, "user", "same") for i in (0, 0, 0)] + [(None, 0, "user", "no id")]
    assert result(spark, rows) == brute(rows)


def test_deeply_hung_chains(spark):
    """Conversation i shares i turns with the one before: chains hang on chains 24 deep."""
    rows = [(20 * i, d, "user", f"t{min(i, d)} {d}" if d <= i else f"own {i} {d}") for i in range(24) for d in range(i + 3)]
    assert result(spark, rows) == brute(rows)


def test_few(spark):
    assert result(spark, []) == [] and result(spark, [(None, 1, "user", "x")]) == []
    assert result(spark, [(5, None, None, None)]) == brute([(5, None, None, None)])
    one = [(c, 0, "user", "only") for c in (7, 8, 47, 48)]
    assert result(spark, one) == brute(one)
