"""Phrase mining against brute force: nulls, empty texts, repeated rows, ties, separators, tight summaries and crowded filters."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from beaconlake.llm import phrase_mining

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n bigint, k string"


def brute(rows, threshold=10, top=2000):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            own.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        found = []
        for p, a in own.items():
            if len(p) == 1 or a < threshold or any(len(p) == 2 and p in (q[:2], q[1:]) and b >= threshold and 100 * b >= 50 * a for q, b in own.items() if len(q) == 3):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:c]] * own[p[c:]]), c, own[p[:c]], own[p[c:]]) for c in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["a", "b", "C", "the", "x\u0001y", "é", "日本", "#", "B", "new", "york", "city"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for _ in range(n))
    out = [(make(rng.randint(0, 60)), rng.choice(["en", "en", "fr", None])) for _ in range(120)] + [("New York City, new york city", "en")] * 12
    return out + [(None, "en"), ("", None), (" \t\n", "fr"), ("one", "xx"), ("word " * 3000, "de"), ("only here once", None)]


@pytest.mark.parametrize("how", [{}, {"partition_mass": 200, "slice_bits": 64}, {"filter_bytes": 64}])
def test_collocations(spark, rows, how, monkeypatch):
    if "partition_mass" in how:  # many blocks, so that summaries are merged from many parts
        monkeypatch.setattr(phrase_mining, "UNIT_BYTES", 200)
    table = spark.createDataFrame([(i, t, g, "p", 1, "k") for i, (t, g) in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, phrase_mining.collocations(table, **how).collect())) == brute(rows)
    assert sorted(map(tuple, phrase_mining.collocations(table, top=5, **how).collect())) == brute(rows, top=5)
    assert sorted(map(tuple, phrase_mining.collocations(table, threshold=300, **how).collect())) == brute(rows, threshold=300)


def test_empty(spark):
    assert phrase_mining.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrase_mining.collocations(spark.createDataFrame([(1, None, None, None, 1, None)], SCHEMA)).count() == 0


def test_summary_keeps_every_frequent_key():
    """At a capacity just above mass / threshold no key at the threshold is lost, in whatever order its counts come."""
    rng = np.random.default_rng(1)
    for threshold in (5, 10, 40):
        common, rare = np.repeat(np.arange(50), threshold), np.arange(50, 20_000)
        stream = rng.permutation(np.r_[common, rare, rare[:4000]]).astype(np.uint64)
        summary = phrase_mining.Summary(len(stream) // threshold + 1)
        for part in np.array_split(stream, 300):
            keys, counts = np.unique(part, return_counts=True)
            summary.waiting.append((keys, counts))
            summary.fold()
            assert len(summary.keys) <= summary.capacity
        assert set(range(50)) <= set(summary.frequent(threshold).tolist()) and summary.taken < threshold
