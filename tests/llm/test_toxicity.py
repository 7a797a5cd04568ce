"""Toxicity: chain sums against all paths, slopes against differences, learning from labels and from tags, spans, edge cases."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from beaconlake.llm import sketch, toxicity

SCHEMA = "doc_id bigint, text string, lang string, score string, spans string, held_out int"
BAD = ["grumbit", "sneerle", "vilefoo"]


def prose(rng, words):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(words)]


def made(rng, toxic, words=60):
    text = prose(rng, words)
    for _ in range(rng.randint(1, 3) if toxic else 0):
        text[rng.randrange(len(text))] = rng.choice(BAD) + rng.choice(["", "s", "ing", "!"])
    return " ".join(text)


def test_chain_equals_all_paths():
    rng = np.random.default_rng(0)
    for lens in ([1, 3, 0, 5, 2], [7], [0], [1] * 9, [4, 9]):
        text = np.repeat(np.arange(len(lens)), lens)
        first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, dtype=bool)
        score, pairs = rng.normal(0, 2, len(text)), rng.normal(0, 1, 3)
        growth, marginal, both = toxicity.chain(score, first, pairs)
        both, total = both(), np.bincount(text, weights=growth, minlength=len(lens))
        weight = {(0, 0): 0.0, (0, 1): pairs[0], (1, 0): pairs[1], (1, 1): pairs[2]}
        for t in range(len(lens)):
            own = score[text == t]
            z, m, b = 0.0, np.zeros(len(own)), np.zeros((3, len(own)))
            for tags in itertools.product([0, 1], repeat=len(own)):
                steps = list(zip(tags, tags[1:]))
                e = np.exp(sum(s for s, y in zip(own, tags) if y) + sum(weight[p] for p in steps))
                z, m = z + e, m + e * np.array(tags)
                for i, p in enumerate(steps, 1):
                    if p != (0, 0):
                        b[2 * p[0] + p[1] - 1, i] += e
            assert np.log(z) == pytest.approx(total[t], abs=1e-9) and np.allclose(m / z, marginal[text == t]) and np.allclose(b / z, both[:, text == t])
            assert toxicity.any_toxic(growth, text, len(lens))[t] == pytest.approx(1 - 1 / z, abs=1e-9)


def test_slopes(monkeypatch):
    """The slope of the loss equals its differences, for texts with labels and for tagged words."""
    seen = {}
    monkeypatch.setattr(toxicity, "smallest", lambda loss, start, steps: seen.setdefault("loss", loss) and start)
    raw, bounds = sketch.text_bytes(pa.array(["good words here", "a bad word", "", "bad bad day", "fine"]))
    n = len(toxicity.tokens(raw, bounds)[0])
    fits = [lambda: toxicity.fit_texts(raw, bounds, np.array([0, 1, 1, 1, 0], bool)), lambda: toxicity.fit_sequences(raw, bounds, np.arange(n) % 3 == 1)]
    rng = np.random.default_rng(2)
    for fit in fits:
        seen.clear()
        fit()
        x = rng.normal(0, 0.5, toxicity.DIMS + 4)
        value, slope = seen["loss"](x)
        places = [*np.argsort(-np.abs(slope - 0.1 * x))[:12], toxicity.DIMS, *range(toxicity.DIMS + 1, toxicity.DIMS + 4)]
        for i in places:
            step = np.zeros_like(x)
            step[i] = 1e-4
            assert (seen["loss"](x + step)[0] - seen["loss"](x - step)[0]) / 2e-4 == pytest.approx(slope[i], rel=1e-4, abs=1e-4)


def test_learns_words_from_labels(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, i % 3 == 0), "en", "s", "p", 1) for i in range(400)]
    rows += [(1000, None, "en", "s", "p", 1), (1001, "", "en", "s", "p", 1), (1002, " \n!?", "en", "s", "p", 1), (None, rows[0][1], None, None, None, None)]
    long = " ".join(prose(rng, 30_000))
    rows += [(1003, long, "en", "s", "p", 1), (1004, long + " grumbit", "en", "s", "p", 1), (1004, long + " grumbit", "en", "s", "p", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(3, None), (None, 1), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.tag(docs, model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all((r.score >= 0.7) == (r.doc_id % 3 == 0) for r in held)
    texts = {r[0]: r[1] for r in rows}
    for r in held:
        assert all(texts[r.doc_id][s.start : s.end].startswith(tuple(BAD)) for s in r.spans)
        assert bool(r.spans) == (r.doc_id % 3 == 0)
    assert by[1000].score == by[1001].score == by[1002].score == 0 and by[1000].spans == []
    assert by[1004].score >= 0.7 > by[1003].score and [(s.start, s.end) for s in by[1004].spans][-1] == (len(long) + 1, len(long) + 8)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[1000].predicted == 0 and got[1004].predicted == 1 and got[1004].n_spans >= 1 and got[None].held_out


def test_edges(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, None, None), (2, "É grumbit Übel", None, None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0
    raw, bounds = sketch.text_bytes(pa.array(["the grumbit says", "grumbit", "she says the word"]))
    tags = np.array([0, 1, 0, 1, 0, 0, 0, 0], dtype=bool)
    model = toxicity.fit_sequences(raw, bounds, tags)
    growth, marginal, _ = toxicity.chain(toxicity.emissions(toxicity.features(toxicity.tokens(raw, bounds)[3], *toxicity.tokens(raw, bounds)[:2]), model.weights), np.array([1, 0, 0, 1, 1, 0, 0, 0], bool), model.pairs)
    assert (marginal[tags] > marginal[~tags].max()).all()
    got = {r.doc_id: r.spans for r in toxicity.tag(docs, model, span_at=float(marginal[tags].min()) * 0.9).collect()}
    assert [(s.start, s.end) for s in got[2]] == [(2, 9)] and got[1] == []
