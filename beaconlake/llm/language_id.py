"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on a bounded sample. It labels every byte position of
every text, and the mean of a document's position probabilities is its prediction. Texts are read in
stretches of ``SPAN`` bytes, thousands side by side; each direction starts anew at the ends of a stretch.
Arrays run features x stretches, so each step of the recurrence is a few matrix operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sketch
from .common import learnable, ship, text_of

SPAN = 256
SIDE_BY_SIDE = 4096
HIDDEN = 8
TRAIN_SPAN = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Per direction: input table (3H x 257, column 256 is padding), recurrent matrix (3H x H); output matrix (L x 2H) and bias; the languages."""

    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    langs: list[str]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gates(x: np.ndarray, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Update gate, reset gate and candidate from the inputs' part ``x`` and the state's part ``a``."""
    n = len(h)
    zr = sigmoid(x[: 2 * n] + a[: 2 * n])
    return zr[:n], zr[n:], np.tanh(x[2 * n :] + zr[n:] * a[2 * n :])


def direction(table: np.ndarray, recurrent: np.ndarray, codes: np.ndarray, backwards: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(position, state) along T x B byte codes; padding (code 256) leaves the state at 0 or as it is."""
    h = np.zeros((recurrent.shape[1], codes.shape[1]), dtype=np.float32)
    padded = (codes == 256).any(axis=1)
    for t in range(len(codes) - 1, -1, -1) if backwards else range(len(codes)):
        z, _, c = gates(np.take(table, codes[t], axis=1), recurrent @ h, h)
        h = c + z * (h - c)
        if padded[t]:
            h = h * (codes[t] != 256)
        yield t, h


def pooled(model: Model, codes: np.ndarray) -> np.ndarray:
    """Sums over positions of the label probabilities of each stretch (L x B)."""
    h = HIDDEN
    logits = np.empty((len(codes), len(model.langs), codes.shape[1]), dtype=np.float32)
    for t, state in direction(model.inputs[0], model.recurrent[0], codes, False):
        logits[t] = model.out[:, :h] @ state
    sums = np.zeros(logits.shape[1:], dtype=np.float32)
    for t, state in direction(model.inputs[1], model.recurrent[1], codes, True):
        x = logits[t] + model.out[:, h:] @ state + model.bias
        x = np.exp(x - x.max(axis=0))
        sums += x / x.sum(axis=0) * (codes[t] != 256)
    return sums


def stretches(raw: np.ndarray, bounds: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and start of each stretch of ``span`` bytes or less."""
    n = -(-np.diff(bounds) // span)
    text = np.repeat(np.arange(len(n)), n)
    return text, bounds[text] + (np.arange(len(text)) - (np.cumsum(n) - n)[text]) * span


def probabilities(model: Model, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean position probabilities of each text (texts x L), 0 for an empty one."""
    total = np.zeros((len(bounds) - 1, len(model.langs)))
    text, start = stretches(raw, bounds, SPAN)
    size = np.minimum(bounds[text + 1] - start, SPAN) if len(text) else start
    order = np.argsort(-size, kind="stable")  # stretches of about one length side by side
    for i in range(0, len(order), SIDE_BY_SIDE):
        some = order[i : i + SIDE_BY_SIDE]
        at = start[some] + np.arange(size[some].max())[:, None]
        codes = np.where(at < start[some] + size[some], raw[np.minimum(at, len(raw) - 1)].astype(np.int64), 256)
        np.add.at(total, text[some], pooled(model, codes).T)
    return total / np.maximum(np.diff(bounds), 1)[:, None]


def train(codes: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 240, batch: int = 128, rate: float = 0.02, seed: int = 3) -> Model:
    """Adam on the mean cross entropy of all positions; codes N x T (256: padding), labels N."""
    rng = np.random.default_rng(seed)
    n, k = HIDDEN, len(langs)
    p = [
        (rng.normal(0, 0.3, (3 * n, 257))).astype(np.float32), (rng.normal(0, 0.3, (3 * n, n))).astype(np.float32),
        (rng.normal(0, 0.3, (3 * n, 257))).astype(np.float32), (rng.normal(0, 0.3, (3 * n, n))).astype(np.float32),
        (rng.normal(0, 0.3, (k, 2 * n))).astype(np.float32), np.zeros((k, 1), dtype=np.float32),
    ]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(codes), batch)
        x, y = codes[pick].T, labels[pick]
        seen = (x != 256).astype(np.float32)
        count = max(1.0, float(seen.sum()))
        trace = []
        for d in (0, 1):
            h, kept = np.zeros((n, batch), dtype=np.float32), {}
            for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
                a = p[2 * d + 1] @ h
                z, r, c = gates(np.take(p[2 * d], x[t], axis=1), a, h)
                new = (c + z * (h - c)) * seen[t]
                kept[t] = (h, z, r, c, a[2 * n :], new)
                h = new
            trace.append(kept)
        grads = [np.zeros_like(q) for q in p]
        down = [{}, {}]
        for t in range(len(x)):
            both = np.concatenate([trace[0][t][5], trace[1][t][5]])
            o = p[4] @ both + p[5]
            o = np.exp(o - o.max(axis=0))
            o /= o.sum(axis=0)
            o[y, np.arange(batch)] -= 1
            o *= seen[t] / count
            grads[4] += o @ both.T
            grads[5] += o.sum(axis=1, keepdims=True)
            back = p[4].T @ o
            down[0][t], down[1][t] = back[:n], back[n:]
        for d in (0, 1):
            dh = np.zeros((n, batch), dtype=np.float32)
            for t in range(len(x) - 1, -1, -1) if d == 0 else range(len(x)):
                h, z, r, c, an, _ = trace[d][t]
                dh = (dh + down[d][t]) * seen[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * an * r * (1 - r)
                g = np.concatenate([dz, dr, dc])
                np.add.at(grads[2 * d].T, x[t], g.T)
                ga = np.concatenate([dz, dr, dc * r])
                grads[2 * d + 1] += ga @ h.T
                dh = dh * z + p[2 * d + 1].T @ ga
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        for i, g in enumerate(grads):
            g *= min(1.0, 1.0 / max(norm, 1e-9))
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            p[i] -= (rate * min(1.0, 2 - 2 * step / steps)) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
    return Model([p[0], p[2]], [p[1], p[3]], p[4], p[5], langs)


def fit(docs: DataFrame, per_lang: int = 300, windows: int = 3) -> Model:
    """Train on at most ``per_lang`` documents of each language, those with the smallest hash of their id among the rows that may be learnt from.

    Of each, ``windows`` stretches of ``TRAIN_SPAN`` bytes are read. Null languages or texts take no part.
    """
    rows = docs.select("doc_id", "lang", "text").filter(learnable() & F.col("lang").isNotNull() & (F.length(text_of()) > 0))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = rows.select("doc_id", "lang").withColumn("place", place).filter(F.col("place") <= per_lang).select("doc_id", "lang").distinct()
    # Of each text only the stretches go to the driver: a few hundred characters a row, per_lang rows a language.
    part = lambda i: F.substring("text", (F.floor(F.length("text") * (i / windows)) + 1).cast("int"), F.lit(TRAIN_SPAN))
    got = rows.join(F.broadcast(picked), ["doc_id", "lang"]).select("doc_id", "lang", *(part(i).alias(f"p{i}") for i in range(windows))).orderBy("doc_id", "lang", "p0").collect()
    langs = sorted({r["lang"] for r in got})
    pieces = [(r[f"p{i}"].encode()[:TRAIN_SPAN], langs.index(r["lang"])) for r in got for i in range(windows) if r[f"p{i}"]]
    codes = np.full((len(pieces), TRAIN_SPAN), 256, dtype=np.int64)
    for i, (piece, _) in enumerate(pieces):
        codes[i, : len(piece)] = np.frombuffer(piece, dtype=np.uint8)
    if not pieces:
        return Model([np.zeros((3 * HIDDEN, 257), np.float32)] * 2, [np.zeros((3 * HIDDEN, HIDDEN), np.float32)] * 2, np.zeros((1, 2 * HIDDEN), np.float32), np.zeros((1, 1), np.float32), [UNKNOWN])
    return train(codes, np.array([y for _, y in pieces]), langs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    Whole texts are read, in batches, without a shuffle; ``score`` is the mean position probability of the language predicted. A null text or one without a
    letter is ``und`` with score 0, and so is every text if no language was learnt. Rows are judged alone; null ids are carried and count as
    held out; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.langs, dtype=object)
        for batch in batches:
            raw, bounds = sketch.text_bytes(batch.column("text"))
            parts = [np.zeros((0, len(m.langs)))]
            for start, stop in sketch.chunks(bounds):
                at = bounds[start : stop + 1]
                parts.append(probabilities(m, raw[at[0] : at[-1]], at - at[0]))
            share = np.concatenate(parts)
            known = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool) & (m.langs != [UNKNOWN])
            best = share.argmax(axis=1)
            lang = np.where(known, names[best], UNKNOWN)
            score = np.where(known, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang.tolist(), type=pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", (~learnable()).alias("held_out"), lettered.alias("lettered"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
