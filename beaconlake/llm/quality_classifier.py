"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent space.

A text is a vector of hashed counts: the shapes of four bytes in a row (letter case, digits, blanks,
each other sign itself), words, and how often a word repeats one of the four before it. The latent space is the truncated singular
value decomposition of the weighted counts of a bounded sample of labelled rows. Its vectors go to every executor, where each block of
documents takes exact cosines against all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import learnable, ship

SHAPES, WORDS, LAGS = 1536, 508, 4
DIMS = SHAPES + WORDS + LAGS
BLOCK = 512


@dataclass(frozen=True)
class Model:
    """Feature weights, projection to the latent space, labelled vectors (unit rows) with labels, the share of label 1."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = 25


def shape_classes() -> np.ndarray:
    classes = np.arange(256)
    classes[ord("a") : ord("z") + 1] = ord("a")
    classes[ord("A") : ord("Z") + 1] = ord("A")
    classes[ord("0") : ord("9") + 1] = ord("0")
    classes[128:] = ord("a")
    classes[[9, 11, 12, 13]] = 32
    return classes.astype(np.uint64)


def counts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``DIMS`` counts for each text; no feature crosses from a text into the next."""
    n = len(bounds) - 1
    out = np.zeros((n, DIMS), dtype=np.float32)
    if not len(raw):
        return out
    if len(raw) >= 4:
        shape = shape_classes()[raw]
        gram = sketch.mix(((shape[:-3] * sketch.U(256) + shape[1:-2]) * sketch.U(256) + shape[2:-1]) * sketch.U(256) + shape[3:]) % sketch.U(SHAPES)
        text = np.repeat(np.arange(n), np.diff(bounds))
        inside = text[:-3] == text[3:]
        out[:, :SHAPES] = np.bincount(text[:-3][inside] * SHAPES + gram[inside].astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
    text, word = sketch.words(raw, bounds)
    out[:, SHAPES : SHAPES + WORDS] = np.bincount(text * WORDS + (word % sketch.U(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    for lag in range(1, LAGS + 1):
        same = (text[lag:] == text[:-lag]) & (word[lag:] == word[:-lag])
        out[:, SHAPES + WORDS + lag - 1] = np.bincount(text[lag:][same], minlength=n) * 8
    return out


def weighted(matrix: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of the counts, weighted, as unit rows (an empty text stays 0)."""
    matrix = np.sqrt(matrix) * weights
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = sketch.text_bytes(batch.column("text"))
        for start, stop in sketch.chunks(bounds):
            at = bounds[start : stop + 1]
            rows = counts(raw[at[0] : at[-1]], at - at[0])
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, stop - start) for c in ("doc_id", "quality")] + [pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in rows], type=pa.binary())], names=["doc_id", "quality", "counts"])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2000, dims: int = 48, neighbours: int = 25) -> Model:
    """Learn from at most ``per_label`` rows of each label, those with the smallest hash of their id among the rows that may be learnt from.

    Rows with a null label, id or unlabelled document take no part; a doc_id with labels of both kinds is read twice. Without labelled rows every
    score is 0.5.
    """
    ship(docs.sparkSession)
    usable = labels.filter(learnable() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    picks = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(picks[0].union(picks[1])), "doc_id")  # at most 2 * per_label short rows
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(count_batches, f"doc_id {id_type}, quality int, counts binary").orderBy("doc_id", "quality", "counts").limit(4 * per_label).collect()
    if not rows:
        return Model(np.ones(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5, neighbours)
    matrix = np.stack([np.frombuffer(r["counts"], dtype=np.uint16) for r in rows]).astype(np.float32)
    y = np.array([r["quality"] for r in rows], dtype=np.float32)
    weights = (np.log((1 + len(rows)) / (1 + (matrix > 0).sum(axis=0))) + 1).astype(np.float32)
    matrix = weighted(matrix, weights)
    values, vectors = np.linalg.eigh(matrix.T @ matrix)
    projection = np.ascontiguousarray(vectors[:, np.argsort(values)[::-1][:dims]]).astype(np.float32)
    latent = matrix @ projection
    return Model(weights, projection, latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9), y, float(y.mean()), neighbours)


def votes(latent: np.ndarray, model: Model) -> np.ndarray:
    """Score of each latent row: mean label of its nearest labelled vectors, weighted by similarity."""
    if not len(model.labels):
        return np.full(len(latent), model.prior)
    latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    cosine = latent @ model.vectors.T
    k = min(model.neighbours, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 8
    return (np.sum(weight * model.labels[near], axis=1) + 1e-6 * model.prior) / (weight.sum(axis=1) + 1e-6)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Whole texts are read, in batches, without a shuffle. A null or empty text scores the share of label 1 among the labelled vectors. Rows are
    judged alone; null ids are carried and count as held out; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * per_label vectors and the projection, about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, bounds = sketch.text_bytes(batch.column("text"))
            scores = [np.zeros(0)]
            for start, stop in sketch.chunks(bounds):
                at = bounds[start : stop + 1]
                rows = counts(raw[at[0] : at[-1]], at - at[0])
                scores += [votes(weighted(rows[i : i + BLOCK], m.weights) @ m.projection, m) for i in range(0, len(rows), BLOCK)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.clip(np.concatenate(scores), 0, 1))], names=["doc_id", "held_out", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", (~learnable()).alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
