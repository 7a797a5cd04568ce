"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

The chain has two tags, clean and toxic. A word scores by weights of its features: the word itself and its first three to six bytes, hashed; pairs
of neighbouring tags score by three more weights. Tags of training words follow from the document labels: every word of a
clean document is clean; in a toxic one at least one word is toxic, which ones is found by forward-backward under that condition, the words that
clean documents explain staying clean. (``fit_sequences`` learns from words that are tagged one by one.) Forward-backward marginals of single
words give the offending spans, and those of suspect words together the score of a text.

Sums along the chain run over all words of a block of texts at once: cut into stretches of equal length, a stretch is a 2 x 2 matrix that carries
the state over it; the states at the stretches' ends follow from these matrices, and all stretches are then filled in side by side. Texts are apart
because the first word of each forgets what came before. So no text is cut, however long, and no state is started anew inside one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import ship

U = np.uint64
BITS = 18
DIMS = 1 << BITS
PREFIXES = (3, 4, 5, 6)
START = -7.0  # first weight of the toxic tag, about one word in a thousand
SUSPECT = 0.2  # chance from which a word counts for its text
COMMON = 20.0  # decay of the bias and the neighbour weights, which all words share, towards their first values


@dataclass(frozen=True)
class Model:
    """Feature weights of the toxic tag (the last one is its bias); weights of clean-toxic, toxic-clean and toxic-toxic neighbours."""

    weights: np.ndarray
    pairs: np.ndarray


def tokens(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words, runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z lower-cased bytes."""
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, low
    inside = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.nonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))[0]
    ends = np.nonzero(inside & (np.r_[~inside[1:], True] | edge[1:]))[0] + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1, low


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature numbers of each word (words x 5): the whole word and its first bytes; a word without so many repeats its own number."""
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), dtype=np.int64)
    up, down = sketch.powers(1 << max(20, int(len(low) + 1).bit_length()))
    sums = np.r_[U(0), np.cumsum(sketch.byte_table()[low] * up[: len(low)])]
    hashed = lambda stop, kind: sketch.mix((sums[stop] - sums[starts]) * down[starts] + U(kind * int(sketch.GOLDEN) % (1 << 64))) >> U(64 - BITS)
    word = hashed(ends, 1)
    return np.stack([word, *(np.where(ends - starts > n, hashed(np.minimum(starts + n, ends), n), word) for n in PREFIXES)], axis=1).astype(np.int64)


def emissions(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of the toxic tag of each word; a number that a row repeats counts once."""
    total = weights[rows[:, 0]] + weights[-1]
    for j in range(1, rows.shape[1]):
        total = total + np.where(rows[:, j] != rows[:, 0], weights[rows[:, j]], 0)
    return total


def chain(score: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[], np.ndarray]]:
    """Of each word: log of the factor by which it grows the sum over all paths, chance of the toxic tag, and, if called for, of the three pairs
    with the word before.

    ``score`` is that of the toxic tag (the clean one has 0), ``first`` marks the first word of each text.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros(0), lambda: np.zeros((3, 0))
    span = max(1, int(np.sqrt(n)))
    width = -(-n // span)
    pad = span * width - n
    e = np.exp(np.clip(np.r_[score, np.zeros(pad)], -50, 50)).reshape(width, span).T
    new = np.r_[first, np.ones(pad, dtype=bool)].reshape(width, span).T
    ct, tc, tt = np.exp(np.clip(pairs, -50, 50))
    # What a word's tag (clean, toxic) takes from the tags before it; the first word of a text takes the same from both.
    m00, m10 = np.ones_like(e), np.where(new, 1.0, tc)
    m01, m11 = np.where(new, 1.0, ct) * e, np.where(new, 1.0, tt) * e

    a, b, c, d = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)  # each stretch as one matrix, of any scale
    for t in range(span):
        a, b = a * m00[t] + b * m10[t], a * m01[t] + b * m11[t]
        c, d = c * m00[t] + d * m10[t], c * m01[t] + d * m11[t]
        size = a + b + c + d
        a, b, c, d = a / size, b / size, c / size, d / size
    before, after = np.zeros((2, width)), np.ones((2, width))
    x, y = 1.0, 0.0
    for k in range(width):
        before[:, k] = x, y
        x, y = x * a[k] + y * c[k], x * b[k] + y * d[k]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in range(width - 1, -1, -1):
        after[:, k] = x, y
        x, y = a[k] * x + b[k] * y, c[k] * x + d[k] * y
        x, y = x / (x + y), y / (x + y)

    x, y = before
    clean, toxic, grown = np.empty_like(e), np.empty_like(e), np.empty_like(e)
    for t in range(span):
        p, q = x * m00[t] + y * m10[t], x * m01[t] + y * m11[t]
        grown[t] = np.where(new[t], (p + q) / (x + y), p + q)
        x, y = p / (p + q), q / (p + q)
        clean[t], toxic[t] = x, y
    x, y = after
    later_clean, later_toxic = np.empty_like(e), np.empty_like(e)
    for t in range(span - 1, -1, -1):
        later_clean[t], later_toxic[t] = x, y
        p, q = m00[t] * x + m01[t] * y, m10[t] * x + m11[t] * y
        x, y = p / (p + q), q / (p + q)
    flat = lambda z: z.T.ravel()[:n]
    u, v = clean * later_clean, toxic * later_toxic
    marginal = flat(v / (u + v))

    def both() -> np.ndarray:
        x0, y0 = np.empty_like(e), np.empty_like(e)  # state before each word
        x0[0], y0[0] = before
        x0[1:], y0[1:] = clean[:-1], toxic[:-1]
        joint = [x0 * m01 * later_toxic, y0 * m10 * later_clean, y0 * m11 * later_toxic]
        total = np.where(new, np.inf, x0 * m00 * later_clean + joint[0] + joint[1] + joint[2])
        return np.stack([flat(z / total) for z in joint])

    return np.log(flat(grown)), marginal, both


def any_toxic(log_growth: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Chance that a text has a toxic word: the path without one has the score 0, all paths that of the summed growth."""
    total = np.bincount(text, weights=log_growth, minlength=n_texts)
    return -np.expm1(-np.maximum(total, 0.0))


def text_scores(marginal: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Score of each text: one minus the chance that none of its suspect words is toxic; without suspects the highest chance of a word.

    A suspect word has a chance of SUSPECT or more. The others are left out, as a long text would add up to a high score from its many words alone.
    """
    suspect = marginal >= SUSPECT
    none = np.bincount(text[suspect], weights=np.log1p(-np.minimum(marginal[suspect], 1 - 1e-12)), minlength=n_texts)
    most = np.zeros(n_texts)
    np.maximum.at(most, text, marginal)
    return np.maximum(most, -np.expm1(none))


def dot(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.einsum("i,i->", a, b))


def smallest(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise by limited-memory quasi-Newton steps with a halving line search."""
    x, (f, g) = start, loss(start)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for s, y, r in reversed(history):
            used.append(r * dot(s, q))
            q -= used[-1] * y
        q *= dot(history[-1][0], history[-1][1]) / dot(history[-1][1], history[-1][1]) if history else 1.0 / max(1.0, float(np.abs(g).max()))
        for (s, y, r), al in zip(history, reversed(used)):
            q += (al - r * dot(y, q)) * s
        slope, step = -dot(g, q), 1.0
        if slope > -1e-9:
            break
        while True:
            new = x - step * q
            f2, g2 = loss(new)
            if f2 <= f + 1e-4 * step * slope or step < 1e-4:
                break
            step /= 2
        if f2 > f:
            break
        s, y = new - x, g2 - g
        done = f - f2 < 1e-6 * abs(f)
        x, f, g = new, f2, g2
        if dot(s, y) > 1e-10:
            history = [*history[1 - memory :], (s, y, 1.0 / dot(s, y))]
        if done:
            break
    return x


def learn(raw: np.ndarray, bounds: np.ndarray, decay: float, steps: int, pull: Callable[..., tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """Fit weights on the texts; ``pull`` turns what the chain gives into a loss and its slopes, by each word's score and by the neighbour weights.

    It is called with the words' texts, whether a word is its text's first, the words' scores, what ``chain`` returns, and the neighbour weights.
    """
    starts, ends, text, low = tokens(raw, bounds)
    rows, word = np.unique(features(low, starts, ends), axis=0, return_inverse=True)
    word = word.ravel()
    first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, dtype=bool)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        weights, pairs = theta[: DIMS + 1], theta[DIMS + 1 :]
        score = emissions(rows, weights)[word]
        value, by_word, by_pair = pull(text, first, score, *chain(score, first, pairs), pairs)
        away = theta - start
        grad = held * away
        grad[DIMS] += by_word.sum()
        grad[DIMS + 1 :] += by_pair
        per = np.bincount(word, weights=by_word, minlength=len(rows))
        for j in range(rows.shape[1]):
            grad[:DIMS] += np.bincount(rows[:, j], weights=per if j == 0 else np.where(rows[:, j] != rows[:, 0], per, 0), minlength=DIMS)
        return value + 0.5 * dot(held, away**2), grad

    start, held = np.zeros(DIMS + 4), np.full(DIMS + 4, decay)
    start[DIMS], held[DIMS:] = START, COMMON
    theta = smallest(loss, start, steps)
    return Model(theta[: DIMS + 1], theta[DIMS + 1 :])


def fit_texts(raw: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, decay: float = 0.1, steps: int = 60) -> Model:
    """Learn from texts of which only the label is known: of a toxic text at least one word is toxic, of others none."""

    def pull(text, first, score, growth, marginal, both, pairs):
        unclear = toxic & (np.bincount(text, minlength=len(toxic)) > 0)
        total = np.maximum(np.bincount(text, weights=growth, minlength=len(toxic)), 1e-12)
        some = -np.expm1(-total)
        # By how much its words are likelier to be toxic than under the text's label (in a clean text: by their chance itself).
        excess = np.where(unclear, -np.exp(-total) / some, 1.0)[text]
        return float(np.where(unclear, -np.log(some), total).sum()), excess * marginal, both() @ excess

    return learn(raw, bounds, decay, steps, pull)


def fit_sequences(raw: np.ndarray, bounds: np.ndarray, tags: np.ndarray, decay: float = 0.1, steps: int = 60) -> Model:
    """Learn from words with known tags, one boolean per word in the order of ``tokens``."""

    def pull(text, first, score, growth, marginal, both, pairs):
        last = np.r_[False, tags[:-1]] & ~first
        known = np.stack([tags & ~first & ~last, ~tags & last, tags & last]).sum(axis=1)
        return float(growth.sum() - score[tags].sum() - known @ pairs), marginal - tags, both().sum(axis=1) - known

    return learn(raw, bounds, decay, steps, pull)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 600, max_bytes: int = 1 << 13, **how) -> Model:
    """Learn from at most ``per_label`` toxic and twice as many clean documents of at most ``max_bytes``, those with the smallest hash of their id
    among the rows that may be learnt from. Equal texts count once.

    Rows with a null label or id or an unlabelled document take no part; a doc_id with labels of both kinds counts as toxic. Without labelled
    rows every word has the chance of about one in a thousand.
    """
    usable = labels.filter(taught(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.filter(F.octet_length("text") <= max_bytes).select("doc_id").join(usable, "doc_id").dropDuplicates(["doc_id"])
    pick = lambda label, n: usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = F.broadcast(pick(1, per_label).union(pick(0, 2 * per_label)))  # at most 3 * per_label ids
    rows = docs.filter(F.octet_length("text") <= max_bytes).select("doc_id", "text").join(picked, "doc_id").select("text", "toxic").limit(4 * per_label).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r["text"], r["toxic"])):
        seen[r["text"]] = r["toxic"] == 1
    raw, bounds = sketch.text_bytes(pa.array(list(seen), pa.string()))
    return fit_texts(raw, bounds, np.array(list(seen.values()), dtype=bool), **how)


def taught(column: Column) -> Column:
    """Rows whose labels may be learnt from: the CRC-32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def tag(docs: DataFrame, model: Model, span_at: float = 0.5, spans: bool = True) -> DataFrame:
    """doc_id, held_out, score and (``spans``) the offending stretches of each row: start and end in characters, and the highest chance of a word in it.

    Whole texts are read, in batches, without a shuffle. A null or empty text, or one without a word, has the score 0 and no span. Neighbouring words
    whose chance reaches ``span_at`` are one span. Rows are judged alone; null ids are carried and count as held out; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.pairs))  # DIMS + 4 numbers, about 1 MB
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, bounds = sketch.text_bytes(batch.column("text"))
            for start, stop in sketch.chunks(bounds):
                at = bounds[start : stop + 1] - bounds[start]
                own = raw[bounds[start] : bounds[stop]]
                starts, ends, text, low = tokens(own, at)
                first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, dtype=bool)
                _, marginal, _ = chain(emissions(features(low, starts, ends), m.weights).astype(np.float64), first, m.pairs)
                columns = [*(batch.column(c).slice(start, stop - start) for c in ("doc_id", "held_out")), pa.array(text_scores(marginal, text, stop - start))]
                if spans:
                    hit = np.nonzero(marginal >= span_at)[0]
                    opens = np.r_[True, (hit[1:] != hit[:-1] + 1) | first[hit[1:]]] if len(hit) else np.zeros(0, dtype=bool)
                    head, tail = hit[opens], hit[np.r_[opens[1:], True]] if len(hit) else hit
                    chars = np.r_[0, np.cumsum((own & 0xC0) != 0x80)]
                    place = lambda byte, of: chars[byte] - chars[at[of]]
                    top = np.maximum.reduceat(marginal[hit], np.nonzero(opens)[0]) if len(hit) else np.zeros(0)
                    found = pa.StructArray.from_arrays([pa.array(place(starts[head], text[head])), pa.array(place(ends[tail], text[tail])), pa.array(top)], fields=list(kind.value_type))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[head], np.arange(stop - start + 1)).astype(np.int32)), found))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "spans"][: len(columns)])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, score double" + ", spans array<struct<start:bigint,end:bigint,probability:double>>" * spans
    return docs.select("doc_id", (~taught(F.col("doc_id"))).alias("held_out"), "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans and toxic_chars of each row."""
    out = tag(docs, model)
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("spans").cast("bigint").alias("n_spans"), length.alias("toxic_chars"))
