"""Shingle sets and SetSketch registers of texts, computed on whole Arrow batches with numpy.

A word hash is a polynomial over a table of random 64-bit numbers per byte, a shingle hash a polynomial
over the hashes of its words; both are read off prefix sums, so no text is handled byte by byte in Python.

A register holds the smallest of the exponentially distributed numbers that the elements of a set draw for it, on an
exponential scale and truncated to 16 bits. An element draws its numbers in ascending order for the registers in an order of its
own, and stops once its next number exceeds the largest minimum of its set.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa

U = np.uint64
SHINGLE = 5
BASE = 1.001
OFFSET = 8192.0
CHUNK_BYTES = 1 << 21
PARITIES = 1024
MULTIPLIER, ROLL, GOLDEN = U(0xD6E8FEB86659FD93), U(0x9FB21C651E98DF25), U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(MULTIPLIER), -1, 1 << 64))
    up, down = np.full(n, MULTIPLIER), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ``n + 1`` bounds of its texts; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of whole texts of about ``size`` bytes."""
    start = 0
    while start < len(bounds) - 1:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + size, "right")) - 1)
        yield start, stop
        start = stop


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word in order, A-Z lower-cased."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.nonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))[0]
    ends = np.nonzero(inside & (np.r_[~inside[1:], True] | edge[1:]))[0] + 1
    up, down = powers(1 << max(20, int(len(raw) + 1).bit_length()))
    sums = np.r_[U(0), np.cumsum(byte_table()[low] * up[: len(raw)])]
    return np.searchsorted(bounds, starts, "right") - 1, mix((sums[ends] - sums[starts]) * down[starts])


def shingles(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles, sorted; a shorter text is one shingle, one without words none."""
    text, word = words(raw, bounds)
    if not len(text):
        return text, word
    count = np.bincount(text, minlength=len(bounds) - 1)

    full = np.nonzero(text[SHINGLE - 1 :] == text[: len(text) - SHINGLE + 1])[0] if len(text) >= SHINGLE else np.zeros(0, dtype=np.int64)
    hashes = np.zeros(len(full), dtype=np.uint64)
    for j in range(SHINGLE):
        hashes = hashes * ROLL + word[full + j]
    short = (count > 0) & (count < SHINGLE)
    firsts = np.searchsorted(text, np.nonzero(short)[0])
    few = np.zeros(len(firsts), dtype=np.uint64)
    for j in range(SHINGLE - 1):
        has = count[short] > j
        few[has] = few[has] * ROLL + word[firsts[has] + j]
    few = few + count[short].astype(np.uint64) * GOLDEN
    owner, hashes = np.r_[text[full], np.nonzero(short)[0]], mix(np.r_[hashes, few])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]
    return owner[new], hashes[new]


@lru_cache(maxsize=4)
def units(m: int) -> np.ndarray:
    return np.array([a for a in range(1, m) if gcd(a, m) == 1], dtype=np.int64)


def registers(owner: np.ndarray, hashes: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """``n_texts`` x ``m`` registers (uint16) of the sets; those of an empty set are 0."""
    least = np.full(n_texts * m, np.inf)
    step_by = units(m)
    stride, shift = step_by[(hashes % U(len(step_by))).astype(np.int64)], ((hashes >> U(20)) % U(m)).astype(np.int64)
    x = np.zeros(len(hashes))
    for j in range(m):
        draw = (mix(hashes + U((j + 1) * int(GOLDEN) % (1 << 64))) >> U(11)).astype(np.float64) * 2.0**-53
        x = x - np.log1p(-draw) / (m - j)
        if j:
            live = x < least.reshape(n_texts, m).max(axis=1)[owner] if j < 8 or j % 8 == 0 else slice(None)
            owner, hashes, stride, shift, x = owner[live], hashes[live], stride[live], shift[live], x[live]
            if not len(owner):
                break
        np.minimum.at(least, owner * m + (stride * j + shift) % m, x)
    with np.errstate(divide="ignore"):
        scaled = np.floor(OFFSET + 1 - np.log(least) / np.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, scaled), 0, 65535).astype(np.uint16).reshape(n_texts, m)


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers."""
    keys = np.zeros((len(regs), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
    block = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    for j in range(rows):
        keys = mix(keys * ROLL + block[:, :, j])
    return keys.view(np.int64)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair given the registers that are larger, smaller and equal, and the two set sizes."""
    m = a.shape[1]
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def loglik(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + (m - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = loglik(x) > loglik(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def digests(regs: np.ndarray) -> np.ndarray:
    """The two low bits of each register, 32 registers to a 64-bit number."""
    n, m = regs.shape
    low = np.zeros((n, -(-m // 32) * 32), dtype=np.uint64)
    low[:, :m] = regs & 3
    return np.bitwise_or.reduce(low.reshape(n, -1, 32) << (np.arange(32, dtype=np.uint64) * U(2)), axis=2).view(np.int64)


def parities(owner: np.ndarray, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """``PARITIES`` bits of each set, 64 to a number: a bit tells whether an odd count of the set's shingles falls on it.

    A shingle that only one of two sets holds turns one bit of their difference, so they differ in at least as many shingles as in bits.
    """
    at = (hashes >> U(40)) % U(PARITIES)
    out = np.zeros(n_texts * (PARITIES // 64), dtype=np.uint64)
    np.bitwise_xor.at(out, owner * (PARITIES // 64) + (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out.reshape(n_texts, -1).view(np.int64)
