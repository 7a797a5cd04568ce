"""Byte-level BPE: encode and decode whole texts with a given vocabulary file.

A piece of text (a word with its leading space) is merged over contiguous arrays: the parts between
the standing boundaries and, beside each boundary, the rank of the pair it divides. The smallest rank is found
by a scan, its boundary deleted and the two neighbouring ranks looked up again. All pieces of a batch that
stand at the same number of parts take that step together, as rows of one matrix. Pieces longer
than ``SCAN_BYTES`` keep the same boundaries in a linked list and take the smallest rank
from a heap, so one endless word doesn't cost the square of its length.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import ship

SCAN_BYTES = 96
CACHE_WORDS = 80_000  # of the younger generation of coded words; it becomes the older one, which is dropped then
TOGETHER = 1 << 20  # characters coded at once, whole texts
NEVER = 1 << 60
MARKS, BASIC = frozenset(".,;:!?"), "\u0250"  # letters below are letters in any version of the character tables
Coded = tuple[int, str, bytes]  # number of tokens, their ids joined by commas, the bytes they decode to
UNEVEN = regex.compile(r"\s | $").search
# Pre-tokeniser pattern of the vocabulary (fixed by the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letter that the vocabulary file writes for each byte: printable bytes stand for themselves, the others are counted up from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Vocabulary, merge ranks and special tokens of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = [0] * 256
        for i, raw in self.bytes_of.items():
            if len(raw) == 1:
                self.byte_ids[raw[0]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.wide = max(vocab.values()) + 1
        self.byte_ids = np.array(self.byte_ids, dtype=np.int64)
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.ranks = {vocab[a] * self.wide + vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.merged_ids = np.array(self.merged + [0], dtype=np.int64)
        self._lay_out()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.text_of |= {i: str(i) for i in self.special.values()}
        self.pieces = regex.compile(PATTERN).findall
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.young: dict[str, Coded] = {}
        self.old: dict[str, Coded] = {}

    def _lay_out(self) -> None:
        """Hash table of the pair ranks in two arrays, so that many pairs are looked up at once."""
        keys, ranks = np.fromiter(self.ranks, dtype=np.int64), np.fromiter(self.ranks.values(), dtype=np.int64)
        self.slots = 1 << max(4, int(len(keys) * 4).bit_length())
        self.slot_keys, self.slot_ranks = np.full(self.slots, -1, dtype=np.int64), np.full(self.slots, NEVER, dtype=np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_keys[at[left]] < 0
            first = np.unique(at[left[free]], return_index=True)[1]
            put = left[free][first]
            self.slot_keys[at[put]], self.slot_ranks[at[put]] = keys[put], ranks[put]
            left = left[self.slot_keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (self.slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.slots - 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.wide + right
        at = self._slot(keys)
        there = self.slot_keys[at]
        out = np.where(there == keys, self.slot_ranks[at], NEVER)
        open_ = np.nonzero((there != keys) & (there >= 0))
        while len(open_[0]):
            at[open_] = (at[open_] + 1) & (self.slots - 1)
            there = self.slot_keys[at[open_]]
            hit = there == keys[open_]
            out[tuple(x[hit] for x in open_)] = self.slot_ranks[at[open_][hit]]
            open_ = tuple(x[~hit & (there >= 0)] for x in open_)
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if len(piece) > SCAN_BYTES:
                out[k] = self._heap(self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist())
            else:
                by_length.setdefault(len(piece), []).append(k)
        rows, parts, ranks = np.empty(0, dtype=np.int64), np.empty((0, 0), dtype=np.int64), np.empty((0, 0), dtype=np.int64)
        for n in range(max(by_length, default=0), 0, -1):
            if n in by_length:
                fresh = self.byte_ids[np.frombuffer(b"".join([pieces[k] for k in by_length[n]]), dtype=np.uint8)].reshape(-1, n)
                new = np.array(by_length[n]), fresh, self._ranks(fresh[:, :-1], fresh[:, 1:])
                rows, parts, ranks = (np.concatenate(x) if len(rows) else x[1] for x in zip((rows, parts, ranks), new))
            if not len(rows):
                continue
            low = ranks.min(axis=1, initial=NEVER)
            for k, ids in zip(rows[low == NEVER].tolist(), parts[low == NEVER].tolist()):
                out[k] = ids
            live = low < NEVER
            rows, parts, ranks, low = rows[live], parts[live], ranks[live], low[live]
            if not len(rows):
                continue
            each, i = np.arange(len(rows)), ranks.argmin(axis=1)
            parts[each, i] = self.merged_ids[low]
            parts = parts[np.arange(n) != i[:, None] + 1].reshape(len(rows), n - 1)
            ranks = ranks[np.arange(n - 1) != i[:, None]].reshape(len(rows), n - 2)
            for at, has in ((i, i < n - 2), (i - 1, i > 0)):
                who, where = each[has], at[has]
                ranks[who, where] = self._ranks(parts[who, where], parts[who, where + 1])
        return out

    def _heap(self, parts: list[int]) -> list[int]:
        n, rank, wide = len(parts), self.ranks.get, self.wide
        after, before = list(range(1, n + 1)), list(range(-1, n))  # neighbours of the part at a place; after[i] == 0: merged away
        pair = lambda i: rank(parts[i] * wide + parts[after[i]], NEVER) if after[i] < n else NEVER
        ranks = [pair(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(ranks) if r < NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not after[i] or ranks[i] != r:
                continue
            gone = after[i]
            parts[i], after[i], after[gone] = self.merged[r], after[gone], 0
            if after[i] < n:
                before[after[i]] = i
            for j in (i, before[i]):
                if j >= 0:
                    ranks[j] = pair(j)
                    if ranks[j] < NEVER:
                        heapq.heappush(heap, (ranks[j], j))
        return [part for part, follows in zip(parts, after) if follows]

    def coded(self, pieces: list[str]) -> dict[str, Coded]:
        known = {}
        for piece, ids in zip(pieces, self.merge([x.encode("utf-8", "surrogatepass") for x in pieces])):
            known[piece] = len(ids), ",".join([self.text_of[i] for i in ids]), self.decode_bytes(ids)
        return known

    @staticmethod
    def joined(known: dict[str, Coded], pieces: list[str]) -> Coded:
        if len(pieces) == 1:
            return known[pieces[0]]
        coded = [known[p] for p in pieces]
        return sum([c[0] for c in coded]), ",".join([c[1] for c in coded]), b"".join([c[2] for c in coded])

    def split(self, text: str) -> list[tuple[str, list[str]]]:
        """(part, words that follow its first word after a single space each) by special tokens.

        A single space between two other characters always opens a piece, so a part whose spaces are all of that kind is
        coded from space to space, mostly out of the cache; other parts go through the pattern as a whole.
        """
        out = []
        for part in self.splits.split(text) if self.splits and any(s in text for s in self.special) else (text,):
            if part in self.special or part and (UNEVEN(part) or part[0] == " "):
                out.append((part, []))
            elif part:
                first, *words = part.split(" ")
                out.append((first, words))
        return out

    def pieces_of(self, word: str) -> list[str]:
        """Pieces of a word after a space. A run of letters is one piece, a mark behind it another; only other words need the pattern."""
        stem, mark = (word[:-1], word[-1]) if word[-1:] in MARKS else (word, "")
        if stem.isalpha() and max(stem) < BASIC:
            return [" " + stem, mark] if mark else [" " + stem]
        return self.pieces(" " + word)

    def code(self, texts: list[str]) -> list[list[Coded]]:
        """Each text in coded chunks. Words met in two generations of blocks are not coded again."""
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        split = [self.split(text) for text in texts]
        words = set().union(*[w for parts in split for _, w in parts]) - self.young.keys()
        again = words & self.old.keys()
        self.young |= {w: self.old[w] for w in again}
        word_pieces = {w: self.pieces_of(w) for w in words - again}
        first_pieces = [[None if first in self.special else self.pieces(first) for first, _ in parts] for parts in split]
        wanted = set().union(*word_pieces.values(), *[p for firsts in first_pieces for p in firsts if p])
        known = {p: self.young[p[1:]] for p in wanted if p[0] == " " and p[1:] in self.young}  # a word that came before, now with a mark behind it
        known |= self.coded(list(wanted - known.keys()))
        self.young |= {w: self.joined(known, p) for w, p in word_pieces.items()}
        out = []
        for parts, firsts in zip(split, first_pieces):
            coded: list[Coded] = []
            for (first, rest), pieces in zip(parts, firsts):
                i = self.special.get(first)
                coded.append(self.joined(known, pieces) if i is None else (1, self.text_of[i], self.bytes_of[i]))
                coded += [self.young[w] for w in rest]
            out.append(coded)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.code([text])[0] for i in ids.split(",")]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def loaded(path: str) -> Bpe:
    """The vocabulary, read once in each Python worker."""
    return Bpe(path)


def encode_batches(path: str, with_ids: bool, with_text: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        gc.disable()  # a block makes hundreds of thousands of tuples and no cycles
        for frame in frames:
            texts = [x if isinstance(x, str) else "" for x in frame["text"]]
            start = 0
            while start < len(texts):
                stop, size = start + 1, len(texts[start])
                while stop < len(texts) and size + len(texts[stop]) <= TOGETHER:
                    size += len(texts[stop])
                    stop += 1
                counts, lists, id_hashes, decoded, text_hashes = [], [], [], [], []
                for chunks in bpe.code(texts[start:stop]):
                    joined = ",".join([c[1] for c in chunks])
                    back = b"".join([c[2] for c in chunks]).decode("utf-8", "replace").encode()
                    counts.append(sum([c[0] for c in chunks]))
                    id_hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_hashes.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        lists.append(np.array(joined.split(","), dtype=np.int32) if joined else [])
                    if with_text:
                        decoded.append(back.decode())
                out = {"doc_id": frame["doc_id"].iloc[start:stop].reset_index(drop=True), "n_tokens": pd.Series(counts, dtype="int64"), "ids_sha256": id_hashes, "decoded_sha256": text_hashes}
                yield pd.DataFrame(out | ({"ids": lists} if with_ids else {}) | ({"decoded": decoded} if with_text else {}))
                start = stop
        gc.enable()

    return run


def encode(docs: DataFrame, path: str, ids: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the text decoded from them, for each row.

    No shuffle; rows are coded alone, whole and in batches, so repeated rows repeat their result. A null or empty text has no tokens and
    decodes to the empty text. A special token's string in a text is that token. Null ids are carried; other columns are not read.
    ``path`` names the vocabulary file, which must be at hand on every executor.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>" * ids + ", decoded string" * decoded
    return docs.select("doc_id", "text").mapInPandas(encode_batches(path, ids, decoded), f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
