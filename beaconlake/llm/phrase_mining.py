"""Phrase collocations: frequent word n-grams of each language, kept by Misra-Gries summaries and then counted exactly.

Pass 1: each block of texts counts its n-grams locally and deals the counts to hash partitions. A partition folds them into a
Misra-Gries summary with more counters than its mass divided by the threshold, so the counts it takes away stay below
the threshold and no n-gram that reaches the threshold is lost. Summaries are folded batch by batch: counts are added, and where there are more
than the capacity, the largest one that has no counter is taken off all of them. What may reach the threshold marks its bits in the
partition's slice of a filter of bounded size. Pass 2 reads the texts again and counts exactly, by their words, the n-grams that the filter lets through.
An n-gram that only shares bits with a survivor is counted too and falls to the threshold. Nothing depends on the filter but the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sketch
from .common import ship, stored, text_of

U = np.uint64
LONGEST = 3
PRINT_BITS = 32  # an n-gram is known to its partition by so many bits; those that share them are counted as one in pass 1, which loses none
CHUNK_BYTES = 1 << 17  # texts tokenised together
UNIT_BYTES = 1 << 21  # texts counted together
PARTITION_MASS = 1 << 22  # n-grams of a hash partition, about
FILTER_BYTES = 1 << 27  # bound of the filter that goes to every executor
SLICE_BITS = 1 << 19
SALTS = 8


def lang_of() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def tokenised(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes; starts, ends, text numbers and hashes of the words; whether a word and the next one are of one piece."""
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return raw, none, none, none, none.astype(U), np.zeros(0, dtype=bool)
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[[9, 32]] = 1
    kinds[[*b".,;:!?", 10, 11, 12, 13]] = 2
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    kind = kinds[low]
    inside = kind == 0
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.nonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))[0]
    ends = np.nonzero(inside & (np.r_[~inside[1:], True] | edge[1:]))[0] + 1
    up, down = sketch.powers(1 << max(20, int(len(raw) + 1).bit_length()))
    sums = np.r_[U(0), np.cumsum(sketch.byte_table()[low] * up[: len(raw)])]
    text = np.searchsorted(bounds, starts, "right") - 1
    marks = np.cumsum(kind == 2, dtype=np.int32)
    runs_on = np.zeros(len(starts), dtype=bool)
    runs_on[:-1] = (text[1:] == text[:-1]) & (marks[starts[1:]] == marks[ends[:-1] - 1])
    return low, starts, ends, text, sketch.mix((sums[ends] - sums[starts]) * down[starts]), runs_on


def grams(word: np.ndarray, runs_on: np.ndarray, lang: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three words: places of the first word, and a 64-bit hash of language and words."""
    out, at, rolled = [], np.arange(len(word)), word + lang
    for k in range(1, LONGEST + 1):
        if k > 1:
            on = runs_on[at + k - 2]
            at, rolled = at[on], rolled[on]
            rolled = rolled * sketch.ROLL + word[at + k - 1]
        out.append((at, sketch.mix(rolled + U(k * int(sketch.GOLDEN) % (1 << 64)))))
    return out


def tokenised_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Chunks of whole texts: (languages, bytes, starts, ends, text numbers, n-grams by length)."""
    for batch in batches:
        raw, bounds = sketch.text_bytes(batch.column("text"))
        langs, hashes = batch.column("lang"), batch.column("lang_hash").to_numpy(zero_copy_only=False).view(U)
        for start, stop in sketch.chunks(bounds, CHUNK_BYTES):
            at = bounds[start : stop + 1]
            low, starts, ends, text, word, runs_on = tokenised(raw[at[0] : at[-1]], at - at[0])
            yield langs.slice(start, stop - start), low, starts.astype(np.int32), ends.astype(np.int32), text.astype(np.int32), grams(word, runs_on, hashes[start:stop][text])


def units(chunks: Iterator[tuple[int, object]]) -> Iterator[list]:
    """Lists of what was made of chunks of about ``UNIT_BYTES`` together; each comes with the chunk's bytes."""
    held, size = [], 0
    for n, made in chunks:
        held.append(made)
        size += n
        if size >= UNIT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def deal(partitions: int, threshold: int):
    """Rows (part, mass, prints, counts): the n-grams of a unit that belong to a hash partition, each once, with counts up to the threshold.

    A unit that holds an n-gram that often proves it frequent alone, so the summary needs no more; the mass is that of the counts dealt.
    """
    count_type = np.uint8 if threshold < 1 << 8 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units((len(low), np.concatenate([h for _, h in by_length])) for _, low, _, _, _, by_length in tokenised_chunks(batches)):
            hashes = np.concatenate(unit)
            del unit
            part = ((hashes >> U(PRINT_BITS)) * U(partitions)) >> U(64 - PRINT_BITS)
            keys, counts = np.unique((part << U(PRINT_BITS)) | (hashes & U((1 << PRINT_BITS) - 1)), return_counts=True)
            counts = np.minimum(counts, threshold)
            cuts = np.searchsorted(keys, np.arange(partitions + 1, dtype=U) << U(PRINT_BITS))
            some = np.nonzero(np.diff(cuts))[0]
            if not len(some):
                continue
            prints = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : PRINT_BITS // 8])
            at = np.r_[cuts[some], cuts[-1]].astype(np.int32)
            blob = lambda data, width: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at * np.int32(width)), pa.py_buffer(data.tobytes())])
            mass = np.add.reduceat(counts, cuts[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(mass.astype(np.int64)), blob(prints, PRINT_BITS // 8), blob(counts.astype(count_type), count_type().itemsize)], names=["part", "mass", "prints", "counts"]
            )

    return run


class Summary:
    """Misra-Gries counters of one hash partition; ``taken`` bounds what any count has lost."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 16):
            self.fold()

    def fold(self) -> None:
        """Merge what waits with the counters, then take the largest count without a counter off all."""
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0] if len(keys) else np.zeros(0, dtype=np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.taken += cut
            keys, counts = keys[counts > cut], counts[counts > cut] - cut
        self.keys, self.counts = keys, counts

    def frequent(self, threshold: int) -> np.ndarray:
        """Keys whose count may reach the threshold; every key that reaches it is among them."""
        self.fold()
        return self.keys[self.counts + self.taken >= threshold]


def marks(prints: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (prints % U(slice_bits)).astype(np.int64), (sketch.mix(prints) % U(slice_bits)).astype(np.int64)


def summarise(threshold: int, slice_bits: int):
    """Rows sorted by partition, its mass first -> (part, bits): the partition's slice of the filter."""
    count_type = np.uint8 if threshold < 1 << 8 else np.uint32
    width = PRINT_BITS // 8

    def close(part: int, summary: Summary) -> pa.RecordBatch:
        bits = np.zeros(slice_bits, dtype=np.uint8)
        for place in marks(summary.frequent(threshold), slice_bits):
            bits[place] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None
        for batch in batches:
            parts, masses = batch.column("part").to_pylist(), batch.column("mass").to_pylist()
            for i, now in enumerate(parts):
                prints = batch.column("prints")[i].as_py()
                if prints is None:
                    if summary is not None:
                        yield close(part, summary)
                    part, summary = now, Summary(masses[i] // threshold + 1)
                    continue
                wide = np.zeros((len(prints) // width, 8), dtype=np.uint8)
                wide[:, :width] = np.frombuffer(prints, dtype=np.uint8).reshape(-1, width)
                summary.add(wide.view("<u8").ravel().astype(U), np.frombuffer(batch.column("counts")[i].as_py(), dtype=count_type).astype(np.int64))
        if summary is not None:
            yield close(part, summary)

    return run


def count_kept(shared, partitions: int, slice_bits: int):
    """Rows (lang, k, phrase, n): exact counts, within a unit, of the n-grams that pass the filter; k = 0 counts the words of a language."""

    def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        base = (((hashes >> U(PRINT_BITS)) * U(partitions)) >> U(64 - PRINT_BITS)).astype(np.int64) * slice_bits
        good = np.ones(len(hashes), dtype=bool)
        for place in marks(hashes & U((1 << PRINT_BITS) - 1), slice_bits):
            place = place + base
            good &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)

        def kept() -> Iterator[tuple[int, tuple]]:
            for langs, low, starts, ends, text, by_length in tokenised_chunks(batches):
                found = []
                for at, hashes in by_length:
                    good = passing(hashes, bits)
                    found.append((at[good].astype(np.int32), hashes[good]))
                yield len(low), (langs, low, starts, ends, text, found)

        for unit in units(kept()):
            for k in range(1, LONGEST + 1):
                found = [x[-1][k - 1] for x in unit]
                chunk = np.repeat(np.arange(len(unit), dtype=np.int32), [len(h) for _, h in found])
                _, first, n = np.unique(np.concatenate([h for _, h in found]), return_index=True, return_counts=True)
                chunk, at = chunk[first], np.concatenate([at for at, _ in found])[first]
                for i, (langs, low, starts, ends, text, _) in enumerate(unit):
                    place, counts = at[chunk == i], n[chunk == i]
                    if not len(place):
                        continue
                    words = [word_array(low, starts[place + j], ends[place + j]) for j in range(k)]
                    phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, " ")
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(text[place])), pa.array(np.full(len(place), k, dtype=np.int32)), phrase, pa.array(counts.astype(np.int64))], names=["lang", "k", "phrase", "n"])
            for langs, _, _, _, text, _ in unit:
                per = pa.table({"lang": langs, "n": pa.array(np.bincount(text, minlength=len(langs)))}).group_by("lang").aggregate([("n", "sum")])
                for row in per.combine_chunks().to_batches():
                    m = row.num_rows
                    yield pa.RecordBatch.from_arrays([row.column("lang"), pa.array(np.zeros(m, dtype=np.int32)), pa.array([""] * m, pa.string()), row.column("n_sum").cast(pa.int64())], names=["lang", "k", "phrase", "n"])

    return run


def word_array(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow array."""
    size = ends - starts
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    data = low[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def frequent_ngrams(docs: DataFrame, threshold: int = 10, partition_mass: int = PARTITION_MASS, slice_bits: int = SLICE_BITS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """lang, k, phrase, n: exact counts of all phrases of up to three words that occur ``threshold`` times or more in their language; with
    k = 0 and an empty phrase, the number of words of each language.

    Null texts are empty, a null language is ``und``; rows count as often as they stand in the table; other columns are not read; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(lang_of().alias("lang"), F.xxhash64(lang_of()).alias("lang_hash"), text_of().alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = min(1 << 20, max(1, math.ceil(0.4 * size / partition_mass)))  # a text has about 0.4 n-grams a byte
    slice_bits = max(8, min(slice_bits, 1 << int(math.log2(8 * filter_bytes / partitions))))
    dealt = stored(texts.mapInArrow(deal(partitions, threshold), "part int, mass bigint, prints binary, counts binary"), "prints")
    none = F.lit(None).cast("binary")
    masses = dealt.groupBy("part").agg(F.sum("mass").alias("mass")).select("part", "mass", none.alias("prints"), none.alias("counts"))
    ordered = dealt.unionByName(masses).repartition(partitions, "part").sortWithinPartitions("part", F.col("prints").isNotNull())
    slices = ordered.mapInArrow(summarise(threshold, slice_bits), "part int, bits binary").collect()  # at most filter_bytes
    whole = bytearray(partitions * slice_bits // 8)
    for r in slices:
        whole[r["part"] * slice_bits // 8 : (r["part"] + 1) * slice_bits // 8] = r["bits"]
    shared = spark.sparkContext.broadcast(bytes(whole))
    counted = texts.mapInArrow(count_kept(shared, partitions, slice_bits), "lang string, k int, phrase string, n bigint")
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= threshold) | (F.col("k") == 0))


def collocations(docs: DataFrame, threshold: int = 10, top: int | None = 2000, covered_percent: int = 50, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the collocations of each language; ``top`` limits the ranks (None: all, without limit).

    A phrase of two or three words scores by its weakest cut, floor(1000000 a a / (l r)), in decimal arithmetic; of cuts with one
    score the first counts. A phrase inside a longer one that has ``covered_percent`` of its count goes. Equal scores rank by
    count, then by the phrase's bytes. Nulls and empty tables as in ``frequent_ngrams``.
    """
    counts = stored(frequent_ngrams(docs, threshold, **how), "ngrams")
    totals = counts.filter("k = 0").select(F.col("lang").alias("t_lang"), F.col("n").alias("n"))  # one row per language
    known = counts.filter("k > 0").select("lang", "k", "phrase", F.col("n").alias("a"))
    long = known.filter("k > 1")

    # A word such as an article begins or ends many phrases, so the phrases of one part are dealt over SALTS keys.
    cuts = F.when(F.col("k") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    cut = long.select("lang", "phrase", "k", "a", F.explode(cuts).alias("cut"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    parts = known.filter(f"k < {LONGEST}").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    side = lambda part, count: parts.select("lang", "salt", F.col("phrase").alias(part), F.col("a").alias(count))
    scored = cut.join(side("first", "l"), ["lang", "salt", "first"]).join(side("rest", "r"), ["lang", "salt", "rest"])
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    scored = scored.withColumn("num", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("den", exact("l") * exact("r")).withColumn("score", F.expr("num div den"))
    best = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))

    inner = F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))
    covers = long.filter("k = 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(covers, ["lang", "phrase"], "left").filter((F.col("k") == LONGEST) | F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    rows = left.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # the best of each share of a language first, so that no task meets more than SALTS * top rows of it
        share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        rows = rows.withColumn("share", share).withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("place") <= top).drop("share", "place")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    rows = rows if top is None else rows.filter(F.col("rank") <= top)
    return rows.join(totals, F.col("lang") == F.col("t_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
