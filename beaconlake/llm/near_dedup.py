"""Near-duplicate documents by SetSketch registers: band the registers, estimate pairs jointly by likelihood, verify on full sets.

Documents with equal shingle sets are one class and take part once, by their smallest id. Classes that share a band key
are candidates. Pairs inside a bucket are never all emitted: first every member meets the bucket's smallest id, and of all those the one with the
likeliest registers is verified; then only buckets whose members are still in different components
go on, ``LEADERS`` members at a time against the later members of other components, round by round until each bucket is one component or all its
members have been leaders. The join that compares them holds the parities of sets that are not large (``sketch.parities``): two sets differ in at
least as many shingles as their parities do, so pairs that this proves to be below the threshold are not emitted and no link is lost. Of large sets it
holds the low two bits of all registers and emits only pairs whose bits agree as often as those of similar sets do, so no candidate near the
threshold is dropped and dissimilar members of a bucket make no rows. A pair that shares several
buckets meets in the smallest of them only, which stays until it is one component or the pair's smaller member has been a leader there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sketch
from .common import ship, stored
from .graph import components

BANDS, ROWS = 64, 7
LEADERS = 256
# Sets with more shingles are compared by their registers alone: so many parities tell little of them.
PARITY_SETS = sketch.PARITIES // 2
PERCENT = 75
# A pair is verified if its estimate is at most this far below the threshold: five standard deviations of an estimate from 448 registers at 0.75.
MARGIN = 0.11
DEVIATIONS = 4.5  # likewise for the share of registers whose low two bits agree, (1 + 3 J) / 4 at similarity J

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def sketch_batches(bands: int, rows: int) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = sketch.text_bytes(batch.column("text"))
            for start, stop in sketch.chunks(bounds):
                at = bounds[start : stop + 1]
                owner, hashes = sketch.shingles(raw[at[0] : at[-1]], at - at[0])
                n = np.bincount(owner, minlength=stop - start)
                first = np.r_[0, np.cumsum(n)][:-1]
                total = lambda x: np.where(n > 0, np.add.reduceat(np.r_[x, np.uint64(0)], np.minimum(first, len(x))), np.uint64(0)).view(np.int64)
                regs = sketch.registers(owner, hashes, stop - start, bands * rows)
                keys = sketch.band_keys(regs, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (stop - start + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
                packed = sketch.digests(regs)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(0, packed.size + 1, packed.shape[1], dtype=np.int32)), pa.array(packed.ravel()))
                odd = sketch.parities(owner, hashes, stop - start)
                parity = pa.ListArray.from_arrays(pa.array(np.arange(0, odd.size + 1, odd.shape[1], dtype=np.int32)), pa.array(odd.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(n), pa.array(total(hashes)), pa.array(total(sketch.mix(hashes + sketch.GOLDEN))), lists, bits, parity, pa.array([x.tobytes() for x in regs], type=pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands", "bits", "parity", "regs"],
                )

    return run


def check_batches(percent: int) -> Batches:
    """Estimate each pair from its registers; those that may be similar are verified on their full sets."""

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        regs = [np.stack([np.frombuffer(x.as_py(), dtype=np.uint16) for x in batch.column(c)]) for c in ("ra", "rb")]
        sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
        return batch.filter(pa.array(sketch.likely_jaccard(*regs, *sizes) >= percent / 100 - MARGIN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = likely(batch) if batch.num_rows else batch
            (raw_a, at_a), (raw_b, at_b) = (sketch.text_bytes(batch.column(c)) for c in ("ta", "tb"))
            for start, stop in sketch.chunks(at_a + at_b):
                sets = [sketch.shingles(raw[at[start] : at[stop]], at[start : stop + 1] - at[start]) for raw, at in ((raw_a, at_a), (raw_b, at_b))]
                owner, hashes = np.r_[sets[0][0], sets[1][0]], np.r_[sets[0][1], sets[1][1]]
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                twice = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
                both = np.bincount(owner[1:][twice], minlength=stop - start)
                union = np.bincount(owner, minlength=stop - start) - both
                good = pa.array((100 * both >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, stop - start).filter(good) for c in ("a", "b")], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Texts without words (null too) have no shingles and are linked with nothing. Rows that repeat a doc_id are one document. A row without id
    takes the component of the documents that equal it, if any, and is kept only where there are none. Other columns are not read.
    An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = stored(ids.mapInArrow(sketch_batches(bands, rows), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, bits array<bigint>, parity array<bigint>, regs binary"), "sketches")
    same = ["n_shingles", "s1", "s2"]
    classes = stored(made.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    reps = made.join(classes, same).filter("doc_id = rep")
    each = reps.select("doc_id", F.explode("bands").alias("key"))  # a key is of one band
    shared = each.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).filter("n > 1")
    members = stored(each.join(shared, "key").select("key", "doc_id", "lead").dropDuplicates(["key", "doc_id"]), "members")
    one = ["doc_id", *same]
    chosen = reps.join(members.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(one)
    longs = -(-bands * rows // 32)
    sides = stored(chosen.select(*one, "regs", "bits", "parity").join(ids, "doc_id").dropDuplicates([*one, "text"]), "candidates")
    bits = stored(sides.select(*one, "bits", "parity").dropDuplicates(one).select("doc_id", F.col("n_shingles").alias("n"), "bits", "parity"), "bits")
    expected = (1 + 3 * percent / 100) / 4
    needed = expected - DEVIATIONS * (expected * (1 - expected) / (bands * rows)) ** 0.5
    pad = longs * 32 - bands * rows  # unused places agree

    def agreement(left: str, right: str) -> Column:
        """Registers whose low two bits agree."""
        both = F.zip_with(f"{left}.bits", f"{right}.bits", lambda x, y: x.bitwiseXOR(y))
        differing = F.transform(both, lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(6148914691236517205))))
        return F.lit(longs * 32 - pad) - F.aggregate(differing, F.lit(0), lambda total, count: total + count)

    def may_link(left: str, right: str, parity: Callable[[str, int], str]) -> Column:
        """False only for sets below the threshold: of n shingles in both sets together, d in one alone leave a similarity of (n - d) / (n + d)."""
        d = " + ".join(f"bit_count({parity(left, i)} ^ {parity(right, i)})" for i in range(sketch.PARITIES // 64))
        return F.expr(f"{100 + percent} * ({d}) <= {100 - percent} * ({left}.n + {right}.n)")

    similar_size = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x: sides.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n" + x), F.col("regs").alias("r" + x), F.col("text").alias("t" + x))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb", "ta", "tb")
        return stored(both.mapInArrow(check_batches(percent), "a bigint, b bigint"), "verified")

    stars = members.filter("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    met = stars.alias("s").join(bits.alias("x"), F.col("s.a") == F.col("x.doc_id")).join(bits.alias("y"), F.col("s.b") == F.col("y.doc_id")).filter(similar_size)
    met = met.filter((agreement("x", "y") >= needed * bands * rows) & may_link("x", "y", "{}.parity[{}]".format)).select("a", "b", agreement("x", "y").alias("agree"))
    best = met.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b"))
    links = verified(best)
    labels = components(links)
    members = members.select("key", "doc_id").withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("doc_id")))
    done = 0
    while True:
        now = members.join(labels, members["doc_id"] == labels["node"], "left").select(members["*"], F.coalesce("component", "doc_id").alias("component"))
        mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("place").alias("n")).filter((F.col("lo") < F.col("hi")) & (F.col("n") > done + 1))
        left = stored(now.join(mixed.select(F.col("key").alias("of")), F.col("key") == F.col("of"), "left_semi"), "members")
        if left.isEmpty():
            break
        if not done:
            # Of two sets of similar size, both have parities or both have bits.
            few, many = F.col("n") <= PARITY_SETS * 100 // percent, F.col("n") > PARITY_SETS
            slim = bits.select("doc_id", "n", F.when(many, F.col("bits")).alias("bits"), *(F.when(few, F.get("parity", F.lit(i))).alias(f"p{i}") for i in range(sketch.PARITIES // 64)))
            left = stored(left.withColumn("keys", F.collect_list("key").over(W.partitionBy("doc_id"))).join(slim, "doc_id"), "packed")
        heads = left.filter((F.col("place") > done) & (F.col("place") <= done + LEADERS))
        meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.place") > F.col("y.place")) & (F.col("x.component") != F.col("y.component"))
        close = F.expr(similar_size) & F.coalesce(may_link("x", "y", "{}.p{}".format), F.lit(True)) & F.coalesce(agreement("x", "y") >= needed * bands * rows, F.lit(True))
        first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
        pairs = left.alias("x").join(heads.alias("y"), meet & close & first).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
        found = verified(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        members = left.drop("component")
        done += LEADERS

    out = made.select("doc_id", *same).join(classes, same, "left").join(labels, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def distinct_documents(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of near copies, with its own columns: that with the smallest doc_id (no id comes last), of equal ids any one.

    Every row is told apart by a number of its own, so rows without id, rows that repeat an id and ids that are no numbers are compared like all others.
    """
    row = "_n_row"
    while row in docs.columns:
        row = "_" + row
    number = F.expr("try_cast(doc_id AS BIGINT)")
    twice = stored(docs.select(number.alias("_n_twice")).groupBy("_n_twice").agg(F.count("*").alias("n")).filter("n > 1 AND _n_twice IS NOT NULL").select("_n_twice"), "twice")
    fresh = F.lit(1 << 62) + F.monotonically_increasing_id()  # above the ids of the table, so those come first as in near_duplicates
    own = F.coalesce(number, fresh)
    numbered = docs.withColumn(row, own)
    if not twice.isEmpty():
        numbered = docs.join(twice, number == F.col("_n_twice"), "left").withColumn(row, F.when(F.col("_n_twice").isNull(), own).otherwise(fresh)).drop("_n_twice")
    rows = stored(numbered, "numbered")
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("_n_at"), "component_id")
    each = rows.select(F.col(row).alias("_n_at"), F.col("doc_id").alias("_n_id")).join(groups, "_n_at")
    first = each.groupBy("component_id").agg(F.min(F.struct(F.col("_n_id").isNull(), "_n_id", "_n_at"))["_n_at"].alias(row))
    return rows.join(first.select(row), row, "left_semi").select(*docs.columns)
