"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source size copies. Within the source the
expected copies are prefix-summed along the documents' order, one offset drawn for the source is added,
and a document is emitted once per integer boundary that its stretch crosses. The order goes by size class (four to the doubling) and inside a class by a
digest of the id, so every stretch of the order stands for its share of words and one offset brings each source near its target. The prefix sums come
in two steps, ranks inside slices of a source and offsets between its slices, so a source
that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, stored, text_hash, text_of

STEPS = 1 << 20
SHARES = 8  # rows of a source lie in slices of one size class each, so slices are cut this much longer


def shuffled(doc_id: Column) -> Column:
    """Place of a document in the order of its source: 32 bits of a digest of its id (null: 0)."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, n_docs (with words), target: shares by weight of all sizes, none above ``cap`` times its source's size.

    Sources in code point order (null last) take the weights in turn. The water level of the shares is found in closed form
    from one ordering of the sources; that table has one short row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    everything = W.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * cap)
    order = everything.orderBy(F.col("limit") / F.col("weight"), "place")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("at", "level"))
    per = per.withColumn("level", F.min(fits).over(everything)["level"])
    return per.select("source", "source_size", "n_docs", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, slice_rows: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, text_key, source, size, source_size, target, copies, taken.

    ``size`` is the number of words. The offset of a source is a digest of its name and ``seed``, so reruns agree. No document is emitted more
    than ``cap`` times. Documents without words (null texts too) expect no copies. A null source is a source of its own, placed last; null ids
    come first in their size class; repeated rows are ranked one after another. Other columns are not read; an empty table gives an empty plan.
    """
    sizes = stored(docs.select("doc_id", "source", text_hash().alias("text_key"), n_words(text_of()).alias("size")), "sizes")
    width = math.ceil(2**32 / max(1, math.ceil(sizes.count() / (SHARES * slice_rows))))
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("of", F.lit("")), F.lit(f"|{seed}")).cast("binary")), 1, 5), 16, 10).cast("double") / STEPS
    rates = source_targets(sizes, weights, cap).withColumnRenamed("source", "of").withColumn("offset", offset)
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))

    level = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 4) + 1).otherwise(0).cast("int")
    sized = sizes.withColumn("place", shuffled(F.col("doc_id"))).withColumn("level", level).withColumn("part", F.floor(F.col("place") / width).cast("int"))
    slices = sized.groupBy("source", "level", "part").agg(F.count_if(F.col("size") > 0).alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("level", "part").rowsBetween(W.unboundedPreceding, -1))
    slices = slices.select("source", F.col("level").alias("of_level"), F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("start"))
    # What holds for a source reaches its rows through its slices, so that no task meets all rows of a source.
    slices = slices.join(rates, F.col("source").eqNullSafe(F.col("of"))).select("of", "of_level", "of_part", "start", "source_size", "target", "rate", "offset")
    ranked = sized.withColumn("inside", F.row_number().over(W.partitionBy("source", "level", "part").orderBy("place", "doc_id", "text_key")))
    out = ranked.join(slices, F.col("source").eqNullSafe(F.col("of")) & (F.col("level") == F.col("of_level")) & (F.col("part") == F.col("of_part")))
    rank = F.col("start") + F.col("inside")
    copies = F.floor(F.col("rate") * rank + F.col("offset")) - F.floor(F.col("rate") * (rank - 1) + F.col("offset"))
    n = F.when(F.col("size") == 0, F.lit(0)).otherwise(copies).cast("bigint")
    return out.select("doc_id", "text_key", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document as often as the plan says, all columns kept.

    Rows that agree in id, source and text are told apart by their number only, so any of them may take any of their plans.
    """
    p = "_m_"
    while any(x.lower().startswith(p) for x in docs.columns):
        p = "_" + p
    keys = [f"{p}id", f"{p}source", f"{p}text"]
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))
    plan = mix_plan(docs, **how).select(F.col("doc_id").alias(keys[0]), F.col("source").alias(keys[1]), F.col("text_key").alias(keys[2]), F.col("copies").alias(f"{p}copies"))
    plan = plan.withColumn(f"{p}nth", F.row_number().over(W.partitionBy(*keys).orderBy(f"{p}copies")))
    left = docs.select("*", F.col("doc_id").alias(keys[0]), F.col("source").alias(keys[1]), text_hash().alias(keys[2])).withColumn(f"{p}nth", nth)
    plan = plan.filter(F.col(f"{p}copies") > 0)
    on = [left[k].eqNullSafe(plan[k]) for k in [*keys, f"{p}nth"]]
    return left.join(plan, on).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies").cast("int")))).select(*(left[x] for x in docs.columns))
