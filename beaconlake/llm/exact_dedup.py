"""Exact deduplication by a tree merge of sorted digest runs.

Every row becomes one digest entry: a 64-bit key that the runs are sorted by, and
the SHA-256 with the byte length that verify a match of keys. Entries are dealt to runs by
a hash of the row id, so copies of one text are spread over all runs. Each round
merges ``fan_in`` runs into one and keeps per digest the count and the surviving id; after
the last round one run, spread over all tasks by digest, holds every group. The way
back hands the survivor down the same tree, so no digest ever meets more than ``fan_in``
rows of one key in a join, however many copies it has.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, stored, text_of

DIGEST = ("d64", "sha", "n_bytes")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = fold_ascii(text_of(text_col))
    return (
        docs.select(F.col(id_col).alias("id"), text.alias("t"))
        .select("id", F.xxhash64("t").alias("d64"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), F.octet_length("t").alias("n_bytes"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8, run_rows: int = 250_000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep``: ``largest`` or ``smallest`` id of a group of equal texts stays. Null texts are empty texts, and
    empty texts are equal. A null id never survives where another id is there; a group of null ids
    alone has a null keep_id and is kept. Rows that repeat an id with an equal text are one document: they
    count in group_size and carry the same verdict. Other columns are not read; an empty table gives an empty result.
    """
    pick = {"largest": F.max, "smallest": F.min}[keep]
    entries = stored(digests(docs, id_col, text_col), "digests")
    rounds = max(2, math.ceil(math.log(max(1, entries.count() / run_rows), fan_in)))
    parent = F.floor(F.col("run") / fan_in).cast("int").alias("run")
    entries = entries.withColumn("run", F.pmod(F.xxhash64("id", "n_bytes"), F.lit(fan_in**rounds)).cast("int"))

    levels = [entries.groupBy("run", *DIGEST).agg(F.count("*").alias("n"), pick("id").alias("keep_id"))]
    for level in range(1, rounds + 1):
        below = levels[-1] = stored(levels[-1].sortWithinPartitions("run", "d64"), f"runs{level - 1}")
        levels.append(below.groupBy(parent, *DIGEST).agg(F.sum("n").alias("n"), pick("keep_id").alias("keep_id")))

    groups = levels[-1].filter("n > 1").select("run", *DIGEST, "keep_id", F.col("n").alias("group_size"))
    for level in range(rounds - 1, -1, -1):
        own = levels[level].select(F.col("run").alias("own"), parent, *DIGEST)
        groups = own.join(groups, ["run", *DIGEST]).select(F.col("own").alias("run"), *DIGEST, "keep_id", "group_size")
    out = entries.join(groups, ["run", *DIGEST], "left")
    grouped = F.col("group_size").isNotNull()
    keep_id = F.when(grouped, F.col("keep_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
