"""Line dedup: repeated runs of lines found with a suffix array over line ids, later copies deleted.

Every line with a word has a line id, the rank of its text among the repeated texts of the corpus.
Prefix doubling ranks the suffixes of all documents by their first 1, 2, 4, ... lines: a suffix
takes the rank of the pair (own rank, rank of the suffix as many lines on), found by range-sorting the distinct pairs
that occur twice or more. Suffixes that agree with no other one leave the doubling, so each round works on repeats alone.

Suffixes that agree in their first n lines are one interval of the suffix array whose longest common prefix is
n or more; its name is the pair of doubled ranks that cover the n lines. A run counts from
``min_words`` words on, so for each line only two prefixes matter: the shortest run of so many words that
starts there, and the shortest that ends there. Together such runs cover exactly the lines
of all repeated runs of that length. In each interval the first run in order of document and line stays; the others are deleted, and
touching deletions join into maximal runs. The doubling stops at the depth which those prefixes need (at most ``min_words`` lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, n_words, stored, text_hash, text_of

DOC = ["doc", "text_key"]
LEAST = -(1 << 63)


def doc_keys() -> list[Column]:
    """Key of a document: its id (null: the least number) and a hash of its text, so rows that share an id with other texts stay apart."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("doc"), text_hash().alias("text_key")]


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, text_key, pos, two 64-bit hashes that name the line, its number of words; lines without a word are left out."""
    split = docs.select(*doc_keys(), F.posexplode(F.split(text_of(), "\n")).alias("pos", "line")).filter(F.col("line").rlike(WORD))
    return split.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), n_words(F.col("line")).alias("w"))


def ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Ranks, in order of (a, b), of the pairs that occur twice or more."""
    often = pairs.groupBy(a, b).agg(F.count("*").alias("n")).filter("n > 1").select(a, b)
    return often.repartitionByRange(a, b).sortWithinPartitions(a, b).select(a, b, (F.monotonically_increasing_id() + 1).alias("rank"))


def first_level(docs: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines with their rank and the shortest runs of ``min_words`` words from and up to them (length 0: none of repeated lines)."""
    lines = stored(lines_of(docs), "lines")
    lines = lines.join(ranked(lines, "h1", "h2"), ["h1", "h2"], "left").drop("h1", "h2").repartition(*map(F.col, DOC)).dropDuplicates([*DOC, "pos"])
    in_doc = W.partitionBy(*DOC)
    order = in_doc.orderBy("pos")
    lines = lines.select("*", F.row_number().over(order).cast("bigint").alias("idx"), F.sum("w").over(order).alias("upto"))
    lines = lines.withColumn("before", F.col("upto") - F.col("w"))
    on, back = in_doc.orderBy("before").rangeBetween(0, min_words - 1), in_doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    whole = lambda frame: (F.sum("w").over(frame) >= min_words) & F.min(F.col("rank").isNotNull()).over(frame)
    length = lambda frame: F.when(whole(frame), F.count("*").over(frame)).otherwise(0)
    lines = lines.select(*DOC, "pos", "idx", "rank", length(on).alias("on"), F.last("pos").over(on).alias("on_pos"), length(back).alias("back"), F.first("pos").over(back).alias("back_pos"))
    return stored(lines.filter("rank IS NOT NULL"), "rank1")


def doubled(level: DataFrame, k: int) -> DataFrame:
    """Ranks by the first 2k lines from ranks by the first k."""
    ahead = F.first("rank").over(W.partitionBy(*DOC).orderBy("idx").rangeBetween(k, k))
    pairs = level.select(*DOC, "idx", F.col("rank").alias("a"), ahead.alias("b")).filter("b IS NOT NULL")
    return stored(pairs.join(ranked(pairs, "a", "b"), ["a", "b"]).select(*DOC, "idx", "rank"), f"rank{2 * k}")


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc, text_key, first_pos, last_pos, n_lines: the maximal runs of lines to delete, positions counted from 0 over all lines of the text."""
    one = first_level(docs, min_words)
    longest = one.agg(F.greatest(F.max("on"), F.max("back"))).first()[0] or 0
    names, level, k = one.select(*DOC, "idx", "rank", F.lit(1).cast("bigint").alias("k")), one, 1
    while 2 * k <= longest:
        level = doubled(level, k)
        k *= 2
        names = names.unionByName(level.withColumn("k", F.lit(k).cast("bigint")))

    blocks = one.filter("on > 0").select(*DOC, F.col("idx").alias("start"), F.col("on").alias("n"), F.col("pos").alias("p0"), F.col("on_pos").alias("p1"))
    blocks = blocks.union(one.filter("back > 0").select(*DOC, (F.col("idx") - F.col("back") + 1).alias("start"), F.col("back").alias("n"), F.col("back_pos").alias("p0"), F.col("pos").alias("p1")))
    blocks = blocks.distinct().withColumn("k", F.expr("shiftleft(1L, length(bin(n)) - 1)"))
    at = lambda name, place: names.select(*DOC, F.col("idx").alias(place), "k", F.col("rank").alias(name))
    named = blocks.join(at("a", "start"), [*DOC, "start", "k"]).withColumn("tail", F.col("start") + F.col("n") - F.col("k")).join(at("b", "tail"), [*DOC, "tail", "k"])
    named = stored(named.select(*DOC, "start", "n", "p0", "p1", "a", "b"), "intervals")
    place = F.struct(*DOC, "start")
    first = named.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    later = named.join(first, ["n", "a", "b"]).filter(place != F.col("first")).select(*DOC, "start", (F.col("start") + F.col("n")).alias("stop"), "p0", "p1")

    order = W.partitionBy(*DOC).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = later.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("opens").over(order))
    return islands.groupBy(*DOC, "island").agg(F.min("p0").alias("first_pos"), F.max("p1").alias("last_pos"), (F.max("stop") - F.min("start")).alias("n_lines")).drop("island")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text`` and a column ``_removed`` of (first_pos, last_pos, n_lines) added.

    The first copy in order of (doc_id, text hash, line) stays, also where copies lie in one document or overlap. Lines without a word belong to
    no run; inside a deleted run they go with it. Runs under ``min_words`` words stay, however often they occur. Null texts stay null, no row is
    dropped (a text may become empty), rows that repeat id and text are one document and all keep what it keeps, null ids come
    first, other columns are carried.
    """
    added = "_removed"
    runs = repeated_runs(docs, min_words).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first_pos", "last_pos", "n_lines"))).alias("_l_runs")).select(F.col("doc").alias("_l_doc"), F.col("text_key").alias("_l_key"), "_l_runs")
    doc, key = doc_keys()
    out = docs.join(runs, (doc == F.col("_l_doc")) & (key == F.col("_l_key")), "left")
    lines, cut = F.split(F.col("text"), "\n"), F.col("_l_runs")
    opens = F.concat(F.array(F.lit(0)), F.transform(cut, lambda r: r["last_pos"] + 1))
    closes = F.concat(F.transform(cut, lambda r: r["first_pos"]), F.array(F.size(lines)))
    left = F.transform(F.array(lines), lambda all_: F.array_join(F.flatten(F.zip_with(opens, closes, lambda a, b: F.slice(all_, a + 1, b - a))), "\n"))
    text = F.when(cut.isNull(), F.col("text")).otherwise(F.get(left, F.lit(0)))
    return out.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), F.coalesce(cut, F.array().cast(runs.schema["_l_runs"].dataType)).alias(added))


def clean(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents after line dedup, with their own columns; ``n_chars`` follows the text where there is one."""
    out = dedup_lines(docs, min_words)
    size = F.when(F.size("_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text")) if "n_chars" in docs.columns else None
    return out.select(*(size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
