"""Prefix trie of conversations: grouped by digests of blocks of turns, and by single turns only inside blocks where siblings diverge.

A turn at a position has a 128-bit digest; a prefix has the exclusive or of those of its turns, so digests of blocks, and of all that comes
before a block, are sums that Spark aggregates in any order. Conversations meet first by the digest at the end of each block. Where all
conversations that go on from a prefix share the whole next block, its turns are a chain of nodes with the block's members, and nothing is grouped again. Where
they do not, one conversation stands for each distinct block, and only those are grouped turn by turn.

A node is named by its smallest member and its depth. The nodes of one conversation are then one chain, hung on a node of a smaller one. Sums over subtrees
are sums down a chain plus those of the chains hung on it; the latter come from doubling the distance to the ancestor, so the number of
rounds is the logarithm of how deep chains hang on chains. Running values go over slices of a chain, positions over the parts of a sort, so no task
holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, stored, text_of

BLOCK = 4
SLICE = 4096
SALTS = 16
LOAN = 20  # conversations of one base
IDS = 1 << 16  # range of ids joined to one text


def running(rows: DataFrame, keys: list[str], place: str, values: dict[str, str], fold: Callable[[str], Column], merge: Callable[[Column, Column], Column], zero: int = 0, backwards: bool = False) -> DataFrame:
    """``rows`` with ``values`` (name -> column) folded along ``place`` up to each row: inside slices of SLICE places, then over the slices' totals."""
    order = (lambda c: F.col(c).desc()) if backwards else F.col
    rows = rows.withColumn("_slice", F.floor(F.col(place) / SLICE))
    inside = W.partitionBy(*keys, "_slice").orderBy(order(place))
    totals = rows.groupBy(*keys, "_slice").agg(*(fold(c).alias(f"_t_{n}") for n, c in values.items()))
    earlier = W.partitionBy(*keys).orderBy(order("_slice")).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, "_slice", *(F.coalesce(fold(f"_t_{n}").over(earlier), F.lit(zero)).alias(f"_c_{n}") for n in values))
    local = rows.select("*", *(fold(c).over(inside).alias(f"_l_{n}") for n, c in values.items())).join(carry, [*keys, "_slice"])
    return local.select(*(c for c in rows.columns if c != "_slice"), *(merge(F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n in values))


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two digests of role and text, words of the text; rows without conv_id belong to no conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), text_of("text")
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).filter("conv_id IS NOT NULL")
    return rows.select("conv_id", "turn", *(F.xxhash64(F.lit(seed), "role", "text").alias(f"t{seed}") for seed in (1, 2)), n_words(F.col("text")).alias("words"))


def rebuilt(conversations: DataFrame, loan: int = LOAN) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, e1, e2, words) of the rebuilt conversations, and all conv_ids.

    A conversation starts with the first h turns of the one whose id is its own without the remainder of ``loan``, then come its own after its first h.
    Turns are ordered by ``turn``, null first, and those that tie by a digest of role and text.
    """
    order = ["conv_id", "turn", "t1", "t2"]
    rows = turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    of = W.partitionBy("conv_id")  # a row for each part of the sort that holds some of the conversation
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv_id", "part", "from", before.alias("before"), F.sum("n").over(of).alias("n_turns"))
    sizes = parts.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    plan = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % loan).alias("base"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("there")), "base", "left")
    plan = stored(plan.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("lead")), "plan")
    placed = rows.join(parts.join(plan, "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("from"))
    own = placed.filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "t1", "t2", "words")
    lent = placed.filter("conv_id = base AND pos < 3").select("base", "pos", "t1", "t2", "words")
    lent = plan.filter("lead > 0").select("conv_id", "base", "lead").join(lent, "base").filter("pos < lead").select("conv_id", "pos", "t1", "t2", "words")
    out = own.unionByName(lent).select("conv_id", "pos", F.xxhash64("pos", "t1", "t2").alias("e1"), F.xxhash64("t2", "pos", "t1").alias("e2"), "words")
    return stored(out, "rebuilt"), plan.select("conv_id")


def end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, d1, d2, ids), sorted, the texts of a node in order -> one SHA-256 for each node, fed text by text."""
    key, running_hash, done = None, None, []

    def close() -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["depth", "d1", "d2", "ends_sha256"])

    for batch in batches:
        for *at, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "d1", "d2", "ids"))):
            if key != at:
                if key is not None:
                    done.append((*key, running_hash.hexdigest()))
                key, running_hash = at, hashlib.sha256(ids.encode())
            else:
                running_hash.update(b"," + ids.encode())
        yield close()
        done.clear()
    if key is not None:
        done.append((*key, running_hash.hexdigest()))
        yield close()


def ends(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, d1, d2, ends_sha256 of the nodes at which conversations end."""
    last = blocks.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.max_by(F.struct("p1", "p2"), "block").alias("p"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    at = convs.join(last, "conv_id", "left").select("conv_id", none(F.col("depth")).alias("depth"), none(F.col("p.p1")).alias("d1"), none(F.col("p.p2")).alias("d2"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    key = ["depth", "d1", "d2"]
    joined = at.groupBy(*key, F.floor(F.col("conv_id") / IDS).alias("range")).agg(ids.alias("ids"))  # at most IDS ids each, where ids are unique
    ordered = joined.repartition(*key).sortWithinPartitions(*key, "range").select(*key, "ids")
    return ordered.mapInArrow(end_digests, "depth bigint, d1 bigint, d2 bigint, ends_sha256 string")


def nodes(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """conv_id, depth, d1, d2 (digest of the node), pd1, pd2 (of its parent), n_convs, words, inner (its parent is the same conversation's, within a shared block)."""
    kinds = blocks.groupBy("block", "n", "p1", "p2", "q1", "q2").agg(F.count("*").alias("m"), F.min("conv_id").alias("conv_id"))
    kinds = stored(kinds.withColumn("salt", F.pmod("p1", F.lit(SALTS)).cast("int")), "kinds")
    # Many distinct blocks may follow one prefix (all first blocks follow the root), so they meet its count over SALTS keys.
    after = kinds.groupBy("block", "q1", "q2").agg(F.count("*").alias("k")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    kinds = kinds.join(after, ["block", "q1", "q2", "salt"]).select("conv_id", "block", "m", "q1", "q2", (F.col("k") == 1).alias("alone"))
    inside = W.partitionBy("conv_id", "block").orderBy("pos")  # at most BLOCK rows
    each = rows.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(kinds, ["conv_id", "block"])
    each = each.select("*", *(xor(F.col(f"q{i}"), F.bit_xor(f"e{i}").over(inside)).alias(f"d{i}") for i in (1, 2)))
    each = each.select("conv_id", (F.col("pos") + 1).alias("depth"), "d1", "d2", *(xor(F.col(f"d{i}"), F.col(f"e{i}")).alias(f"pd{i}") for i in (1, 2)), F.col("m").alias("n_convs"), "words", "alone", (F.col("pos") % BLOCK > 0).alias("deep"))
    each = stored(each, "turns-of-kinds")
    shared = each.filter("alone").select("conv_id", "depth", "d1", "d2", "pd1", "pd2", "n_convs", "words", F.col("deep").alias("inner"))
    split = each.filter("NOT alone").groupBy("depth", "d1", "d2", "pd1", "pd2").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("words").alias("words"))
    return stored(shared.unionByName(split.withColumn("inner", F.lit(False))), "nodes")


def subtree_sums(chains: DataFrame) -> DataFrame:
    """(conv_id, up, saved, leaves) of chains hung on chains -> conv_id, saved, leaves with all that hangs below added."""
    state = stored(chains.select("conv_id", "up", "saved", "leaves"), "chains")
    while not state.filter("up IS NOT NULL").isEmpty():
        add = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        far = state.select(F.col("conv_id").alias("up"), F.col("up").alias("farther"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        grown = state.join(add, "conv_id", "left").join(far, "up", "left")
        state = stored(grown.select("conv_id", F.col("farther").alias("up"), (F.col("saved") + zero("s")).alias("saved"), (F.col("leaves") + zero("l")).alias("leaves")), "chains")
    return state.drop("up")


def prefix_trie(conversations: DataFrame, loan: int = LOAN) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role or text is empty; a null turn comes first; rows without conv_id are left out; repeated rows are turns of their own; turns that tie are
    ordered by a digest of role and text. Conversations left without turns belong to the root. Other columns are not read; a table without
    conversations has no nodes.
    """
    rows, convs = rebuilt(conversations, loan)
    found = convs.agg(F.min("conv_id"), F.count("*")).first()
    blocks = rows.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"), F.count("*").alias("n"))
    blocks = running(blocks, ["conv_id"], "block", {"p1": "x1", "p2": "x2"}, F.bit_xor, xor)
    blocks = stored(blocks.select("conv_id", "block", "n", "p1", "p2", xor(F.col("p1"), F.col("x1")).alias("q1"), xor(F.col("p2"), F.col("x2")).alias("q2")), "blocks")

    made = nodes(rows, blocks)
    first, many = (found[0] or 0), found[1]
    above = made.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("pd1"), F.col("d2").alias("pd2"), F.col("conv_id").alias("parent_conv_id"))
    linked = made.filter("NOT inner AND depth > 1").join(above, ["depth", "pd1", "pd2"])
    plain = made.filter("inner OR depth = 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first)).otherwise(F.col("conv_id")))
    root = convs.limit(1).select(F.lit(first).alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), *(F.lit(0).cast("bigint").alias(c) for c in ("d1", "d2")), F.lit(many).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("bigint").alias("parent_conv_id"))
    columns = root.columns
    tree = stored(linked.select(*columns).unionByName(plain.select(*columns)).unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "tree")

    hung = tree.filter("parent_conv_id <> conv_id").select("conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("at"))
    chains = tree.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.max("depth").alias("last"))
    full = hung.select(F.col("up").alias("conv_id"), F.col("at").alias("last")).distinct().withColumn("goes_on", F.lit(True))
    chains = chains.join(full, ["conv_id", "last"], "left").join(hung.select("conv_id", "up"), "conv_id", "left")
    sums = subtree_sums(chains.select("conv_id", "up", "saved", F.when(F.col("goes_on"), 0).otherwise(1).cast("bigint").alias("leaves")))

    nil = F.lit(0).cast("bigint")
    children = tree.filter("parent_conv_id IS NOT NULL").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("bigint").alias("child"), nil.alias("saved"), nil.alias("leaves"))
    below = hung.join(sums, "conv_id").select(F.col("up").alias("conv_id"), F.col("at").alias("depth"), nil.alias("child"), "saved", "leaves")
    below = children.unionByName(below).groupBy("conv_id", "depth").agg(F.sum("child").alias("n_children"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    here = tree.join(below, ["conv_id", "depth"], "left").fillna(0, ["n_children", "saved", "leaves"])
    here = here.withColumn("saved", F.col("saved") + F.col("own")).withColumn("leaves", F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    here = running(here, ["conv_id"], "depth", {"saved_tokens": "saved", "n_leaves": "leaves"}, F.sum, lambda a, b: a + b, backwards=True)

    out = here.join(ends(blocks, convs), ["depth", "d1", "d2"], "left")
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
