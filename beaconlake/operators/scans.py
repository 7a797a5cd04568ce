"""Running values over long histories without one task per key.

A window over a whole recording, stream or scope would put all its rows into
one task. Here the history is cut into time slices: the window runs inside a
slice, each slice is summarised to one row, a second window runs over those
summary rows only, and the carry of all earlier slices is joined back. The
result equals the plain window; the work of one task is one slice of one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.schema import ORD

SLICE_NS = 60_000_000_000
SLICE = "__slice"


def with_slice(df: DataFrame, column: str = "mono_ns", width: int = SLICE_NS) -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.col(column) / F.lit(width)).cast("bigint"))


@dataclass(frozen=True)
class Scan:
    """One running value: sum, max, min, last (non-null so far) or next (first non-null ahead)."""

    out: str
    kind: str
    value: Column
    inclusive: bool = True


_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def _local(scan: Scan, window) -> Column:
    """``window`` runs backwards for a value ahead: a frame up to the end of a slice is folded anew for each of its rows."""
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow if scan.inclusive else -1)
    if scan.kind in ("last", "next"):
        return F.last(scan.value, ignorenulls=True).over(frame)
    return _FOLDS[scan.kind](scan.value).over(frame)


def _block(scan: Scan, order: Column) -> Column:
    if scan.kind in ("last", "next"):
        pick = F.max_by if scan.kind == "last" else F.min_by
        return pick(scan.value, F.when(scan.value.isNotNull(), order))
    return _FOLDS[scan.kind](scan.value)


def _merge(scan: Scan, carry: Column, local: Column) -> Column:
    if scan.kind in ("last", "next"):
        return F.coalesce(local, carry)
    if scan.kind == "sum":
        return F.coalesce(local + carry, local, carry)
    return (F.greatest if scan.kind == "max" else F.least)(local, carry)


def running(
    df: DataFrame, keys: list[str], scans: list[Scan], order: tuple[str, ...] = ORD, slice_by: str = "mono_ns", width: int | None = None
) -> DataFrame:
    """Add one column per scan. ``keys`` must not be null; ``order`` is a total order led by ``slice_by``."""
    sliced = with_slice(df, slice_by, width or SLICE_NS)
    part = Window.partitionBy(*keys, SLICE)
    window = part.orderBy(*order)
    order_struct = F.struct(*order)
    behind, ahead = [s for s in scans if s.kind != "next"], [s for s in scans if s.kind == "next"]
    local, back = sliced, part.orderBy(*[F.col(c).desc() for c in order])
    if behind:
        # Both directions see rows that tie in one order: that of their places.
        places = [F.row_number().over(window).alias("__place")] if ahead else []
        local = local.select("*", *places, *[_local(s, window).alias(f"__l_{s.out}") for s in behind])
        back = part.orderBy(F.col("__place").desc())
    if ahead:
        local = local.select("*", *[_local(s, back).alias(f"__l_{s.out}") for s in ahead])
    blocks = sliced.groupBy(*keys, SLICE).agg(*[_block(s, order_struct).alias(f"__b_{s.out}") for s in scans])
    slices = Window.partitionBy(*keys)
    earlier = slices.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    later = slices.orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for s in scans:
        b = F.col(f"__b_{s.out}")
        if s.kind in ("last", "next"):
            c = F.last(b, ignorenulls=True).over(earlier if s.kind == "last" else later)
        else:
            c = _FOLDS[s.kind](b).over(earlier)
        carried.append(c.alias(f"__c_{s.out}"))
    carry = blocks.select(*keys, SLICE, *carried)
    joined = local.join(carry, [*keys, SLICE], "inner")
    merged = [_merge(s, F.col(f"__c_{s.out}"), F.col(f"__l_{s.out}")).alias(s.out) for s in scans]
    return joined.select(*df.columns, *merged)


def clamped_sum(
    df: DataFrame, keys: list[str], step: Column, out: str, before: str | None = None, order: tuple[str, ...] = ORD, slice_by: str = "mono_ns"
) -> DataFrame:
    """Running sum of ``step`` that never falls below zero (null until the first step).

    With s the plain running sum and m its lowest value so far, the clamped sum is
    s - min(m, 0). A slice is summarised by its sum and its lowest prefix sum.
    ``before`` names a column for the value just before the row.
    """
    sliced = with_slice(df, slice_by).withColumn("__step", step)
    window = Window.partitionBy(*keys, SLICE).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sliced.withColumn("__s", F.sum("__step").over(upto))
    lowest = summed.withColumn("__m", F.min("__s").over(upto))
    local = lowest.withColumn("__ps", F.lag("__s").over(window)).withColumn("__pm", F.lag("__m").over(window))
    blocks = summed.groupBy(*keys, SLICE).agg(F.sum("__step").alias("__bs"), F.min("__s").alias("__bm"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offset = blocks.withColumn("__cs", F.sum("__bs").over(earlier))
    lows = offset.withColumn("__low", F.coalesce(F.col("__cs"), F.lit(0)) + F.col("__bm"))
    carry = lows.select(*keys, SLICE, "__cs", F.min("__low").over(earlier).alias("__cm"))
    joined = local.join(carry, [*keys, SLICE], "inner")

    def value(s: str, m: str) -> Column:
        base = F.coalesce(F.col("__cs"), F.lit(0))
        total = F.when(F.col("__cs").isNotNull() | F.col(s).isNotNull(), base + F.coalesce(F.col(s), F.lit(0)))
        return total - F.least(F.col("__cm"), base + F.col(m), F.lit(0))

    columns = [value("__s", "__m").alias(out)]
    if before:
        columns.append(value("__ps", "__pm").alias(before))
    return joined.select(*df.columns, *columns)


def segments(df: DataFrame, keys: list[str], mark: Column, out: str, order: tuple[str, ...] = ORD, slice_by: str = "mono_ns") -> DataFrame:
    """Rows of non-null ``mark`` with ``out``, the order struct of the first row of their run of equal marks.

    Only the first row of a slice needs its neighbour, which is known from the
    summary of the slices before it, so one pass over the slices is enough.
    """
    at = F.struct(*order)
    sliced = with_slice(df, slice_by).withColumn("__mark", mark)
    window = Window.partitionBy(*keys, SLICE).orderBy(*order)
    previous = F.lag(F.struct("__mark")).over(window)
    flagged = sliced.withColumn("__p", previous)
    inner = F.col("__p").isNotNull() & F.col("__mark").isNotNull() & ~F.col("__mark").eqNullSafe(F.col("__p.__mark"))
    started = flagged.withColumn("__st", F.when(inner, at))
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = started.withColumn("__l", F.last("__st", ignorenulls=True).over(upto))
    blocks = started.groupBy(*keys, SLICE).agg(
        F.min(at).alias("__first"), F.min_by(F.struct("__mark"), at).alias("__fm"), F.max_by(F.struct("__mark"), at).alias("__lm"), F.max("__st").alias("__last")
    )
    order_slices = Window.partitionBy(*keys).orderBy(SLICE)
    neighbour = F.lag("__lm").over(order_slices)
    opened = blocks.withColumn("__nb", neighbour)
    fresh = F.col("__fm.__mark").isNotNull() & (F.col("__nb").isNull() | ~F.col("__fm.__mark").eqNullSafe(F.col("__nb.__mark")))
    opened = opened.withColumn("__own", F.when(fresh, F.col("__first")))
    earlier = order_slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.coalesce("__last", "__own"), ignorenulls=True).over(earlier)
    carry = opened.select(*keys, SLICE, F.coalesce(F.col("__own"), carried).alias("__c"))
    joined = local.where("__mark IS NOT NULL").join(carry, [*keys, SLICE], "inner")
    return joined.select(*df.columns, F.coalesce("__l", "__c").alias(out))


def lagged(
    df: DataFrame, keys: list[str], out: dict[str, Column], order: tuple[str, ...] = ORD, slice_by: str = "mono_ns", width: int | None = None
) -> DataFrame:
    """Values of the immediately preceding row of the key (null on the first row)."""
    row = F.struct(*[value.alias(name) for name, value in out.items()])
    scanned = running(df, keys, [Scan("__prev", "last", row, inclusive=False)], order, slice_by, width)
    return scanned.select(*df.columns, *[F.col(f"__prev.{name}").alias(name) for name in out])


def positioned(
    df: DataFrame, keys: list[str], out: str = "pos", order: tuple[str, ...] = ORD, slice_by: str = "mono_ns", width: int | None = None
) -> DataFrame:
    """1-based position of each row inside its key."""
    return running(df, keys, [Scan(out, "sum", F.lit(1).cast("bigint"))], order, slice_by, width)


def row_blocks(df: DataFrame, keys: list[str], rows: int, pos: str = "pos", block: int = 100_000) -> DataFrame:
    """Copies of the rows in blocks of ``block`` positions, each led by the ``rows`` rows before it.

    ``__block`` is the partition to run a ROWS frame of at most ``rows`` preceding in;
    keep only rows with ``__home`` afterwards.
    """
    own = F.floor((F.col(pos) - 1) / block).cast("bigint")
    following = F.floor((F.col(pos) - 1 + rows) / block).cast("bigint")
    copied = df.select("*", own.alias("__own"), F.explode(F.sequence(own, following)).alias("__block"))
    return copied.withColumn("__home", F.col("__block") == F.col("__own")).drop("__own")


def time_blocks(df: DataFrame, before_ns: int, after_ns: int, column: str = "mono_ns") -> DataFrame:
    """Copies of the rows in time slices, each with the rows up to ``before_ns`` earlier and ``after_ns`` later."""
    width = max(SLICE_NS, 10 * (before_ns + after_ns))
    at = F.col(column)
    first = F.floor((at - after_ns) / F.lit(width)).cast("bigint")
    last = F.floor((at + before_ns) / F.lit(width)).cast("bigint")
    own = F.floor(at / F.lit(width)).cast("bigint")
    copied = df.select("*", F.explode(F.sequence(first, last)).alias("__block"))
    return copied.withColumn("__home", F.col("__block") == own)
