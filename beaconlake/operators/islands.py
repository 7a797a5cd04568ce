"""Bursts, episodes and runs: consecutive rows that belong together.

Every function adds ``island``, the replay position (struct) of the first row
of the island, which with the keys identifies it; rows outside are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.operators.scans import Scan, running, segments, time_blocks
from beaconlake.schema import ORD, ord_col


def _island_of(df: DataFrame, keys: list[str], starts: Column) -> DataFrame:
    return running(df, keys, [Scan("island", "last", F.when(starts, ord_col()))])


def bursts(df: DataFrame, keys: list[str], count: int, window_ns: int) -> DataFrame:
    """Rows inside some window of ``window_ns`` that holds at least ``count`` rows.

    A row is marked when it lies in ``count`` consecutive rows spanning at most the
    window. An island ends at an unmarked row or a hole longer than the window.
    """
    blocks = time_blocks(df, before_ns=2 * window_ns, after_ns=window_ns)
    w = Window.partitionBy(*keys, "__block").orderBy(*ORD)
    opens = F.lead("mono_ns", count - 1).over(w) - F.col("mono_ns") <= window_ns if count > 1 else F.lit(True)
    marked = blocks.withColumn("__opens", F.coalesce(opens, F.lit(False)).cast("int"))
    inside = F.max("__opens").over(w.rowsBetween(1 - count, 0)) == 1
    marked = marked.withColumn("__in", inside)
    fresh = ~F.coalesce(F.lag("__in").over(w), F.lit(False)) | (F.col("mono_ns") - F.lag("mono_ns").over(w) > window_ns)
    home = marked.withColumn("__start", fresh).where(F.col("__home") & F.col("__in"))
    return _island_of(home, keys, F.col("__start")).select(*df.columns, "island")


def episodes(df: DataFrame, keys: list[str], high: Column) -> DataFrame:
    """Maximal runs of rows with ``high``."""
    return segments(df, keys, F.when(high, F.lit(True)), "island")


def runs(df: DataFrame, keys: list[str], signature: Column) -> DataFrame:
    """Consecutive rows of equal non-null signature (``sig``); a null ends a run."""
    return segments(df.withColumn("sig", signature), keys, F.col("sig"), "island")
