"""The events table: what a recording becomes once it is ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from beaconlake.schema import ORD
from beaconlake.session import short_methods


def write_events(events: DataFrame, path: str, mode: str = "errorifexists", ranged: bool = False) -> None:
    """Events partitioned by recording and ranged by time (``ranged``: they already are).

    A reader touches only the recordings, columns and attribute members it uses,
    and skips files by their time and type statistics.
    """
    dealt = events if ranged else events.repartitionByRange("recording_id", "mono_ns")
    with short_methods(events.sparkSession):
        dealt.sortWithinPartitions("recording_id", *ORD).write.mode(mode).partitionBy("recording_id").parquet(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The given schema keeps recording ids texts, whatever they look like."""
    return spark.read.schema(schema).parquet(path)
