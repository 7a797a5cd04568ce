"""Shared pieces of the corpus operators.

Word: a run of characters other than space and the control characters
U+0009 to U+000D. A null text is read as the empty text everywhere.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import beaconlake
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, readable from every executor, lineage cut.

    Each call takes a new folder below ``spark.checkpoint.dir``; the caller of the job clears that folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. Only texts that are all ASCII may take the engine's own lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def text_hash(column: str = "text") -> Column:
    return F.xxhash64(text_of(column))


def learnable(column: str = "doc_id") -> Column:
    """Rows whose labels may be learnt from: the CRC-32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 != 2, F.lit(False))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, the way Spark ships a user's modules."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(beaconlake.__file__).parent
    if root.is_dir():
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as pack:
            for file in sorted(root.rglob("*.py")):
                pack.write(file, str(file.relative_to(root.parent)))
        handle, path = tempfile.mkstemp(prefix="beaconlake-", suffix=".zip")
        with os.fdopen(handle, "wb") as out:
            out.write(held.getvalue())
        context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
