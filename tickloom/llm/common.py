"""What several operators share: reading tables, words, keys of rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of every contract: space and \x09 to \x0D.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Stands for a null doc_id where documents are ordered: after all others.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    return F.crc32(key.cast("string")) % divisor


def held_out(key: Column, divisor: int, at: int) -> Column:
    """Rows kept out of learning; a null key is learnt from."""
    return F.coalesce(remainder(key, divisor) == at, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text: bytes.lower and bytes.split know only ASCII."""
    return text.lower().split()


def small(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few whole texts are unpacked at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
