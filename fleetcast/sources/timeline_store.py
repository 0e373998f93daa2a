"""Timelines numbered, cut into chunks and stored once.

The rows of a chunk lie in one bucket, with copies of the neighbouring rows that windows reach, so windows along the timeline are
computed without a scan for the numbers and without an exchange. Files are sorted by asset, chunk and row: a filter on asset and time
passes over most of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.operators.timeline import CHUNK, CHUNK_ROWS, ROW, chunk_of, chunked, stored_reach
from fleetcast.schemas import KEY

#: Rows that windows may reach back (a day of 10-minute rows and a rolling mean before it) and ahead (a day).
BACK, AHEAD, BUCKETS = 160, 150, 32


def store_timeline(
    indexed: DataFrame, table: str, path: str, back: int = BACK, ahead: int = AHEAD, chunk_rows: int = CHUNK_ROWS, buckets: int = BUCKETS
) -> DataFrame:
    """Writes numbered rows (``with_row_index``) as the bucketed table ``table`` under ``path``, and returns its chunks.

    The number of buckets should be that of the cores times a few; one holds many chunks, so a hot asset fills all of them evenly.
    """
    reach = {"back": back, "ahead": ahead, "chunk_rows": chunk_rows}
    rows = chunked(indexed, back, ahead, chunk_rows).withMetadata(CHUNK, reach)
    (
        rows.repartition(buckets, KEY, CHUNK)
        .write.bucketBy(buckets, KEY, CHUNK)
        .sortBy(KEY, CHUNK, ROW)
        .option("path", path)
        .mode("overwrite")
        .saveAsTable(table)
    )
    return stored_chunks(indexed.sparkSession, table)


def stored_chunks(spark: SparkSession, table: str) -> DataFrame:
    """The chunks with their copies, for functions that go along the timeline (``along_timeline`` and what is built on it)."""
    return spark.table(table)


def stored_rows(spark: SparkSession, table: str) -> DataFrame:
    """Each row once, numbered, for everything else; filters on asset and time reach the scan."""
    rows = spark.table(table)
    size = stored_reach(rows)["chunk_rows"]
    return rows.where(F.col(CHUNK) == chunk_of(F.col(ROW), size)).drop(CHUNK)
