"""Reading and writing SCADA tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.operators.cleaning import normalise, restore_raw
from fleetcast.schemas import KEY, MEASURES, RAW_CSV_SCHEMA, REQUIRED, SCADA_SCHEMA, SEQ, SOURCE_FILE, TS

_PAGE = 4096


def _line_order() -> Column:
    """A number that grows along the lines of a file, also when the file is read in several blocks.

    High bits: where the block starts in the file; low 33 bits: the row's place in its task.
    """
    block = F.floor(F.col("_metadata.file_block_start") / _PAGE).cast("long")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return F.shiftleft(block, 33) + place


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw export files, one asset per file (``T1.csv``) or per folder (``asset_id=T1/``)."""
    raw = spark.read.schema(RAW_CSV_SCHEMA).option("header", True).csv(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"asset_id=([^/]+)/", 1)
    asset = F.when(folder != "", folder).otherwise(stem)
    return raw.withColumns({KEY: asset, SOURCE_FILE: F.col("_metadata.file_path"), SEQ: _line_order()})


def ingest(spark: SparkSession, path: str, keep: str = "first") -> DataFrame:
    """S1 + F1: raw files to clean rows; of repeated timestamps the first line is kept, files in the order of their paths."""
    return normalise(read_raw_csv(spark, path), keep)


def write_table(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    """Parquet by asset (and split). Rows of one asset may fill any number of files."""
    df.write.mode(mode).partitionBy(*(partitions or (KEY,))).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_observations(df: DataFrame, asset_id: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One asset's rows in ``[start, end)``; both filters reach the scan."""
    rows = df.where(F.col(KEY) == asset_id)
    if start is not None:
        rows = rows.where(F.col(TS) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col(TS) < F.lit(end).cast("timestamp_ntz"))
    return rows


def save_observations(df: DataFrame, path: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> None:
    """CSV with the raw headers, a folder per asset."""
    stamped = df.select(KEY, F.date_format(TS, timestamp_format).alias(TS), *MEASURES)
    restore_raw(stamped).write.mode("overwrite").partitionBy(KEY).option("header", True).csv(path)


def available_assets(df: DataFrame) -> DataFrame:
    """S5c."""
    return df.select(KEY).distinct()


def time_ranges(df: DataFrame) -> DataFrame:
    """S5d."""
    return df.groupBy(KEY).agg(F.min(TS).alias("start_time"), F.max(TS).alias("end_time"))


def observations_from_json(records: DataFrame, column: str = "record") -> DataFrame:
    """Observation records as JSON text to a clean table."""
    fields = [T.StructField(TS, T.StringType()), *[f for f in SCADA_SCHEMA.fields if f.name != TS]]
    parsed = records.select(F.from_json(column, T.StructType(fields)).alias("r"), SEQ)
    return normalise(parsed.select("r.*", SEQ))


def observations_from_records(spark: SparkSession, asset_id: str, records: list[dict]) -> DataFrame:
    """S11 for the few records of one request."""
    ordered = [(asset_id, *[r[c] for c in REQUIRED], i) for i, r in enumerate(records)]
    fields = [SCADA_SCHEMA[KEY], SCADA_SCHEMA[TS], *[SCADA_SCHEMA[m] for m in MEASURES]]
    schema = T.StructType([*fields, T.StructField(SEQ, T.LongType())])
    return normalise(spark.createDataFrame(ordered, schema))
