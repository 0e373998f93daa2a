"""Renaming, parsing, deduplication and row contracts of SCADA rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.functions.columns import null_if_nan, parsed_timestamp, wrapped_direction
from fleetcast.schemas import (
    DIRECTION,
    INTERNAL_TO_RAW,
    KEY,
    MEASURES,
    POWER,
    RAW_TO_INTERNAL,
    REQUIRED,
    SEQ,
    SOURCE_FILE,
    THEORETICAL,
    TS,
    WIND,
)


def rename_raw(df: DataFrame, strict: bool = True) -> DataFrame:
    """Internal names for the raw headers that exist; ``strict`` insists on all five columns."""
    renamed = df.withColumnsRenamed(RAW_TO_INTERNAL)
    missing = sorted(set(REQUIRED) - set(renamed.columns))
    if strict and missing:
        raise ValueError(f"the table lacks these SCADA columns: {missing}")
    return renamed


def restore_raw(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(INTERNAL_TO_RAW)


def parse_timestamps(df: DataFrame) -> DataFrame:
    if isinstance(df.schema[TS].dataType, T.StringType):
        return df.withColumn(TS, parsed_timestamp(F.col(TS)))
    return df.withColumn(TS, F.col(TS).cast("timestamp_ntz"))


def drop_repeats(df: DataFrame, keep: str = "last") -> DataFrame:
    """One row per (asset, timestamp), the first or last by ``ingest_seq``, within ``ingest_file`` where there is one.

    An aggregate rather than ``row_number``: copies are combined before the shuffle, so a timestamp
    that was sent a billion times costs no task more than one row.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    pick, end = (F.max_by, F.max) if keep == "last" else (F.min_by, F.min)
    others = [c for c in df.columns if c not in (KEY, TS, SEQ, SOURCE_FILE)]
    if SOURCE_FILE in df.columns:
        # lines are numbered per file: the file comes first, and one row is picked whole
        order = F.struct(SOURCE_FILE, SEQ)
        picked = df.groupBy(KEY, TS).agg(pick(F.struct(*others, SEQ), order).alias("_row"))
        return picked.select(KEY, TS, *[F.col(f"_row.{c}").alias(c) for c in (*others, SEQ)])
    return df.groupBy(KEY, TS).agg(*[pick(c, SEQ).alias(c) for c in others], end(SEQ).alias(SEQ))


def normalise(df: DataFrame, keep: str = "last") -> DataFrame:
    """names, timestamps, direction modulo 360, one row per timestamp."""
    rows = parse_timestamps(rename_raw(df))
    order = [c for c in (SOURCE_FILE, SEQ) if c in rows.columns]
    rows = rows.select(KEY, TS, *[null_if_nan(F.col(c).cast("double")).alias(c) for c in MEASURES], *order)
    return drop_repeats(rows.withColumn(DIRECTION, wrapped_direction(F.col(DIRECTION))), keep)


def sorted_rows(df: DataFrame) -> DataFrame:
    """O1: a total order over the fleet by range partitioning."""
    return df.orderBy(KEY, TS)


def contract_flags() -> dict[str, Column]:
    """The bounds of one observation; a missing value breaks its bound."""

    def bounded(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return {
        "valid_timestamp": F.col(TS).isNotNull(),
        "valid_power": bounded((F.col(POWER) >= 0) & ~F.isnan(POWER)),
        "valid_wind_speed": bounded((F.col(WIND) >= 0) & ~F.isnan(WIND)),
        "valid_theoretical": bounded((F.col(THEORETICAL) >= 0) & ~F.isnan(THEORETICAL)),
        "valid_direction": bounded((F.col(DIRECTION) >= 0) & (F.col(DIRECTION) < 360)),
    }


def with_contract(df: DataFrame) -> DataFrame:
    flags = contract_flags()
    every = None
    for c in flags.values():
        every = c if every is None else every & c
    return df.withColumns({**flags, "valid": every})


def split_by_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that keep the contract, and the quarantined rest with its flags."""
    flagged = with_contract(df)
    return flagged.where("valid").select(*df.columns), flagged.where("NOT valid")
