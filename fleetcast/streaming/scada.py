"""Streams of SCADA rows: deduplication, tumbling aggregates and live quality counts.

The sources need a ``timestamp`` column of type ``timestamp`` (event time). Late rows beyond the
watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.operators.cleaning import contract_flags
from fleetcast.schemas import KEY, POWER, TS, WIND

LATENESS = "1 hour"


def event_time(df: DataFrame) -> DataFrame:
    return df.withColumn(TS, F.col(TS).cast("timestamp"))


def deduplicated(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The first arrival of each (asset, timestamp)."""
    return event_time(stream).withWatermark(TS, lateness).dropDuplicatesWithinWatermark([KEY, TS])


def tumbling(stream: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Rows, mean power and mean wind per asset and window."""
    return (
        event_time(stream)
        .withWatermark(TS, lateness)
        .groupBy(F.window(TS, width).alias("w"), KEY)
        .agg(F.count("*").alias("rows"), F.avg(POWER).alias("mean_power_kw"), F.avg(WIND).alias("mean_wind_mps"))
        .select(KEY, F.col("w.start").alias("window_start"), "rows", "mean_power_kw", "mean_wind_mps")
    )


def quality_counts(stream: DataFrame) -> DataFrame:
    """Rows and broken bounds per asset so far; for update mode and the sink ``landing.upserting``."""
    flags = contract_flags()
    return stream.groupBy(KEY).agg(
        F.count("*").alias("rows"), *[F.count_if(~c).alias(name.replace("valid", "invalid")) for name, c in flags.items()]
    )
