"""Queries that read the given ``events`` table as a stream and run it to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.catalog.base import query
from fleetcast.catalog.forecast_queries import _POWER_SERIES, _ramps_sql
from fleetcast.catalog.testview import dirty_rows, scada, scada_rows, table
from fleetcast.schemas import KEY, POWER, SEQ, TS
from fleetcast.session import new_table_path
from fleetcast.streaming import scada as streams
from fleetcast.streaming.landing import newest, upserting
from fleetcast.streaming.ramps import ramp_runs


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _finished(stream: DataFrame, name: str) -> DataFrame:
    """All available input through the stream into a Parquet table of finished rows."""
    spark = stream.sparkSession
    path = new_table_path(spark, name)
    (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{path}-offsets")
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(path)


def _landed(rows: DataFrame, name: str, spans: int = 6, late_minutes: int = 90):
    """The rows as a stream of many small files, in an order of arrival that lags up to ``late_minutes`` behind their time.

    Files of a later span are written after those of the one before; in a span rows and files are shuffled.
    """
    spark = rows.sparkSession
    path = new_table_path(spark, name)
    late = F.make_dt_interval(mins=F.pmod(F.xxhash64(SEQ), F.lit(late_minutes)).cast("int"))
    arrival = F.unix_micros((F.col(TS) + late).cast("timestamp"))
    first, last = rows.agg(F.min(arrival), F.max(arrival)).first()
    width = ((last or 0) - (first or 0)) // spans + 1
    parted, staged = rows.withColumn("_span", F.floor((arrival - F.lit(first or 0)) / width)), new_table_path(spark, f"{name}-spans")
    parted.write.partitionBy("_span").parquet(staged)  # a span then reads its own rows only
    spanned = spark.read.schema(parted.schema).parquet(staged)
    for k in range(spans):
        spanned.where(F.col("_span") == k).drop("_span").repartition(5, F.xxhash64(SEQ, F.lit(7))).write.mode("append").parquet(path)
    _closed(rows).where(F.col(KEY) == CLOSING).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _upserted(stream: DataFrame, name: str, *keys: str) -> DataFrame:
    """The newest version of a table of running figures, after all available input."""
    spark = stream.sparkSession
    path = new_table_path(spark, name)
    (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}-offsets")
        .trigger(availableNow=True)
        .foreachBatch(upserting(path, keys))
        .start()
        .awaitTermination()
    )
    return newest(spark, path, stream.schema)


CLOSING = "closing"


def _closed(rows: DataFrame) -> DataFrame:
    """The rows, and one of another asset, long after them, made from the first event."""
    first = (F.col(SEQ) == 0).cast("int")
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), first)))
    late = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
    return copies.withColumns(
        {KEY: F.when(F.col("_copy") == 1, F.lit(CLOSING)).otherwise(F.col(KEY)), TS: F.when(F.col("_copy") == 1, late).otherwise(F.col(TS))}
    ).drop("_copy")


def _wall_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("x1_stream_dedup", 'SELECT DISTINCT asset_id, "timestamp" FROM dirty')
def stream_dedup(spark, sf_dir):
    rows = streams.deduplicated(dirty_rows(scada_rows(_events(spark, sf_dir))))
    return _wall_time(_finished(rows.select(KEY, TS), "dedup"), TS)


@query(
    "x2_stream_hourly",
    """
    SELECT asset_id, date_trunc('hour', "timestamp") AS window_start, count(*) AS rows,
           avg(active_power_kw) AS mean_power_kw, avg(wind_speed_mps) AS mean_wind_mps
    FROM scada
    GROUP BY asset_id, date_trunc('hour', "timestamp")
    """,
    "mean_power_kw mean_wind_mps",
)
def stream_hourly(spark, sf_dir):
    """All hours: a closing row of another asset moves the watermark past the last one."""
    hourly = streams.tumbling(_closed(scada_rows(_events(spark, sf_dir))))
    return _wall_time(_finished(hourly, "hourly"), "window_start").where(F.col(KEY) != CLOSING)


@query(
    "x3_stream_ramps",
    f"""
    SELECT asset_id, start_time, end_time, power_before_kw, power_after_kw, duration_minutes//10 - 1 AS steps,
           power_change_kw, direction, risk_level
    FROM ({_ramps_sql(_POWER_SERIES)}) r
    """,
    "power_before_kw power_after_kw power_change_kw",
)
def stream_ramps(spark, sf_dir):
    """All runs, from many files whose rows come up to 90 minutes late, in micro-batches of a few files. Those still open at the last
    row are closed when the watermark has passed them."""
    landed = _landed(scada(spark, sf_dir).select(KEY, TS, POWER, SEQ), "landed")
    runs = ramp_runs(landed, lateness="2 hours", bucket="1 day")
    return _wall_time(_finished(runs, "ramps"), "start_time", "end_time")


@query(
    "x4_stream_quality",
    """
    SELECT asset_id, count(*) AS rows, CAST(0 AS BIGINT) AS invalid_timestamp,
           count(CASE WHEN active_power_kw < 0 THEN 1 END) AS invalid_power,
           count(CASE WHEN wind_speed_mps IS NULL THEN 1 END) AS invalid_wind_speed,
           CAST(0 AS BIGINT) AS invalid_theoretical,
           count(CASE WHEN wind_direction_deg < 0 THEN 1 END) AS invalid_direction
    FROM dirty GROUP BY asset_id
    """,
)
def stream_quality(spark, sf_dir):
    return _upserted(streams.quality_counts(dirty_rows(scada_rows(_events(spark, sf_dir)))), "quality", KEY)
