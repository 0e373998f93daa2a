"""Queries that join irregular weather to observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.catalog.base import query
from fleetcast.catalog.testview import scada
from fleetcast.functions.columns import plus_minutes
from fleetcast.operators.asof import as_of, with_weather_as_of
from fleetcast.schemas import KEY, POWER, SEQ, TS, WIND

# Reports at odd minutes, none in some spells and none for one asset; a part of them is sent twice with another value.
_REPORTS = """
    SELECT asset_id, "timestamp" + to_minutes(CAST(ingest_seq % 23 AS BIGINT)) AS seen, wind_speed_mps + again AS speed_mps,
           CASE WHEN ingest_seq % 5 = 0 THEN NULL ELSE ingest_seq % 40 END AS temperature
    FROM (SELECT *, unnest(range(CASE WHEN ingest_seq % 3 = 0 THEN 2 ELSE 1 END)) AS again FROM scada)
    WHERE ingest_seq % 17 < 3 AND ingest_seq % 1200 < 900 AND asset_id <> 'T4'
"""
_NEWEST = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, seen ORDER BY speed_mps DESC, temperature DESC NULLS LAST) AS k
                   FROM ({_REPORTS})) WHERE k = 1
"""


def reports(spark, sf_dir) -> DataFrame:
    seq = F.col(SEQ)
    again = F.explode(F.sequence(F.lit(0), F.when(seq % 3 == 0, 1).otherwise(0)))
    rows = scada(spark, sf_dir).where((seq % 17 < 3) & (seq % 1200 < 900) & (F.col(KEY) != "T4")).withColumn("again", again)
    return rows.select(
        KEY, plus_minutes(F.col(TS), seq % 23).alias(TS), (F.col(WIND) + F.col("again")).alias("speed_mps"),
        F.when(seq % 5 != 0, seq % 40).alias("temperature"),
    )


@query(
    "j3_weather_as_of",
    f"""
    SELECT s.asset_id, s."timestamp", s.active_power_kw, w.seen AS weather_timestamp, w.speed_mps AS weather_speed_mps,
           w.temperature AS weather_temperature
    FROM scada s ASOF LEFT JOIN ({_NEWEST}) w ON s.asset_id = w.asset_id AND s."timestamp" >= w.seen
    """,
    "active_power_kw weather_speed_mps",
)
def weather_as_of(spark, sf_dir):
    return with_weather_as_of(scada(spark, sf_dir).select(KEY, TS, POWER), reports(spark, sf_dir))


@query(
    "j3_recent_weather",
    f"""
    SELECT s.asset_id, s."timestamp", CASE WHEN fresh THEN seen END AS weather_timestamp, CASE WHEN fresh THEN speed_mps END AS weather_speed_mps
    FROM (SELECT s.asset_id, s."timestamp", w.seen, w.speed_mps, epoch_us(s."timestamp") - epoch_us(w.seen) <= 5400000000 AS fresh
          FROM scada s ASOF LEFT JOIN ({_NEWEST}) w ON s.asset_id = w.asset_id AND s."timestamp" > w.seen) s
    """,
    "weather_speed_mps",
)
def recent_weather(spark, sf_dir):
    """Strictly before the observation, and no older than 90 minutes."""
    rows = scada(spark, sf_dir).select(KEY, TS)
    return as_of(rows, reports(spark, sf_dir).drop("temperature"), prefix="weather_", max_age_minutes=90, strict=True)


@query(
    "j3_forecast_weather",
    f"""
    SELECT s.asset_id, s."timestamp", s.active_power_kw, w.seen AS weather_timestamp, w.speed_mps AS weather_speed_mps
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp" DESC) AS k FROM scada) WHERE k <= 36) s
    ASOF LEFT JOIN ({_NEWEST}) w ON s.asset_id = w.asset_id AND s."timestamp" >= w.seen
    """,
    "active_power_kw weather_speed_mps",
)
def forecast_weather(spark, sf_dir):
    """What a forecast request needs: the weather known at each asset's last six hours of rows."""
    newest = Window.partitionBy(KEY).orderBy(F.col(TS).desc())
    rows = scada(spark, sf_dir).select(KEY, TS, POWER).withColumn("k", F.row_number().over(newest)).where("k <= 36").drop("k")
    return with_weather_as_of(rows, reports(spark, sf_dir).drop("temperature"))
