"""A SCADA table derived from the given ``events`` table: 4 assets, gap-free 10-minute rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetcast.schemas import KEY, MEASURES, SEQ, TS

_SCADA = """
SELECT {ts} AS timestamp, asset_id, ws AS wind_speed_mps, tp AS theoretical_power_kwh,
       tp*(7e-1+5e-2*m) AS active_power_kw, wind_direction_deg, event_id AS ingest_seq
FROM (SELECT *, least(36e2, greatest(0e0, 5e0*(ws-3e0)*(ws-3e0)*(ws-3e0))) AS tp FROM
 (SELECT *, 3e0 + 9e0*CAST(abs(seq%288-144) AS DOUBLE)/144e0 + value/1e2 AS ws FROM
  (SELECT concat('T', CAST(event_id%4+1 AS {string})) AS asset_id,
          CAST((event_id-event_id%4)/4 AS BIGINT) AS seq, event_id%7 AS m,
          CAST((user_id*37+event_id)%360 AS DOUBLE) AS wind_direction_deg, value, event_id
   FROM {events}) a) b) c
"""

SPARK_SCADA = _SCADA.format(
    ts="timestamp_ntz'2018-01-01 00:00:00' + make_dt_interval(0,0,CAST(10*seq AS INT))",
    string="STRING",
    events="{events}",
)
SQL_SCADA = _SCADA.format(
    ts="TIMESTAMP '2018-01-01 00:00:00' + to_minutes(CAST(10*seq AS BIGINT))", string="VARCHAR", events="events"
).replace("AS timestamp,", 'AS "timestamp",')

# Faults on purpose: repeated rows, late rows, directions below 0, negative power, missing wind speed.
_DIRTY = """
SELECT asset_id, timestamp, 4*ingest_seq + copy + CASE WHEN ingest_seq%103 = 0 THEN 162 ELSE 0 END AS ingest_seq,
       CASE WHEN ingest_seq%89 = 0 THEN -1e0 ELSE active_power_kw + copy END AS active_power_kw,
       CASE WHEN ingest_seq%113 = 0 THEN NULL ELSE wind_speed_mps END AS wind_speed_mps,
       theoretical_power_kwh,
       CASE WHEN ingest_seq%101 = 0 THEN -5e0 ELSE wind_direction_deg END AS wind_direction_deg
FROM (SELECT *, {copies} AS copy FROM scada)
"""
SPARK_DIRTY = _DIRTY.format(copies="explode(sequence(0, if(ingest_seq%97 = 0, 1, 0)))")
SQL_DIRTY = _DIRTY.format(copies="unnest(range(CASE WHEN ingest_seq%97 = 0 THEN 2 ELSE 1 END))").replace(
    "asset_id, timestamp,", 'asset_id, "timestamp",'
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scada_rows(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(SPARK_SCADA, events=events)


def dirty_rows(clean: DataFrame) -> DataFrame:
    rows = clean.sparkSession.sql(SPARK_DIRTY.replace("FROM scada", "FROM {scada}"), scada=clean)
    return rows.select(KEY, TS, SEQ, *MEASURES)


def scada(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows, with ``ingest_seq`` giving the order of arrival."""
    return scada_rows(table(spark, sf_dir, "events"))


def dirty_scada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_rows(scada(spark, sf_dir))
