"""Queries over sources, cleaning and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.catalog.base import query
from fleetcast.catalog.testview import dirty_scada, scada, table
from fleetcast.functions.columns import null_if_nan, parsed_timestamp, plus_minutes, wrapped_direction
from fleetcast.operators import cleaning, quality
from fleetcast.schemas import KEY, MEASURES, POWER, SEQ, SOURCE_FILE, TS, WIND
from fleetcast.session import new_table_path
from fleetcast.sources import scada as source

MEASURE_LIST = "active_power_kw wind_speed_mps theoretical_power_kwh wind_direction_deg"
ALL_COLUMNS = 'asset_id, "timestamp", active_power_kw, wind_speed_mps, theoretical_power_kwh, wind_direction_deg'


@query("s1_csv_read", f"SELECT {ALL_COLUMNS} FROM scada", MEASURE_LIST)
def csv_read(spark, sf_dir):
    path = new_table_path(spark, "raw-csv")
    source.save_observations(scada(spark, sf_dir), path, "dd MM yyyy HH:mm")
    return source.ingest(spark, path).select(KEY, TS, *MEASURES)


@query("s2_rename_raw", f"SELECT {ALL_COLUMNS} FROM scada", MEASURE_LIST)
def rename_raw(spark, sf_dir):
    raw = cleaning.restore_raw(scada(spark, sf_dir))
    return cleaning.rename_raw(raw).select(KEY, TS, *MEASURES)


@query(
    "s3_parse_timestamps",
    """
    SELECT event_id, CASE event_id%4 WHEN 0 THEN date_trunc('minute', ts) WHEN 3 THEN NULL
                     ELSE date_trunc('second', ts) END AS "timestamp" FROM events
    """,
)
def parse_timestamps(spark, sf_dir):
    text = (
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "dd MM yyyy HH:mm"))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.lit("not a time"))
    )
    return table(spark, sf_dir, "events").select("event_id", parsed_timestamp(text).alias(TS))


@query("s4_parquet_by_asset", f"SELECT {ALL_COLUMNS}, split FROM sp", MEASURE_LIST)
def parquet_by_asset(spark, sf_dir):
    from fleetcast.operators.splits import row_split
    from fleetcast.operators.timeline import with_row_index

    path = new_table_path(spark, "observations")
    rows = row_split(with_row_index(scada(spark, sf_dir)))
    source.write_table(rows.select(KEY, TS, *MEASURES, "split"), path, KEY, "split")
    return source.read_table(spark, path)


@query(
    "s5a_load_observations",
    f"""
    SELECT {ALL_COLUMNS} FROM scada WHERE asset_id = 'T1'
      AND "timestamp" >= TIMESTAMP '2018-01-01 06:00:00' AND "timestamp" < TIMESTAMP '2018-01-12 00:00:00'
    """,
    MEASURE_LIST,
)
def load_observations(spark, sf_dir):
    rows = source.load_observations(scada(spark, sf_dir), "T1", "2018-01-01 06:00:00", "2018-01-12 00:00:00")
    return rows.select(KEY, TS, *MEASURES)


@query("s5b_save_observations", f"SELECT {ALL_COLUMNS} FROM scada", MEASURE_LIST)
def save_observations(spark, sf_dir):
    path = new_table_path(spark, "saved-csv")
    source.save_observations(scada(spark, sf_dir), path)
    return source.ingest(spark, path).select(KEY, TS, *MEASURES)


@query("s5c_available_assets", "SELECT DISTINCT asset_id FROM scada")
def available_assets(spark, sf_dir):
    return source.available_assets(scada(spark, sf_dir))


@query(
    "s5d_time_ranges",
    'SELECT asset_id, min("timestamp") AS start_time, max("timestamp") AS end_time FROM scada GROUP BY asset_id',
)
def time_ranges(spark, sf_dir):
    return source.time_ranges(scada(spark, sf_dir))


@query("s11_records_to_table", f"SELECT {ALL_COLUMNS} FROM scada", MEASURE_LIST)
def records_to_table(spark, sf_dir):
    record = F.to_json(F.struct(KEY, F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(TS), *MEASURES))
    records = scada(spark, sf_dir).select(record.alias("record"), SEQ)
    return source.observations_from_json(records).select(KEY, TS, *MEASURES)


@query(
    "p1_required_columns",
    'SELECT "timestamp", active_power_kw, wind_speed_mps, theoretical_power_kwh, wind_direction_deg FROM scada',
    MEASURE_LIST,
)
def required_columns(spark, sf_dir):
    return scada(spark, sf_dir).select(TS, *MEASURES)


@query(
    "p2_direction_mod",
    """
    SELECT asset_id, ingest_seq, CASE WHEN wind_direction_deg < 0 THEN wind_direction_deg + 36e1
           WHEN wind_direction_deg >= 36e1 THEN wind_direction_deg - 36e1 ELSE wind_direction_deg END
           AS wind_direction_deg FROM dirty
    """,
    "wind_direction_deg",
)
def direction_mod(spark, sf_dir):
    rows = dirty_scada(spark, sf_dir)
    return rows.select(KEY, SEQ, wrapped_direction(F.col("wind_direction_deg")).alias("wind_direction_deg"))


@query(
    "p10_drop_incomplete",
    "SELECT asset_id, ingest_seq, active_power_kw, wind_speed_mps FROM dirty WHERE wind_speed_mps IS NOT NULL",
    "active_power_kw wind_speed_mps",
)
def drop_incomplete(spark, sf_dir):
    return dirty_scada(spark, sf_dir).select(KEY, SEQ, POWER, WIND).dropna("any")


@query(
    "p16_row_contract",
    """
    SELECT asset_id, ingest_seq, true AS valid_timestamp, active_power_kw >= 0 AS valid_power,
           coalesce(wind_speed_mps >= 0, false) AS valid_wind_speed, theoretical_power_kwh >= 0 AS valid_theoretical,
           wind_direction_deg >= 0 AND wind_direction_deg < 360 AS valid_direction,
           active_power_kw >= 0 AND coalesce(wind_speed_mps >= 0, false) AND theoretical_power_kwh >= 0
             AND wind_direction_deg >= 0 AND wind_direction_deg < 360 AS valid
    FROM dirty
    """,
)
def row_contract(spark, sf_dir):
    return cleaning.with_contract(dirty_scada(spark, sf_dir)).drop(TS, *MEASURES)


@query(
    "f1_normalise",
    f"""
    SELECT asset_id, "timestamp", ingest_seq, active_power_kw, wind_speed_mps, theoretical_power_kwh,
           CASE WHEN wind_direction_deg < 0 THEN wind_direction_deg + 36e1 ELSE wind_direction_deg END
             AS wind_direction_deg
    FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, "timestamp" ORDER BY ingest_seq DESC) AS k FROM dirty)
    WHERE k = 1
    """,
    MEASURE_LIST,
)
def normalise(spark, sf_dir):
    return cleaning.normalise(dirty_scada(spark, sf_dir))


@query(
    "w9_dedup_keep_first",
    f"""
    SELECT {ALL_COLUMNS}, ingest_seq
    FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, "timestamp" ORDER BY ingest_seq) AS k FROM dirty)
    WHERE k = 1
    """,
    MEASURE_LIST,
)
def dedup_keep_first(spark, sf_dir):
    return cleaning.drop_repeats(dirty_scada(spark, sf_dir), "first")


@query(
    "w9_dedup_keep_last",
    f"""
    SELECT {ALL_COLUMNS}, ingest_seq
    FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, "timestamp" ORDER BY ingest_seq DESC) AS k FROM dirty)
    WHERE k = 1
    """,
    MEASURE_LIST,
)
def dedup_keep_last(spark, sf_dir):
    return cleaning.drop_repeats(dirty_scada(spark, sf_dir), "last")


def _arrival(order: str) -> str:
    return f"""
    SELECT asset_id, CAST(sum(CASE WHEN "timestamp" = previous THEN 1 ELSE 0 END) AS BIGINT) AS repeats_in_arrival,
           CAST(sum(CASE WHEN "timestamp" < previous THEN 1 ELSE 0 END) AS BIGINT) AS steps_back
    FROM (SELECT *, lag("timestamp") OVER (PARTITION BY asset_id ORDER BY {order}) AS previous FROM dirty)
    GROUP BY asset_id
"""


_ARRIVAL = _arrival("ingest_seq")
# Files of 1,500 lines, numbered from 0 in each; the second of each two is named, and so arrives, before the first.
_BY_FILE = _arrival("CASE WHEN (ingest_seq // 1500) % 2 = 0 THEN ingest_seq // 1500 + 1 ELSE ingest_seq // 1500 - 1 END, ingest_seq % 1500")


def filed_scada(spark, sf_dir):
    """The dirty rows in several files an asset, whose lines are numbered from 0."""
    file = F.floor(F.col(SEQ) / 1500).cast("long")
    name = F.when(file % 2 == 0, file + 1).otherwise(file - 1)
    path = F.concat(F.lit("part-"), F.lpad(name.cast("string"), 12, "0"), F.lit(".csv"))
    return dirty_scada(spark, sf_dir).withColumns({SOURCE_FILE: path, SEQ: F.col(SEQ) % 1500})


@query("w8_arrival_order", _ARRIVAL)
def arrival_order(spark, sf_dir):
    return quality.arrival_order(dirty_scada(spark, sf_dir))


@query("w8_arrival_over_files", _BY_FILE)
def arrival_over_files(spark, sf_dir):
    return quality.arrival_order(filed_scada(spark, sf_dir))


def _report_sql(arrival: str) -> str:
    return f"""
    SELECT d.asset_id, count(*) AS total_records, count(*) - count(DISTINCT "timestamp") AS duplicate_timestamps,
           min("timestamp") AS start_time, max("timestamp") AS end_time,
           CAST(sum(CASE WHEN active_power_kw IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_active_power_kw,
           CAST(sum(CASE WHEN wind_speed_mps IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_wind_speed_mps,
           CAST(sum(CASE WHEN wind_speed_mps < 0 THEN 1 ELSE 0 END) AS BIGINT) AS wind_speed_mps_negative,
           CAST(sum(CASE WHEN wind_direction_deg < 0 OR wind_direction_deg >= 360 THEN 1 ELSE 0 END) AS BIGINT)
             AS wind_direction_out_of_range,
           CAST(sum(CASE WHEN active_power_kw < 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_power_negative,
           max(repeats_in_arrival + steps_back) = 0 AS monotonic
    FROM dirty d JOIN ({arrival}) a ON a.asset_id = d.asset_id GROUP BY d.asset_id
"""


_REPORT = _report_sql(_ARRIVAL)


def _shown(report):
    return report.select(
        *[c for c in report.columns if c not in ("missing_counts", "range_violations")],
        *[F.col("missing_counts")[c].alias(f"missing_{c}") for c in (POWER, WIND)],
        *[
            F.col("range_violations")[c].alias(c)
            for c in ("wind_speed_mps_negative", "wind_direction_out_of_range", "active_power_negative")
        ],
    )


@query("a1_quality_report", _REPORT)
def quality_report(spark, sf_dir):
    return _shown(quality.quality_report(dirty_scada(spark, sf_dir)))


@query("a1_report_over_files", _report_sql(_BY_FILE))
def report_over_files(spark, sf_dir):
    return _shown(quality.quality_report(filed_scada(spark, sf_dir)))


_ISSUES = f"""
    SELECT asset_id, field, "check", message, "count", severity FROM (
      SELECT r.asset_id, 'timestamp' AS field, 'monotonic' AS "check",
             'Timestamps are not strictly monotonic' AS message, duplicate_timestamps + 1 AS "count",
             'warning' AS severity, steps_back > 0 AS present FROM rep r JOIN arr a ON a.asset_id = r.asset_id
      UNION ALL
      SELECT asset_id, 'timestamp', 'duplicates',
             concat('Found ', CAST(duplicate_timestamps AS VARCHAR), ' duplicate timestamps'),
             duplicate_timestamps, 'warning', duplicate_timestamps > 0 FROM rep
      UNION ALL
      SELECT asset_id, 'active_power_kw', 'range', 'Values outside valid range [0.0, None]',
             active_power_negative, 'warning', active_power_negative > 0 FROM rep
      UNION ALL
      SELECT asset_id, 'wind_direction_deg', 'range', 'Values outside valid range [0.0, 360.0]',
             wind_direction_out_of_range, 'warning', wind_direction_out_of_range > 0 FROM rep)
    WHERE present
"""


@query("a2_validation_issues", f", rep AS ({_REPORT}), arr AS ({_ARRIVAL}) {_ISSUES}")
def validation_issues(spark, sf_dir):
    return quality.validation_issues(dirty_scada(spark, sf_dir))


@query("a2_issues_over_files", f", rep AS ({_report_sql(_BY_FILE)}), arr AS ({_BY_FILE}) {_ISSUES}")
def issues_over_files(spark, sf_dir):
    return quality.validation_issues(filed_scada(spark, sf_dir))


@query(
    "a2_validation_summary",
    f"""
    , rep AS ({_REPORT}), arr AS ({_ARRIVAL}), iss AS ({_ISSUES})
    SELECT asset_id, CAST(0 AS BIGINT) AS n_errors, count(*) AS n_warnings, count(*) = 0 AS passed
    FROM iss GROUP BY asset_id
    """,
)
def validation_summary(spark, sf_dir):
    return quality.validation_summary(dirty_scada(spark, sf_dir), strict=True)


@query(
    "a3_data_summary",
    """
    SELECT asset_id, count(*) AS total_records, min("timestamp") AS start_time, max("timestamp") AS end_time,
           avg(active_power_kw) AS power_mean, min(active_power_kw) AS power_min, max(active_power_kw) AS power_max,
           avg(wind_speed_mps) AS wind_mean, min(wind_speed_mps) AS wind_min, max(wind_speed_mps) AS wind_max
    FROM dirty GROUP BY asset_id
    """,
    "power_mean power_min power_max wind_mean wind_min wind_max",
)
def data_summary(spark, sf_dir):
    return quality.data_summary(dirty_scada(spark, sf_dir))


@query(
    "a4_record_summary",
    """
    SELECT asset_id, count(*) AS records, min("timestamp") AS start_time, max("timestamp") AS end_time,
           count(*) - count("timestamp") AS missing_timestamp,
           count(*) - count(active_power_kw) AS missing_active_power_kw,
           count(*) - count(wind_speed_mps) AS missing_wind_speed_mps,
           count(*) - count(theoretical_power_kwh) AS missing_theoretical_power_kwh,
           count(*) - count(wind_direction_deg) AS missing_wind_direction_deg
    FROM dirty GROUP BY asset_id
    """,
)
def record_summary(spark, sf_dir):
    return quality.record_summary(dirty_scada(spark, sf_dir))


@query(
    "k4_missingness",
    """
    SELECT asset_id, CAST("timestamp" AS DATE) AS day, count(*) AS rows,
           count(*) - count(active_power_kw) AS missing_active_power_kw,
           count(*) - count(wind_speed_mps) AS missing_wind_speed_mps,
           count(*) - count(theoretical_power_kwh) AS missing_theoretical_power_kwh,
           count(*) - count(wind_direction_deg) AS missing_wind_direction_deg,
           CAST(coalesce(sum(greatest((epoch_us("timestamp") - epoch_us(previous)) // 600000000 - 1, 0)), 0) AS BIGINT)
             AS missing_steps
    FROM (SELECT *, lag("timestamp") OVER (PARTITION BY asset_id ORDER BY "timestamp") AS previous
          FROM (SELECT * REPLACE ("timestamp" + to_minutes(30*(epoch_us("timestamp") // 30000000000)) AS "timestamp") FROM dirty
                QUALIFY row_number() OVER (PARTITION BY asset_id, "timestamp" ORDER BY ingest_seq DESC) = 1))
    GROUP BY asset_id, CAST("timestamp" AS DATE)
    """,
)
def missingness(spark, sf_dir):
    """All rows, repeats included, with three steps missing after every fifty."""
    rows = dirty_scada(spark, sf_dir)
    fifties = F.floor(F.unix_micros(F.col(TS).cast("timestamp")) / 30_000_000_000)
    return quality.missingness(rows.withColumn(TS, plus_minutes(F.col(TS), 30 * fifties)))


@query(
    "p14_nan_to_null",
    'SELECT asset_id, "timestamp", CASE WHEN ingest_seq%5 <> 0 THEN active_power_kw END AS active_power_kw FROM scada',
    "active_power_kw",
)
def nan_to_null(spark, sf_dir):
    value = F.when(F.col(SEQ) % 5 == 0, F.lit(float("nan"))).otherwise(F.col(POWER))
    return scada(spark, sf_dir).select(KEY, TS, null_if_nan(value).alias(POWER))
