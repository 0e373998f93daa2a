"""Table schemas. All timestamps are ``timestamp_ntz`` holding UTC wall time."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "asset_id"
TS = "timestamp"
POWER = "active_power_kw"
WIND = "wind_speed_mps"
THEORETICAL = "theoretical_power_kwh"
DIRECTION = "wind_direction_deg"
SEQ = "ingest_seq"
SOURCE_FILE = "ingest_file"

# Raw SCADA export headers and their internal names.
RAW_TO_INTERNAL = {
    "Date/Time": TS,
    "LV ActivePower (kW)": POWER,
    "Wind Speed (m/s)": WIND,
    "Theoretical_Power_Curve (KWh)": THEORETICAL,
    "Wind Direction (°)": DIRECTION,
}
INTERNAL_TO_RAW = {internal: raw for raw, internal in RAW_TO_INTERNAL.items()}

MEASURES = [POWER, WIND, THEORETICAL, DIRECTION]
REQUIRED = [TS, *MEASURES]

# Supported forecast horizons in hours, rated power used for capacity figures.
HORIZONS = (1, 6, 24)
RATED_KW = 3600.0


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


SCADA_SCHEMA = T.StructType(
    [T.StructField(KEY, T.StringType()), T.StructField(TS, T.TimestampNTZType()), *_doubles(MEASURES)]
)

RAW_CSV_SCHEMA = T.StructType(
    [T.StructField("Date/Time", T.StringType()), *_doubles([INTERNAL_TO_RAW[m] for m in MEASURES])]
)

WEATHER_SCHEMA = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField(TS, T.TimestampNTZType()),
        *_doubles(
            ["wind_speed_10m_mps", "wind_speed_100m_mps", "wind_direction_deg", "temperature_c", "pressure_hpa"]
        ),
    ]
)

TEST_OUTPUT_COLUMNS = [
    TS,
    "actual_kw",
    "predicted_kw",
    "p10",
    "p90",
    "baseline_kw",
    "residual_kw",
    "model_id",
    "model_type",
    "horizon_hours",
]

TEST_OUTPUT_SCHEMA = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField(TS, T.TimestampNTZType()),
        *_doubles(TEST_OUTPUT_COLUMNS[1:7]),
        T.StructField("model_id", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("horizon_hours", T.IntegerType()),
    ]
)
