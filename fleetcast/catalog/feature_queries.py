"""Queries over projections, windows, feature frames and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.catalog.base import TABLES, query
from fleetcast.catalog.testview import dirty_scada, scada
from fleetcast.functions import columns as cols
from fleetcast.operators import cleaning, features, splits
from fleetcast.operators.timeline import ROW, TOTAL, along_timeline, last_rows, with_row_index
from fleetcast.plans import backtest
from fleetcast.schemas import KEY, MEASURES, POWER, SEQ, TS, WIND
from fleetcast.session import new_table_path
from fleetcast.sources.scada import load_observations
from fleetcast.sources.timeline_store import store_timeline, stored_rows


def indexed(spark, sf_dir):
    return with_row_index(scada(spark, sf_dir))


@query(
    "p3_direction_features",
    """
    SELECT asset_id, "timestamp", sin(radians(wind_direction_deg)) AS wind_direction_sin,
           cos(radians(wind_direction_deg)) AS wind_direction_cos FROM scada
    """,
    "wind_direction_sin wind_direction_cos",
)
def direction_features(spark, sf_dir):
    return scada(spark, sf_dir).select(KEY, TS, *[c.alias(n) for n, c in cols.direction_columns().items()])


_CALENDAR = """
    sin(2e0*pi()*hr/24e0) AS hour_sin, cos(2e0*pi()*hr/24e0) AS hour_cos,
    sin(2e0*pi()*dy/366e0) AS day_sin, cos(2e0*pi()*dy/366e0) AS day_cos
"""
_HR = """CAST(hour("timestamp") AS DOUBLE) + CAST(minute("timestamp") AS DOUBLE)/6e1 AS hr,
         CAST(dayofyear("timestamp") AS DOUBLE) AS dy"""


@query(
    "p4_calendar_features",
    f'SELECT asset_id, "timestamp", {_CALENDAR} FROM (SELECT *, {_HR} FROM scada)',
    "hour_sin hour_cos day_sin day_cos",
)
def calendar_features(spark, sf_dir):
    return scada(spark, sf_dir).select(KEY, TS, *[c.alias(n) for n, c in cols.calendar_columns().items()])


_PHYSICS = """
    wind_speed_mps*wind_speed_mps AS wind_speed_sq, wind_speed_mps*wind_speed_mps*wind_speed_mps AS wind_speed_cb,
    active_power_kw - theoretical_power_kwh AS power_curve_deviation,
    CASE WHEN theoretical_power_kwh > 50 THEN active_power_kw/theoretical_power_kwh ELSE 1e0 END AS power_efficiency,
    CASE WHEN mean_3 > 50 THEN std_3/mean_3 ELSE 0e0 END AS turbulence_intensity,
    6125e-4*(wind_speed_mps*wind_speed_mps*wind_speed_mps) AS wind_power_density,
    CASE WHEN theoretical_power_kwh > 100 THEN active_power_kw/theoretical_power_kwh ELSE 0e0 END AS capacity_factor,
    CASE WHEN wind_speed_mps > 3 THEN active_power_kw/(wind_speed_mps*wind_speed_mps + 1) ELSE 0e0 END
      AS wind_shear_indicator
"""
_PHYSICS_NAMES = (
    "wind_speed_sq wind_speed_cb power_curve_deviation power_efficiency turbulence_intensity wind_power_density "
    "capacity_factor wind_shear_indicator"
)
_THREE = """
    (SELECT *, CASE WHEN count(active_power_kw) OVER w3 = 3 THEN avg(active_power_kw) OVER w3 END AS mean_3,
            CASE WHEN count(active_power_kw) OVER w3 = 3 THEN stddev_samp(active_power_kw) OVER w3 END AS std_3
     FROM idx WINDOW w3 AS (PARTITION BY asset_id ORDER BY row_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
"""


@query("p5_p6_physics_features", f'SELECT asset_id, "timestamp", {_PHYSICS} FROM {_THREE}', _PHYSICS_NAMES)
def physics_features(spark, sf_dir):
    rows = along_timeline(
        indexed(spark, sf_dir),
        {
            "mean_3": lambda w: features.rolling(F.avg, POWER, 3, w),
            "std_3": lambda w: features.rolling(F.stddev_samp, POWER, 3, w),
        },
        back=2,
    )
    physics = cols.physics_columns(F.col("mean_3"), F.col("std_3"))
    return rows.select(KEY, TS, *[c.alias(n) for n, c in physics.items()])


@query(
    "p8_active_rows",
    """
    SELECT asset_id, "timestamp", split, active_power_kw FROM
      (SELECT *, count(CASE WHEN active_power_kw > 100 THEN 1 END) OVER (PARTITION BY asset_id, split) AS n_active
       FROM sp WHERE split <> 'test')
    WHERE active_power_kw > 100 OR n_active < CASE split WHEN 'train' THEN 100 ELSE 50 END
    """,
    "active_power_kw",
)
def active_rows(spark, sf_dir):
    rows = splits.row_split(indexed(spark, sf_dir)).where("split <> 'test'")
    return features.active_rows(rows).select(KEY, TS, "split", POWER)


@query(
    "p9_sample_weight",
    'SELECT asset_id, "timestamp", CASE WHEN active_power_kw > 500 THEN 2e0 ELSE 1e0 END AS weight FROM scada',
    "weight",
)
def sample_weight(spark, sf_dir):
    return scada(spark, sf_dir).select(KEY, TS, cols.sample_weight(F.col(POWER)).alias("weight"))


@query(
    "p11_clip_power",
    """
    SELECT asset_id, "timestamp", round(least(greatest(active_power_kw - 1e2, 0e0), 18e2), 3) AS clipped_kw FROM scada
    """,
    "clipped_kw",
)
def clip_power(spark, sf_dir):
    return scada(spark, sf_dir).select(KEY, TS, cols.clipped_power(F.col(POWER) - 100.0, 1800.0).alias("clipped_kw"))


@query(
    "p13_w5_delta_target",
    """
    SELECT asset_id, "timestamp", target_active_power_kw, target_active_power_kw - active_power_kw AS delta_kw
    FROM (SELECT *, lead(active_power_kw, 6) OVER (PARTITION BY asset_id ORDER BY row_index) AS target_active_power_kw
          FROM idx) WHERE target_active_power_kw IS NOT NULL
    """,
    "target_active_power_kw delta_kw",
)
def delta_target(spark, sf_dir):
    rows = along_timeline(
        indexed(spark, sf_dir), {features.TARGET: lambda w: F.lead(POWER, 6).over(w)}, back=0, ahead=6
    )
    delta = (F.col(features.TARGET) - F.col(POWER)).alias("delta_kw")
    return rows.where(F.col(features.TARGET).isNotNull()).select(KEY, TS, features.TARGET, delta)


_LAGS = ", ".join(
    f"lag({c}, {k}) OVER t AS {n}_lag_{k}"
    for k in (1, 3, 6, 12, 24)
    for n, c in (("active_power", POWER), ("wind_speed", WIND))
)
_LAG_NAMES = " ".join(f"{n}_lag_{k}" for k in (1, 3, 6, 12, 24) for n in ("active_power", "wind_speed"))
_T = "WINDOW t AS (PARTITION BY asset_id ORDER BY row_index)"


@query("w1_lags", f'SELECT asset_id, "timestamp", {_LAGS} FROM idx {_T}', _LAG_NAMES)
def lags(spark, sf_dir):
    columns = {n: f for n, f in features.window_columns(features.LAGS, ()).items() if "_lag_" in n}
    return along_timeline(indexed(spark, sf_dir), columns, back=24).select(KEY, TS, *columns)


@query(
    "w2_differences",
    f"""
    SELECT asset_id, "timestamp", active_power_kw - lag(active_power_kw) OVER t AS power_rate_of_change,
           wind_speed_mps - lag(wind_speed_mps) OVER t AS wind_speed_rate_of_change FROM idx {_T}
    """,
    "power_rate_of_change wind_speed_rate_of_change",
)
def differences(spark, sf_dir):
    columns = {n: f for n, f in features.window_columns((), ()).items() if "rate_of_change" in n}
    return along_timeline(indexed(spark, sf_dir), columns, back=1).select(KEY, TS, *columns)


def _rolled(f: str, column: str, n: int, name: str) -> str:
    frame = f"(PARTITION BY asset_id ORDER BY row_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {frame} = {n} THEN {f}({column}) OVER {frame} END AS {name}"


_MEANS = ", ".join(
    _rolled("avg", c, n, f"{name}_roll_mean_{n}")
    for n in (3, 6, 12)
    for name, c in (("active_power", POWER), ("wind_speed", WIND))
)
_MEAN_NAMES = " ".join(f"{n}_roll_mean_{k}" for k in (3, 6, 12) for n in ("active_power", "wind_speed"))
_STDS = ", ".join(_rolled("stddev_samp", POWER, n, f"active_power_roll_std_{n}") for n in (3, 6, 12))
_STD_NAMES = " ".join(f"active_power_roll_std_{n}" for n in (3, 6, 12))
_DIRTY_IDX = TABLES + """
    , didx AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp") - 1 AS row_index FROM
      (SELECT *, row_number() OVER (PARTITION BY asset_id, "timestamp" ORDER BY ingest_seq DESC) AS k FROM dirty)
      WHERE k = 1)
"""


@query("w3_rolling_means", f'SELECT asset_id, "timestamp", {_MEANS} FROM didx', _MEAN_NAMES, _DIRTY_IDX)
def rolling_means(spark, sf_dir):
    """Over rows with missing wind speeds: a window with a missing value has no mean."""
    rows = with_row_index(cleaning.normalise(dirty_scada(spark, sf_dir)))
    columns = {n: f for n, f in features.window_columns((), features.WINDOWS).items() if "roll_mean" in n}
    return along_timeline(rows, columns, back=11).select(KEY, TS, *columns)


@query("w4_rolling_stds", f'SELECT asset_id, "timestamp", {_STDS} FROM idx', _STD_NAMES)
def rolling_stds(spark, sf_dir):
    columns = {n: f for n, f in features.window_columns((), features.WINDOWS).items() if "roll_std" in n}
    return along_timeline(indexed(spark, sf_dir), columns, back=11).select(KEY, TS, *columns)


@query(
    "w6_adjacent_changes",
    f"""
    SELECT * FROM (SELECT asset_id, "timestamp", (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER t))/6e7
                          AS minutes, active_power_kw - lag(active_power_kw) OVER t AS change_kw FROM idx {_T})
    WHERE change_kw IS NOT NULL
    """,
    "minutes change_kw",
)
def adjacent_changes(spark, sf_dir):
    rows = along_timeline(
        indexed(spark, sf_dir),
        {
            "minutes": lambda w: cols.minutes_between(F.col(TS), F.lag(TS).over(w)),
            "change_kw": lambda w: F.col(POWER) - F.lag(POWER).over(w),
        },
        back=1,
    )
    return rows.where("change_kw IS NOT NULL").select(KEY, TS, "minutes", "change_kw")


@query("w10_row_index", 'SELECT asset_id, "timestamp", row_index, n_rows FROM idx')
def row_index(spark, sf_dir):
    return indexed(spark, sf_dir).select(KEY, TS, ROW, TOTAL)


def stored(spark, sf_dir):
    """The numbered rows as a stored table; returns its name and its chunks."""
    path = new_table_path(spark, "timeline")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    return name, store_timeline(indexed(spark, sf_dir), name, path)


@query("w10_stored_timeline", f'SELECT asset_id, "timestamp", row_index, n_rows, {POWER} FROM idx', POWER)
def stored_timeline(spark, sf_dir):
    return stored_rows(spark, stored(spark, sf_dir)[0]).select(KEY, TS, ROW, TOTAL, POWER)


@query(
    "s5a_stored_range",
    """
    SELECT asset_id, "timestamp", row_index, active_power_kw FROM idx
    WHERE asset_id = 'T2' AND "timestamp" >= TIMESTAMP '2018-01-01 12:00:00' AND "timestamp" < TIMESTAMP '2018-01-05 00:00:00'
    """,
    "active_power_kw",
)
def stored_range(spark, sf_dir):
    """One asset and a time range of the stored timeline; both filters reach the scan."""
    rows = stored_rows(spark, stored(spark, sf_dir)[0])
    return load_observations(rows, "T2", "2018-01-01 12:00:00", "2018-01-05 00:00:00").select(KEY, TS, ROW, POWER)


@query("w1_stored_lags", f'SELECT asset_id, "timestamp", {_LAGS} FROM idx {_T}', _LAG_NAMES)
def stored_lags(spark, sf_dir):
    columns = {n: f for n, f in features.window_columns(features.LAGS, ()).items() if "_lag_" in n}
    return along_timeline(stored(spark, sf_dir)[1], columns, back=24).select(KEY, TS, *columns)


@query(
    "w11_last_rows",
    'SELECT asset_id, "timestamp", active_power_kw FROM idx WHERE row_index >= n_rows - 36',
    "active_power_kw",
)
def latest_rows(spark, sf_dir):
    return last_rows(scada(spark, sf_dir).select(KEY, TS, POWER), 36)


@query(
    "w12_mean_known_at_origin",
    f"""
    SELECT asset_id, "timestamp", lag(m, 6) OVER t AS mean_known_kw
    FROM (SELECT *, {_rolled("avg", POWER, 6, "m")} FROM idx) {_T}
    """,
    "mean_known_kw",
)
def mean_known_at_origin(spark, sf_dir):
    columns = {"mean_known_kw": lambda w: features.rolling(F.avg, POWER, 6, w, until=-6)}
    return along_timeline(indexed(spark, sf_dir), columns, back=11).select(KEY, TS, "mean_known_kw")


def _frame_sql(lags, windows, lead: int | None, source: str = "idx") -> tuple[str, str]:
    lag_columns = [
        f"lag({c}, {k}) OVER t AS {n}_lag_{k}"
        for k in lags
        for n, c in (("active_power", POWER), ("wind_speed", WIND))
    ]
    rolls = [
        sql
        for n in windows
        for sql in (
            _rolled("avg", POWER, n, f"active_power_roll_mean_{n}"),
            _rolled("avg", WIND, n, f"wind_speed_roll_mean_{n}"),
            _rolled("stddev_samp", POWER, n, f"active_power_roll_std_{n}"),
        )
    ]
    names = [s.rsplit(" AS ", 1)[1] for s in (*lag_columns, *rolls)]
    fixed = ["power_rate_of_change", "wind_speed_rate_of_change"]
    derived = "wind_direction_sin wind_direction_cos hour_sin hour_cos day_sin day_cos persistence_kw".split()
    shown = [*MEASURES, *names, *fixed, *_PHYSICS_NAMES.split(), *derived]
    inner = f"""
      SELECT *, {_HR}, {", ".join([*lag_columns, *rolls])},
             active_power_kw - lag(active_power_kw) OVER t AS power_rate_of_change,
             wind_speed_mps - lag(wind_speed_mps) OVER t AS wind_speed_rate_of_change,
             {_rolled("avg", POWER, 3, "mean_3")}, {_rolled("stddev_samp", POWER, 3, "std_3")}
      FROM {source} {_T}
    """
    whole = f"""
      SELECT asset_id, "timestamp", ingest_seq, {", ".join([*MEASURES, *names, *fixed])}, {_PHYSICS},
             sin(radians(wind_direction_deg)) AS wind_direction_sin,
             cos(radians(wind_direction_deg)) AS wind_direction_cos, {_CALENDAR}, active_power_kw AS persistence_kw
      FROM ({inner})
      WHERE {" AND ".join(f"{n} IS NOT NULL" for n in [*MEASURES, *names, *fixed])}
    """
    if lead is not None:
        whole = f"""
          SELECT * FROM (SELECT *, lead(active_power_kw, {lead}) OVER (PARTITION BY asset_id ORDER BY "timestamp")
                                AS target_active_power_kw FROM ({whole}))
          WHERE target_active_power_kw IS NOT NULL
        """
        shown.append(features.TARGET)
    return whole, " ".join(shown)


@query("f2_tabular_features", *_frame_sql(features.LAGS, features.WINDOWS, None))
def tabular_features(spark, sf_dir):
    return features.tabular_features(indexed(spark, sf_dir)).drop(ROW, TOTAL)


@query("f2_stored_features", *_frame_sql(features.LAGS, features.WINDOWS, None))
def stored_features(spark, sf_dir):
    return features.tabular_features(stored(spark, sf_dir)[1]).drop(ROW, TOTAL)


@query("f3_supervised_features", *_frame_sql(features.TRAINING_LAGS, features.TRAINING_WINDOWS, 6))
def supervised_features(spark, sf_dir):
    frame = features.supervised_features(
        indexed(spark, sf_dir), 6, features.TRAINING_LAGS, features.TRAINING_WINDOWS, complete_rows=True
    )
    return frame.drop(ROW, TOTAL)


_WRAPPED_IDX = _DIRTY_IDX + """
    , widx AS (SELECT * REPLACE (CASE WHEN wind_direction_deg < 0 THEN wind_direction_deg + 36e1
                                      ELSE wind_direction_deg END AS wind_direction_deg) FROM didx)
"""


@query("f3_supervised_with_gaps", *_frame_sql((1, 3), (3,), 6, "widx"), _WRAPPED_IDX)
def supervised_with_gaps(spark, sf_dir):
    """Missing wind speeds: targets are counted over the rows that survive."""
    rows = with_row_index(cleaning.normalise(dirty_scada(spark, sf_dir)))
    return features.supervised_features(rows, 6, (1, 3), (3,)).drop(ROW, TOTAL)


@query(
    "f4_feature_set_choice",
    """
    SELECT asset_id, n_rows, feature_set,
           CASE feature_set WHEN 0 THEN [1, 3, 6, 12, 24, 36, 48] WHEN 1 THEN [1, 3, 6, 12, 24] WHEN 2 THEN [1, 3, 6]
                ELSE [1] END AS lags,
           CASE feature_set WHEN 0 THEN [3, 6, 12, 24, 48] WHEN 1 THEN [3, 6, 12] WHEN 2 THEN [3, 6] ELSE [2] END
             AS windows
    FROM (SELECT asset_id, count(*) AS n_rows,
                 CAST(CASE WHEN count(*) - 54 >= 10 THEN 0 WHEN count(*) - 30 >= 10 THEN 1
                      WHEN count(*) - 12 >= 10 THEN 2 ELSE 3 END AS INTEGER) AS feature_set
          FROM scada GROUP BY asset_id)
    """,
)
def feature_set_choice(spark, sf_dir):
    return features.feature_set_choice(indexed(spark, sf_dir), 6)


@query(
    "t1_time_split",
    """
    SELECT s.asset_id, s."timestamp", CASE WHEN epoch_us(s."timestamp") < b.lo + tr THEN 'train'
           WHEN epoch_us(s."timestamp") < b.lo + tr + va THEN 'val' ELSE 'test' END AS split
    FROM scada s JOIN (SELECT asset_id, lo, CAST(round((hi - lo)/1e6*7e-1*1e6) AS BIGINT) AS tr,
                              CAST(round((hi - lo)/1e6*15e-2*1e6) AS BIGINT) AS va
                       FROM (SELECT asset_id, epoch_us(min("timestamp")) AS lo, epoch_us(max("timestamp")) AS hi
                             FROM scada GROUP BY asset_id)) b ON b.asset_id = s.asset_id
    """,
)
def time_split(spark, sf_dir):
    return splits.time_split(scada(spark, sf_dir)).select(KEY, TS, "split")


@query("t2_row_split", 'SELECT asset_id, "timestamp", split FROM sp')
def row_split(spark, sf_dir):
    return splits.row_split(indexed(spark, sf_dir)).select(KEY, TS, "split")


_FRAME = "SELECT asset_id, \"timestamp\", row_index - 24 AS p, n_rows - 30 AS n FROM idx WHERE row_index BETWEEN 24 AND n_rows - 7"


@query(
    "t3_feature_frame_split",
    f"""
    SELECT asset_id, "timestamp", CASE WHEN p < te THEN 'train' WHEN p < least(greatest(te + 1,
           CAST(floor(n*(7e-1+15e-2)) AS BIGINT)), n - 1) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, greatest(1, CAST(floor(n*7e-1) AS BIGINT)) AS te FROM ({_FRAME}))
    """,
)
def feature_frame_split(spark, sf_dir):
    frame = features.supervised_features(indexed(spark, sf_dir), 6, complete_rows=True).select(KEY, TS)
    return splits.row_split(with_row_index(frame), min_rows=3).select(KEY, TS, "split")


@query(
    "t4_tail_split",
    f"""
    SELECT asset_id, "timestamp", CASE WHEN p < tf - greatest(1, tf // 10) THEN 'train' WHEN p < tf THEN 'val'
           ELSE 'test' END AS split
    FROM (SELECT *, CAST(floor(n*8e-1) AS BIGINT) AS tf FROM ({_FRAME}))
    """,
)
def tail_split(spark, sf_dir):
    frame = features.supervised_features(indexed(spark, sf_dir), 6, complete_rows=True).select(KEY, TS)
    return splits.tail_split(with_row_index(frame), 0.8).select(KEY, TS, "split")


@query(
    "t6_forecast_time_split",
    """
    SELECT f.asset_id, f."timestamp", f."timestamp" + to_minutes(60) AS forecast_ts,
           CASE WHEN f."timestamp" + to_minutes(60) <= te THEN 'train'
                WHEN f."timestamp" + to_minutes(60) <= ve THEN 'val' ELSE 'test' END AS split
    FROM (SELECT * FROM idx WHERE row_index BETWEEN 24 AND n_rows - 7) f
    JOIN (SELECT asset_id, max(CASE WHEN row_index = train_end - 1 THEN "timestamp" END) AS te,
                 max(CASE WHEN row_index = val_end - 1 THEN "timestamp" END) AS ve FROM sp GROUP BY asset_id) b
      ON b.asset_id = f.asset_id
    """,
)
def forecast_time_split(spark, sf_dir):
    rows = indexed(spark, sf_dir)
    frame = features.supervised_features(rows, 6, complete_rows=True).select(KEY, TS)
    return splits.forecast_time_split(frame, splits.split_times(rows), 6)


@query(
    "t7_window_split_by_forecast_row",
    """
    SELECT asset_id, start_index, CASE WHEN start_index + 149 < train_end THEN 'train'
           WHEN start_index + 149 < val_end THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_index AS start_index FROM sp) WHERE start_index + 149 < n_rows
    """,
)
def window_split(spark, sf_dir):
    start = indexed(spark, sf_dir).where(F.col(ROW) + 149 < F.col(TOTAL))
    marked = splits.row_split(start, position=F.col(ROW) + 149)
    return marked.select(KEY, F.col(ROW).alias("start_index"), "split")


def _gappy(spark, sf_dir):
    """All rows, every second one and those after it seven minutes later than before."""
    pair = F.floor(F.floor(F.col(SEQ) / 4) / 2)
    return scada(spark, sf_dir).withColumn(TS, cols.plus_minutes(F.col(TS), 7 * pair))


_GAPPY = """
    WITH gappy AS (SELECT * REPLACE ("timestamp" + to_minutes(7*((ingest_seq//4)//2)) AS "timestamp") FROM scada)
"""


@query(
    "a19_cadence",
    _GAPPY
    + """
    SELECT asset_id, quantile_cont(d, 5e-1) AS step_minutes FROM
      (SELECT asset_id, (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY asset_id
              ORDER BY "timestamp")))/6e7 AS d FROM gappy) WHERE d IS NOT NULL
    GROUP BY asset_id
    """,
    "step_minutes",
)
def cadence(spark, sf_dir):
    """Over a timeline whose steps alternate between 10 and 17 minutes."""
    return splits.cadence(with_row_index(_gappy(spark, sf_dir)))


@query(
    "a19_cadence_upper",
    _GAPPY
    + """
    SELECT asset_id, max(CASE WHEN k = n // 2 THEN d END) AS step_minutes FROM
      (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY asset_id) AS n
       FROM (SELECT asset_id, (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY asset_id
                    ORDER BY "timestamp")))/6e7 AS d FROM gappy) WHERE d > 0)
    GROUP BY asset_id
    """,
    "step_minutes",
)
def cadence_upper(spark, sf_dir):
    return splits.cadence(with_row_index(_gappy(spark, sf_dir)), upper=True)


_SHORT = """
    WITH fleet AS (SELECT * REPLACE (CASE WHEN asset_id = 'T1' AND row_index < 50 THEN 'T0' ELSE asset_id END AS asset_id)
                   FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp") - 1 AS row_index FROM scada)),
    numbered AS (SELECT asset_id, "timestamp", row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp") - 1 AS row_index,
                        count(*) OVER (PARTITION BY asset_id) AS n FROM fleet)
    SELECT asset_id, row_index,
           CASE WHEN n < 100 THEN NULL WHEN row_index < CAST(floor(n*7e-1) AS BIGINT) THEN 'train'
                WHEN row_index < CAST(floor(n*(7e-1+15e-2)) AS BIGINT) THEN 'val' ELSE 'test' END AS split,
           CASE WHEN n < 100 THEN concat('too few rows to split: ', CAST(n AS VARCHAR), ' of 100') END AS split_problem
    FROM numbered
"""


@query("t2_split_with_short_asset", f"SELECT * FROM ({_SHORT}) AS parts")
def split_with_short_asset(spark, sf_dir):
    """An asset of 50 rows among the others: it is set aside with a reason, and the rest are split."""
    first = with_row_index(scada(spark, sf_dir)).withColumn(
        KEY, F.when((F.col(KEY) == "T1") & (F.col(ROW) < 50), F.lit("T0")).otherwise(F.col(KEY))
    )
    fleet = with_row_index(first.drop(ROW, TOTAL))
    return splits.row_split(fleet, strict=False).select(KEY, F.col(ROW).alias("row_index"), "split", "split_problem")


@query(
    "a22_split_summary",
    """
    SELECT asset_id, count(*) AS rows_total, count(CASE WHEN split = 'train' THEN 1 END) AS rows_train,
           count(CASE WHEN split = 'val' THEN 1 END) AS rows_val,
           count(CASE WHEN split = 'test' THEN 1 END) AS rows_test, min("timestamp") AS train_start_ts,
           max(CASE WHEN split = 'train' THEN "timestamp" END) AS train_end_ts,
           max(CASE WHEN split = 'val' THEN "timestamp" END) AS val_end_ts, max("timestamp") AS test_end_ts,
           7e-1 AS train_ratio, 15e-2 AS val_ratio, 1e1 AS step_minutes
    FROM sp GROUP BY asset_id
    """,
)
def split_summary(spark, sf_dir):
    return splits.split_summary(indexed(spark, sf_dir))


@query(
    "j2_horizon_anchors",
    """
    SELECT s.asset_id, s.row_index AS idx, s."timestamp", s.active_power_kw AS actual_kw,
           b.active_power_kw AS baseline_kw, s.theoretical_power_kwh AS theoretical_kw, s.wind_speed_mps AS wind_speed,
           s.split
    FROM sp s JOIN sp b ON b.asset_id = s.asset_id AND b.row_index = s.row_index - 36
    """,
    "actual_kw baseline_kw theoretical_kw wind_speed",
)
def horizon_anchors(spark, sf_dir):
    return backtest.anchors(indexed(spark, sf_dir), 36)

