"""Queries over ramps, shortfall risk, forecasts, sequences and report tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetcast.catalog.base import BACKTEST, query
from fleetcast.catalog.score_queries import METRIC_DOUBLES, OUTPUT_DOUBLES, metrics_sql, outputs
from fleetcast.catalog.testview import scada, table
from fleetcast.functions.columns import plus_minutes
from fleetcast.operators import forecast, metrics, reporting, risk, sequences, splits
from fleetcast.operators.timeline import with_row_index
from fleetcast.plans import backtest, learned, rollforward
from fleetcast.schemas import KEY, MEASURES, POWER, RATED_KW, THEORETICAL, TS, WIND
from fleetcast.session import new_table_path, written
from fleetcast.sources import outputs as files
from fleetcast.sources import registry
from fleetcast.sources.weather import FILE, RESPONSE_DDL, file_accounts, flatten_hourly, land_responses, stream_responses, weather_rows
from fleetcast.streaming.landing import appended, appending


def indexed(spark, sf_dir):
    return with_row_index(scada(spark, sf_dir))


# ---- ramps and shortfall -------------------------------------------------------------------------


@query(
    "r1_adjacent_ramps",
    """
    SELECT asset_id, prev_ts AS start_time, "timestamp" AS end_time, active_power_kw - prev AS change_kw
    FROM (SELECT *, lag("timestamp") OVER t AS prev_ts, lag(active_power_kw) OVER t AS prev FROM idx
          WINDOW t AS (PARTITION BY asset_id ORDER BY row_index))
    WHERE epoch_us("timestamp") - epoch_us(prev_ts) <= 3600000000 AND abs(active_power_kw - prev) >= 500
    """,
    "change_kw",
)
def adjacent_ramps(spark, sf_dir):
    return risk.adjacent_ramps(indexed(spark, sf_dir))


def _ramps_sql(series: str, capacity: float = 2000.0) -> str:
    """Gaps and islands over (asset_id, "timestamp", row_index, p)."""
    return f"""
    SELECT asset_id, start_time, end_time, power_before_kw, power_after_kw,
           abs(power_after_kw - power_before_kw) AS power_change_kw,
           CASE WHEN power_before_kw > 0 THEN abs((power_after_kw - power_before_kw)/power_before_kw*100)
                ELSE 0e0 END AS power_change_pct,
           (steps + 1)*10 AS duration_minutes,
           (epoch_us(end_time) - epoch_us(start_time))/6e7 AS elapsed_minutes,
           CASE WHEN power_after_kw > power_before_kw THEN 'up' ELSE 'down' END AS direction,
           CASE WHEN abs(power_after_kw - power_before_kw)/{capacity}e0 > 5e-1 THEN 'critical'
                WHEN abs(power_after_kw - power_before_kw)/{capacity}e0 > 3e-1 THEN 'high'
                WHEN abs(power_after_kw - power_before_kw)/{capacity}e0 > 15e-2 THEN 'medium'
                ELSE 'low' END AS risk_level,
           abs(power_after_kw - power_before_kw)/((epoch_us(end_time) - epoch_us(start_time))/6e7)
             AS ramp_rate_kw_per_min
    FROM (SELECT asset_id, min(prev_ts) AS start_time, max("timestamp") AS end_time, count(*) AS steps,
                 arg_min(prev, row_index) AS power_before_kw, arg_max(p, row_index) AS power_after_kw
          FROM (SELECT *, row_index - row_number() OVER (PARTITION BY asset_id ORDER BY row_index) AS island
                FROM (SELECT *, lag("timestamp") OVER t AS prev_ts, lag(p) OVER t AS prev FROM {series}
                      WINDOW t AS (PARTITION BY asset_id ORDER BY row_index))
                WHERE abs(p - prev) >= 500 OR (prev > 0 AND abs((p - prev)/prev*100) >= 30))
          GROUP BY asset_id, island)
    """


RAMP_DOUBLES = (
    "power_before_kw power_after_kw power_change_kw power_change_pct elapsed_minutes ramp_rate_kw_per_min"
)
_POWER_SERIES = '(SELECT asset_id, "timestamp", row_index, active_power_kw AS p FROM idx)'


@query("r2_r3_ramp_events", _ramps_sql(_POWER_SERIES), RAMP_DOUBLES)
def ramp_events(spark, sf_dir):
    return risk.ramp_events(indexed(spark, sf_dir))


@query(
    "r6_sample_target_ramps",
    _ramps_sql(
        '(SELECT asset_id, "timestamp", row_index, active_power_kw AS p FROM idx '
        "WHERE row_index >= 144 AND row_index <= n_rows - 6)"
    ),
    RAMP_DOUBLES,
)
def sample_target_ramps(spark, sf_dir):
    return risk.sample_target_ramps(indexed(spark, sf_dir))


_FORECAST_SERIES = """
    (SELECT model_id AS asset_id, "timestamp", row_number() OVER (PARTITION BY model_id ORDER BY "timestamp") AS row_index,
            p10, predicted_kw AS p FROM outp)
"""


def _forecasts(spark, sf_dir):
    """The forecasts of every model, asset and horizon, each a series of its own."""
    rows = outputs(spark, sf_dir)
    return rows.select(F.col("model_id").alias(KEY), TS, "p10", F.col("predicted_kw").alias("p50"))


_SHORTFALL = f"""
    SELECT asset_id, "timestamp", expected_power_kw, 252e1 AS shortfall_threshold_kw, shortfall_probability,
           expected_shortfall_kw,
           CASE WHEN shortfall_probability > 7e-1 AND expected_shortfall_kw/36e2 > 2e-1 THEN 'critical'
                WHEN shortfall_probability > 5e-1 AND expected_shortfall_kw/36e2 > 15e-2 THEN 'high'
                WHEN shortfall_probability > 3e-1 THEN 'medium' ELSE 'low' END AS risk_level
    FROM (SELECT asset_id, "timestamp", p AS expected_power_kw,
                 CASE WHEN p >= 252e1 THEN 5e-1 ELSE 8e-1 END AS shortfall_probability,
                 CASE WHEN p >= 252e1 THEN 252e1 - p10 ELSE 252e1 - p END AS expected_shortfall_kw
          FROM {_FORECAST_SERIES} WHERE p10 < 252e1)
"""


@query("r4_r5_shortfall_risk", _SHORTFALL, "expected_power_kw expected_shortfall_kw", BACKTEST)
def shortfall_risk(spark, sf_dir):
    return risk.shortfall_risk(_forecasts(spark, sf_dir), RATED_KW)


@query(
    "r7_forecast_assessment",
    f"""
    SELECT asset_id, 'ramp' AS kind, start_time AS "timestamp", end_time, power_change_kw AS magnitude_kw,
           CAST(NULL AS DOUBLE) AS shortfall_probability, risk_level
    FROM ({_ramps_sql(_FORECAST_SERIES, 3600.0)})
    UNION ALL
    SELECT asset_id, 'shortfall', "timestamp", "timestamp", expected_shortfall_kw, shortfall_probability, risk_level
    FROM ({_SHORTFALL})
    """,
    "magnitude_kw shortfall_probability",
    BACKTEST,
)
def forecast_assessment(spark, sf_dir):
    return risk.assess_forecast(with_row_index(_forecasts(spark, sf_dir)), RATED_KW)


# ---- forecasts after the last row ----------------------------------------------------------------

_FUTURE = '"timestamp" + to_minutes(CAST(10*k AS BIGINT))'
_LAST = 'SELECT * FROM idx WHERE row_index = n_rows - 1'


def _pts(p50: str, band: str) -> str:
    return (
        f"round(greatest({p50} - {band}, 0e0), 3) AS p10, round({p50}, 3) AS p50, round({p50} + {band}, 3) AS p90"
    )


_G1 = f"""
    SELECT l.asset_id, CAST(k AS INTEGER) AS step, {_FUTURE} AS "timestamp",
           'persistence-baseline-0.1.0' AS model_id, 6 AS horizon_hours, {_pts("round(active_power_kw, 3)", "band")}
    FROM ({_LAST}) l
    JOIN (SELECT asset_id, greatest(5e1, arg_max(active_power_kw, row_index)*1e-1, stddev_pop(active_power_kw)*128e-2)
                 AS band FROM idx WHERE row_index >= n_rows - 18 GROUP BY asset_id) b ON b.asset_id = l.asset_id
    CROSS JOIN range(1, 37) AS r(k)
"""


@query("g1_persistence_forecast", f"SELECT *, CAST([] AS VARCHAR[]) AS warnings FROM ({_G1})", "p10 p50 p90")
def persistence_forecast(spark, sf_dir):
    return forecast.persistence_forecast(indexed(spark, sf_dir), 6)


@query(
    "g2_residual_persistence",
    f"""
    SELECT l.asset_id, CAST(k AS INTEGER) AS step, {_FUTURE} AS "timestamp",
           'persistence-baseline-0.1.0' AS model_id, 6 AS horizon_hours, {_pts("active_power_kw", "band")}
    FROM ({_LAST}) l
    JOIN (SELECT asset_id, 2*quantile_cont(d, 9e-1) AS band FROM
            (SELECT asset_id, abs(active_power_kw - lag(active_power_kw) OVER (PARTITION BY asset_id
                    ORDER BY row_index)) AS d FROM sp WHERE split = 'train') GROUP BY asset_id) b
      ON b.asset_id = l.asset_id
    CROSS JOIN range(1, 37) AS r(k)
    """,
    "p10 p50 p90",
)
def residual_persistence(spark, sf_dir):
    rows = indexed(spark, sf_dir)
    return forecast.residual_persistence_forecast(rows, backtest.split_rows(rows, "train"), 6)


@query(
    "g3_rolling_mean_forecast",
    f"""
    SELECT l.asset_id, CAST(k AS INTEGER) AS step, {_FUTURE} AS "timestamp",
           'rolling-mean-baseline-0.1.0' AS model_id, 1 AS horizon_hours, {_pts("m", "band")}
    FROM ({_LAST}) l
    JOIN (SELECT asset_id, avg(active_power_kw) AS m, stddev_pop(active_power_kw)*1645e-3 AS band
          FROM idx WHERE row_index >= n_rows - 6 GROUP BY asset_id) b ON b.asset_id = l.asset_id
    CROSS JOIN range(1, 7) AS r(k)
    """,
    "p10 p50 p90",
)
def rolling_mean_forecast(spark, sf_dir):
    return forecast.rolling_mean_forecast(scada(spark, sf_dir), 1)


@query(
    "g4_power_curve_forecast",
    'SELECT asset_id, "timestamp", theoretical_power_kwh AS predicted_kw FROM scada',
    "predicted_kw",
)
def power_curve_forecast(spark, sf_dir):
    return forecast.power_curve_forecast(scada(spark, sf_dir))


@query(
    "g5_three_baselines",
    f"""
    SELECT asset_id, CAST(k AS INTEGER) AS step, {_FUTURE} AS "timestamp", model_id, 1 AS horizon_hours,
           {_pts("v", "band")}
    FROM (SELECT l.asset_id, l."timestamp", b.band, u.model_id,
                 CASE u.model_id WHEN 'persistence' THEN l.active_power_kw WHEN 'power_curve'
                      THEN l.theoretical_power_kwh ELSE b.m END AS v
          FROM ({_LAST}) l
          JOIN (SELECT asset_id, avg(active_power_kw) AS m, greatest(5e1, stddev_samp(active_power_kw)*15e-1) AS band
                FROM idx WHERE row_index >= n_rows - 36 GROUP BY asset_id) b ON b.asset_id = l.asset_id
          CROSS JOIN (VALUES ('persistence'), ('power_curve'), ('rolling_mean')) AS u(model_id))
    CROSS JOIN range(1, 7) AS r(k)
    """,
    "p10 p50 p90",
)
def three_baselines(spark, sf_dir):
    return forecast.three_baselines(scada(spark, sf_dir), 1)


@query(
    "g9_choose_forecast",
    f"""
    SELECT *, ['ML model trained for 1h horizon; using persistence for 6h.'] AS warnings FROM ({_G1})
    """,
    "p10 p50 p90",
)
def choose_forecast(spark, sf_dir):
    """The registry's newest model is for another horizon: persistence with a warning."""
    rows = indexed(spark, sf_dir)
    counts = rows.groupBy(KEY).agg(F.count("*").alias("n_obs"))
    newest = registry.latest_model(_registry_rows(spark, sf_dir), "gradient_boosting")
    return forecast.choose_forecast(forecast.persistence_forecast(rows, 6), newest["horizon_hours"], counts, 6)


@query(
    "g1_nested_forecast",
    f"""
    SELECT asset_id, model_id, horizon_hours, count(*) AS points, min("timestamp") AS first_ts,
           max("timestamp") AS last_ts, sum(p90 - p10) AS band_sum
    FROM ({_G1}) GROUP BY asset_id, model_id, horizon_hours
    """,
    "band_sum",
)
def nested_forecast(spark, sf_dir):
    nested = forecast.nested_forecast(forecast.persistence_forecast(indexed(spark, sf_dir), 6))
    band = F.aggregate("forecast", F.lit(0.0), lambda a, p: a + (p["p90"] - p["p10"]))
    return nested.select(
        KEY,
        "model_id",
        "horizon_hours",
        F.size("forecast").cast("long").alias("points"),
        F.element_at("forecast", 1)[TS].alias("first_ts"),
        F.element_at("forecast", -1)[TS].alias("last_ts"),
        band.alias("band_sum"),
    )


# ---- sequences -----------------------------------------------------------------------------------

_WINDOWS = """
    SELECT asset_id, row_index AS sample_index, n_rows,
           lead("timestamp", 144) OVER t AS "timestamp", active_power_kw AS first_power,
           lead(active_power_kw, 143) OVER t AS last_power, lead(active_power_kw, 144) OVER t AS target_first,
           lead(active_power_kw, 149) OVER t AS target_last,
           sum(wind_speed_mps) OVER (PARTITION BY asset_id ORDER BY row_index ROWS BETWEEN CURRENT ROW AND 143 FOLLOWING)
             AS wind_sum
    FROM idx WINDOW t AS (PARTITION BY asset_id ORDER BY row_index)
"""
_WINDOW_DOUBLES = "first_power last_power target_first target_last wind_sum"


@query(
    "w7_sequence_samples",
    f"SELECT * EXCLUDE (n_rows), 144 AS steps FROM ({_WINDOWS}) WHERE target_last IS NOT NULL",
    _WINDOW_DOUBLES,
)
def sequence_samples(spark, sf_dir):
    samples = sequences.sequence_samples(indexed(spark, sf_dir))
    window = F.col("input_sequence")
    return samples.select(
        KEY,
        "sample_index",
        TS,
        F.size(window).alias("steps"),
        window[0][0].alias("first_power"),
        F.element_at(window, -1)[0].alias("last_power"),
        F.col("target")[0].alias("target_first"),
        F.element_at("target", -1).alias("target_last"),
        F.aggregate(window, F.lit(0.0), lambda a, x: a + x[1]).alias("wind_sum"),
    )


@query(
    "t5_sequence_split",
    f"""
    SELECT asset_id, sample_index, CASE WHEN sample_index < CAST(floor(n*7e-1) AS BIGINT) THEN 'train'
           WHEN sample_index < CAST(floor(n*(7e-1+15e-2)) AS BIGINT) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, n_rows - 149 AS n FROM ({_WINDOWS}) WHERE target_last IS NOT NULL)
    """,
)
def sequence_split(spark, sf_dir):
    samples = sequences.sequence_samples(indexed(spark, sf_dir), features=(POWER,))
    return sequences.split_samples(samples).select(KEY, "sample_index", "split")


@query(
    "a21_target_stats",
    """
    SELECT asset_id, avg(active_power_kw) AS target_mean, CASE WHEN stddev_pop(active_power_kw) = 0 THEN 1e0
           ELSE stddev_pop(active_power_kw) END AS target_std FROM scada GROUP BY asset_id
    """,
    "target_mean target_std",
)
def target_stats(spark, sf_dir):
    return sequences.target_stats(scada(spark, sf_dir))


@query(
    "p15_normalised_target",
    """
    SELECT asset_id, "timestamp", (active_power_kw - m)/s AS normalised, active_power_kw FROM
      (SELECT *, avg(active_power_kw) OVER (PARTITION BY asset_id) AS m,
              stddev_pop(active_power_kw) OVER (PARTITION BY asset_id) AS s FROM scada)
    """,
    "normalised active_power_kw",
    digits=4,
)
def normalised_target(spark, sf_dir):
    rows = scada(spark, sf_dir).select(KEY, TS, POWER)
    stats = sequences.target_stats(rows)
    scaled = sequences.normalise_target(rows, stats).drop(POWER)
    return sequences.denormalise_target(scaled, stats).select(KEY, TS, "normalised", POWER)


# ---- learned models ------------------------------------------------------------------------------
# SQL can't fit them: it tells which rows there must be, and the queries say of each whether its values hold together.

LEARNED_HOURS = (1, 6, 24)
# Rows of the training look-back, and the windows a sequence model needs at least.
_REACH, _WINDOW_ROWS, _LEAST_WINDOWS = 48, 143, 200
_FITS = f"""
    (SELECT horizon_hours FROM (SELECT hor.horizon_hours, sum(greatest(t.train_end - ({_WINDOW_ROWS} + hor.h), 0)) AS windows
     FROM (SELECT DISTINCT asset_id, train_end FROM bnd) t CROSS JOIN hor GROUP BY hor.horizon_hours)
     WHERE windows >= {_LEAST_WINDOWS})
"""
_TREES_FIT = f"""
    (SELECT hor.horizon_hours FROM (SELECT DISTINCT asset_id, train_end FROM bnd) t CROSS JOIN hor
     GROUP BY hor.horizon_hours HAVING sum(greatest(t.train_end - ({_REACH} + hor.h), 0)) > 0)
"""


def _tested_sql(model_type: str, reach: int, where: str = "true") -> str:
    name = model_type.replace("_", "-")
    return f"""
    SELECT asset_id, "timestamp", actual_kw, baseline_kw, concat('{name}-', asset_id, '-', CAST(horizon_hours AS VARCHAR), 'h') AS model_id,
           '{model_type}' AS model_type, CAST(horizon_hours AS INTEGER) AS horizon_hours, true AS sound
    FROM anc WHERE split = 'test' AND row_index - h >= {reach} AND {where}
    """


def _sound(low: str = "p10", mid: str = "p50", high: str = "p90"):
    """Finite, not negative, and in order."""
    values = [F.col(c) for c in (low, mid, high)]
    finite = [(v >= 0) & (v < F.lit(float("inf"))) & ~F.isnan(v) for v in values]
    return (finite[0] & finite[1] & finite[2] & (values[0] <= values[1]) & (values[1] <= values[2])).alias("sound")


_FITTED: dict[tuple, object] = {}


def kept_fit(spark, sf_dir, name, make):
    """What ``make()`` gives, kept for later queries of the session as long as the files of the events table don't change."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/events.parquet")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(top)))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _numbered(spark, sf_dir):
    """The numbered rows, written: every fit and forecast goes over them more than once."""
    return kept_fit(spark, sf_dir, "numbered", lambda: written(indexed(spark, sf_dir), "numbered"))


def _features(spark, sf_dir):
    """One table of features serves the trees of all horizons and those with the step as input."""
    make = learned.training_features
    return kept_fit(spark, sf_dir, "features", lambda: make(_numbered(spark, sf_dir), LEARNED_HOURS, more_steps=rollforward.DIRECT_STEPS))


def _direct(spark, sf_dir, hours):
    make = rollforward.fit_direct
    return kept_fit(spark, sf_dir, "direct", lambda: make(_numbered(spark, sf_dir), hours, known=_features(spark, sf_dir)))


def _boosted(spark, sf_dir, hours):
    """``None`` where no asset has a row to train on."""

    def fit():
        try:
            return learned.fit_boosted(_numbered(spark, sf_dir), hours, known=_features(spark, sf_dir))
        except ValueError:
            return None

    return kept_fit(spark, sf_dir, ("boosted", hours), fit)


def _sequence(spark, sf_dir, hours):
    return kept_fit(spark, sf_dir, ("sequence", hours), lambda: learned.fit_sequence(_numbered(spark, sf_dir), hours))


def _all_hours(parts, schema_from):
    """The parts below each other; with none an empty table of that query's columns."""
    out = schema_from
    for part in parts:
        out = part if out is schema_from else out.unionByName(part)
    return out


def _tested(df):
    """``sound``: finite, in order, and the upper bound one and the same width of 50 kW or more above the prediction, per model."""
    width, own = F.col("p90") - F.col("predicted_kw"), Window.partitionBy("model_id")
    even = (F.max(width).over(own) - F.min(width).over(own) < 1e-6) & (width > 50 - 1e-6)
    return df.withColumn("_even", even).select(
        KEY, TS, "actual_kw", "baseline_kw", "model_id", "model_type", "horizon_hours",
        (_sound("p10", "predicted_kw", "p90") & F.col("_even")).alias("sound"),
    )


#: Test rows from which a model's error is compared with that of persistence.
COMPARED_ROWS = 100


def _scores_sql(model_type: str, reach: int, where: str) -> str:
    return f"""
    SELECT asset_id, model_id, horizon_hours, count(*) AS test_rows, avg(abs(actual_kw - baseline_kw)) AS persistence_mae,
           CASE WHEN count(*) >= {COMPARED_ROWS} THEN true END AS better
    FROM ({_tested_sql(model_type, reach, where)}) GROUP BY asset_id, model_id, horizon_hours
    """


def _scores(df):
    """``better``: the mean error is below that of persistence on the same rows, as no constant guess is an hour ahead."""
    own = F.avg(F.abs(F.col("actual_kw") - F.col("predicted_kw")))
    base = F.avg(F.abs(F.col("actual_kw") - F.col("baseline_kw")))
    return df.groupBy(KEY, "model_id", "horizon_hours").agg(
        F.count("*").alias("test_rows"), base.alias("persistence_mae"), F.when(F.count("*") >= COMPARED_ROWS, own < base).alias("better")
    )


_NO_SCORES = f"{KEY} string, model_id string, horizon_hours int, test_rows long, persistence_mae double, better boolean"


def _nothing_tested(spark):
    kind = "timestamp timestamp_ntz, actual_kw double, baseline_kw double, model_id string, model_type string, horizon_hours int"
    return spark.createDataFrame([], f"{KEY} string, {kind}, sound boolean")


@query("b4_boosted_trees", _tested_sql(learned.GBT_TYPE, _REACH, f"horizon_hours IN {_TREES_FIT}"), "actual_kw baseline_kw", BACKTEST)
def boosted_trees(spark, sf_dir):
    parts = [_tested(f[1]) for h in LEARNED_HOURS if (f := _boosted(spark, sf_dir, h))]
    return _all_hours(parts, _nothing_tested(spark))


@query(
    "b5_sequence_model",
    _tested_sql(learned.SEQUENCE_TYPE, _WINDOW_ROWS, f"horizon_hours IN {_FITS}"),
    "actual_kw baseline_kw",
    BACKTEST,
)
def sequence_model(spark, sf_dir):
    fits = [f for h in LEARNED_HOURS if (f := _sequence(spark, sf_dir, h))]
    return _all_hours([_tested(learned.sequence_outputs(*f)) for f in fits], _nothing_tested(spark))


@query("b4_tree_scores", _scores_sql(learned.GBT_TYPE, _REACH, f"horizon_hours IN {_TREES_FIT}"), "persistence_mae", BACKTEST)
def tree_scores(spark, sf_dir):
    parts = [_scores(f[1]) for h in LEARNED_HOURS if (f := _boosted(spark, sf_dir, h))]
    return _all_hours(parts, spark.createDataFrame([], _NO_SCORES))


@query("b5_sequence_scores", _scores_sql(learned.SEQUENCE_TYPE, _WINDOW_ROWS, f"horizon_hours IN {_FITS}"), "persistence_mae", BACKTEST)
def sequence_scores(spark, sf_dir):
    fits = [f for h in LEARNED_HOURS if (f := _sequence(spark, sf_dir, h))]
    return _all_hours([_scores(learned.sequence_outputs(*f)) for f in fits], spark.createDataFrame([], _NO_SCORES))


@query(
    "c4_sequence_calibration",
    f"""
    SELECT asset_id, concat('{learned.SEQUENCE_TYPE.replace("_", "-")}-', asset_id, '-', CAST(horizon_hours AS VARCHAR), 'h') AS model_id,
           '{learned.SEQUENCE_TYPE}' AS model_type, CAST(horizon_hours AS INTEGER) AS horizon_hours, count(*) AS n_cal, 9e-1 AS quantile_level,
           CAST(floor(9e-1*(count(*) - 1)) + 1 AS BIGINT) AS rows_inside, CAST(floor(5e-1*(count(*) - 1)) + 1 AS BIGINT) AS rows_below_median, count(*) AS rows_in_all
    FROM anc WHERE split = 'val' AND row_index - h >= {_WINDOW_ROWS} AND horizon_hours IN {_FITS} GROUP BY asset_id, horizon_hours
    """,
    "quantile_level",
    BACKTEST,
)
def sequence_calibration(spark, sf_dir):
    """The val rows whose residual lies within each figure: as many as the rank says."""
    fits = [f for h in LEARNED_HOURS if (f := _sequence(spark, sf_dir, h))]
    keys = [KEY, "model_id", "model_type", "horizon_hours", "n_cal", "quantile_level"]
    figures = {"interval_q": "rows_inside", "median_residual": "rows_below_median", "max_residual": "rows_in_all"}

    def held(scored):
        residual = F.abs(F.col("actual_kw") - F.col("raw_kw"))
        rows = scored.where(F.col("split") == "val").select("model_id", residual.alias("_r"))
        both = rows.join(learned.calibrate_sequence(scored), "model_id")
        return both.groupBy(*keys).agg(*[F.count_if(F.col("_r") <= F.col(c) + 1e-9).alias(n) for c, n in figures.items()])

    parts = [held(f[1]) for f in fits]
    kind = f"{KEY} string, model_id string, model_type string, horizon_hours int, n_cal long, quantile_level double"
    kind += "".join(f", {n} long" for n in figures.values())
    return _all_hours(parts, spark.createDataFrame([], kind))


_LATEST = f"""
    SELECT asset_id, CAST(horizon_hours AS INTEGER) AS horizon_hours, max("timestamp") AS last_ts, true AS {{flag}}
    FROM idx CROSS JOIN hor WHERE horizon_hours IN {_TREES_FIT} GROUP BY asset_id, horizon_hours
"""


@query("g6_boosted_latest", _LATEST.format(flag="sound"), tables=BACKTEST)
def boosted_latest(spark, sf_dir):
    """One value per asset and horizon, straight from the model of that horizon."""
    rows = _numbered(spark, sf_dir)
    parts = [
        learned.predict_latest(f[0], rows).select(
            KEY, F.lit(h).alias("horizon_hours"), "last_ts", _sound("predicted_kw", "predicted_kw", "predicted_kw")
        )
        for h in LEARNED_HOURS
        if (f := _boosted(spark, sf_dir, h))
    ]
    return _all_hours(parts, None)


def _steps_sql(model: str, where: str, checks: str) -> str:
    return f"""
    SELECT asset_id, CAST(k AS INTEGER) AS step, {_FUTURE} AS "timestamp", concat('{model}-', CAST(horizon_hours AS VARCHAR), 'h') AS model_id,
           CAST(horizon_hours AS INTEGER) AS horizon_hours, {checks}
    FROM ({_LAST}) CROSS JOIN hor CROSS JOIN range(1, 145) AS r(k) WHERE k <= h AND {where}
    """


@query(
    "g7_boosted_roll_forward",
    _steps_sql("gradient-boosting", f"horizon_hours IN {_TREES_FIT}", "true AS sound, true AS widens, CASE WHEN k = 1 THEN true END AS as_latest"),
    tables=BACKTEST,
)
def boosted_roll_forward(spark, sf_dir):
    """Every horizon's model rolled over all its steps. ``as_latest``: the first step is the model's value for the latest row."""
    rows = _numbered(spark, sf_dir)

    def shown(model):
        points = rollforward.roll_forward(model, rows)
        last = F.greatest(F.lit(1), F.col("horizon_hours") * 6 - 1)
        first = F.max(F.when(F.col("step") == 1, F.col("p90") - F.col("p50"))).over(Window.partitionBy(KEY))
        widens = F.abs((F.col("p90") - F.col("p50")) / first - (1 + (F.col("step") - 1) / last)) < 1e-3
        latest = learned.predict_latest(model, rows).select(KEY, "predicted_kw")
        same = F.when(F.col("step") == 1, F.abs(F.col("p50") - F.col("predicted_kw")) < 1e-3)
        return points.join(latest, KEY).select(
            KEY, "step", TS, "model_id", "horizon_hours", _sound(), widens.alias("widens"), same.alias("as_latest")
        )

    return _all_hours([shown(f[0]) for h in LEARNED_HOURS if (f := _boosted(spark, sf_dir, h))], None)


@query(
    "g7_direct_forecast",
    _steps_sql("gradient-boosting-direct", f"horizon_hours IN {_TREES_FIT}", "true AS sound, true AS as_the_longest"),
    tables=BACKTEST,
)
def direct_forecast(spark, sf_dir):
    """All steps of all horizons from one model with the step as input: a step's value doesn't depend on the horizon asked for.

    It learns the steps up to the longest horizon that has train rows."""
    rows = _numbered(spark, sf_dir)
    hours = [h for h in LEARNED_HOURS if _boosted(spark, sf_dir, h)]
    model = _direct(spark, sf_dir, max(hours))
    longest = rollforward.direct_forecast(model, rows, max(hours)).select(KEY, "step", F.col("p50").alias("longest_kw"))
    same = (F.abs(F.col("p50") - F.col("longest_kw")) < 1e-3).alias("as_the_longest")
    parts = [
        rollforward.direct_forecast(model, rows, h).join(longest, [KEY, "step"]).select(KEY, "step", TS, "model_id", "horizon_hours", _sound(), same)
        for h in hours
    ]
    return _all_hours(parts, None)


@query(
    "g7_direct_scores",
    """
    SELECT asset_id, count(*) AS val_rows, 6 AS step, CASE WHEN count(*) >= 100 THEN true END AS better
    FROM (SELECT i.*, b.train_end, b.val_end FROM idx i JOIN (SELECT DISTINCT asset_id, train_end, val_end FROM bnd) b ON b.asset_id = i.asset_id)
    WHERE row_index >= 48 AND row_index + 6 >= train_end AND row_index + 6 < val_end AND active_power_kw > 100 GROUP BY asset_id
    """,
)
def direct_scores(spark, sf_dir):
    """``better``: an hour ahead on the active val rows the direct model's mean error is below that of persistence."""
    rows = _numbered(spark, sf_dir)
    hours = [h for h in LEARNED_HOURS if _boosted(spark, sf_dir, h)]
    model = _direct(spark, sf_dir, max(hours))
    val = rollforward.scored_steps(model, rows, [6], "val", known=_features(spark, sf_dir)).where(F.col(POWER) > 100)
    own, base = F.avg(F.abs(F.col("actual_kw") - F.col("predicted_kw"))), F.avg(F.abs(F.col("actual_kw") - F.col(POWER)))
    return val.groupBy(KEY).agg(
        F.count("*").alias("val_rows"), F.first("step").alias("step"), F.when(F.count("*") >= COMPARED_ROWS, own < base).alias("better")
    )


@query(
    "g8_sequence_forecast",
    f"""
    SELECT asset_id, CAST(k AS INTEGER) AS step, {_FUTURE} AS "timestamp",
           concat('{learned.SEQUENCE_TYPE}-', CAST(hor.horizon_hours AS VARCHAR), 'h') AS model_id, CAST(hor.horizon_hours AS INTEGER) AS horizon_hours,
           true AS same_value
    FROM ({_LAST}) CROSS JOIN hor CROSS JOIN range(1, 145) AS r(k) WHERE k <= h AND horizon_hours IN {_FITS}
    """,
    tables=BACKTEST,
)
def sequence_forecast(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    fits = [f for h in LEARNED_HOURS if (f := _sequence(spark, sf_dir, h))]
    own = Window.partitionBy(KEY, "model_id")
    same = (F.min("p50").over(own) == F.max("p50").over(own)) & (F.col("p10") <= F.col("p90"))
    parts = [
        learned.sequence_forecast(m, rows).select(KEY, "step", TS, "model_id", "horizon_hours", same.alias("same_value"))
        for m, _ in fits
    ]
    kind = f"{KEY} string, step int, timestamp timestamp_ntz, model_id string, horizon_hours int, same_value boolean"
    return _all_hours(parts, spark.createDataFrame([], kind))


def _compared_sql(model_type: str, reach: int, where: str = "true") -> str:
    return f"SELECT asset_id, model_id, model_type, horizon_hours, actual_kw, CAST(NULL AS DOUBLE) FROM ({_tested_sql(model_type, reach, where)})"


_LEFT_OUT = f"""
    SELECT NULL AS asset_id, NULL AS model_id, '{learned.GBT_TYPE}' AS model_type, CAST(horizon_hours AS INTEGER) AS horizon_hours, 0 AS test_rows,
           CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS BOOLEAN) AS better,
           concat('no rows to train on: the look-back and ', CAST(h AS VARCHAR), ' steps ahead do not fit into the train part') AS left_out
    FROM hor WHERE horizon_hours NOT IN {_TREES_FIT}
    UNION ALL
    SELECT NULL, NULL, '{learned.SEQUENCE_TYPE}', CAST(horizon_hours AS INTEGER), 0, NULL, NULL, 'too few train windows'
    FROM hor WHERE horizon_hours NOT IN {_FITS}
"""


@query(
    "b7_model_grid",
    f"""
    SELECT asset_id, model_id, model_type, horizon_hours, count(*) AS test_rows,
           CASE WHEN model_type IN ('persistence', 'power_curve', 'rolling_mean') THEN avg(abs(actual_kw - predicted_kw)) END AS mae,
           CASE WHEN model_type IN ('{learned.GBT_TYPE}', '{learned.SEQUENCE_TYPE}') AND count(*) >= {COMPARED_ROWS} THEN true END AS better,
           CAST(NULL AS VARCHAR) AS left_out
    FROM (SELECT asset_id, model_id, model_type, horizon_hours, actual_kw, predicted_kw FROM outp
          UNION ALL {_compared_sql(learned.GBT_TYPE, _REACH, f"horizon_hours IN {_TREES_FIT}")}
          UNION ALL {_compared_sql(learned.SEQUENCE_TYPE, _WINDOW_ROWS, f"horizon_hours IN {_FITS}")})
    GROUP BY asset_id, model_id, model_type, horizon_hours
    UNION ALL {_LEFT_OUT}
    """,
    "mae",
    tables=BACKTEST,
)
def model_grid(spark, sf_dir):
    """The comparison of all five models over three horizons, each fitted with its own settings, and the models left out, with the reason.

    SQL has the baselines' errors; a learned model's is compared with that of persistence on its rows (``better``)."""
    problems: list[tuple[str, int, str]] = []
    grid = backtest.comparison(learned.grid_outputs(_numbered(spark, sf_dir), LEARNED_HOURS, problems=problems))
    learns = F.col("model_type").isin(learned.GBT_TYPE, learned.SEQUENCE_TYPE)
    table = grid.select(
        KEY, "model_id", "model_type", "horizon_hours", "test_rows", F.when(~learns, F.col("mae")).alias("mae"),
        F.when(learns & (F.col("test_rows") >= COMPARED_ROWS), F.col("skill_score") > 0).alias("better"), F.lit(None).cast("string").alias("left_out"),
    )
    nothing = F.lit(None)
    left_out = learned.problem_table(spark, problems).select(
        nothing.cast("string").alias(KEY), nothing.cast("string").alias("model_id"), "model_type", "horizon_hours", F.lit(0).cast("long").alias("test_rows"),
        nothing.cast("double").alias("mae"), nothing.cast("boolean").alias("better"), F.col("reason").alias("left_out"),
    )
    return table.unionByName(left_out)


@query("s9a_save_and_load_model", _LATEST.format(flag="equal"), tables=BACKTEST)
def save_and_load_model(spark, sf_dir):
    """A fitted model of each horizon says the same of the latest rows after a round trip through the registry."""
    rows = _numbered(spark, sf_dir)
    root = new_table_path(spark, "models")
    parts = []
    for h in LEARNED_HOURS:
        fitted = _boosted(spark, sf_dir, h)
        if fitted is None:
            continue
        model = fitted[0]
        learned.save_boosted(spark, root, f"gradient-boosting-{h}h", model)
        before = learned.predict_latest(model, rows).select(KEY, "last_ts", F.col("predicted_kw").alias("fitted_kw"))
        after = learned.predict_latest(learned.load_boosted(spark, root, f"gradient-boosting-{h}h"), rows)
        equal = F.abs(F.col("predicted_kw") - F.col("fitted_kw")) < 1e-9
        parts.append(after.join(before, [KEY, "last_ts"]).select(KEY, F.lit(h).alias("horizon_hours"), "last_ts", equal.alias("equal")))
    return _all_hours(parts, None)


_SEQUENCE_POINTS = f"""
    SELECT asset_id, CAST(k AS INTEGER) AS step, CAST(hor.horizon_hours AS INTEGER) AS horizon_hours, true AS equal
    FROM ({_LAST}) CROSS JOIN hor CROSS JOIN range(1, 145) AS r(k) WHERE k <= h AND horizon_hours IN {_FITS}
"""


@query("s9a_sequence_save_and_load", _SEQUENCE_POINTS, tables=BACKTEST)
def save_and_load_sequence(spark, sf_dir):
    """The sequence model of each horizon forecasts the same after a round trip through the registry."""
    rows = _numbered(spark, sf_dir)
    root = new_table_path(spark, "models")
    parts = []
    for h in LEARNED_HOURS:
        if fitted := _sequence(spark, sf_dir, h):
            learned.save_sequence(spark, root, f"sequence-{h}h", fitted[0])
            loaded = learned.load_sequence(spark, root, f"sequence-{h}h")
            before = learned.sequence_forecast(fitted[0], rows).select(KEY, "step", F.col("p50").alias("fitted_kw"))
            both = learned.sequence_forecast(loaded, rows).join(before, [KEY, "step"])
            parts.append(both.select(KEY, "step", "horizon_hours", (F.abs(F.col("p50") - F.col("fitted_kw")) < 1e-9).alias("equal")))
    return _all_hours(parts, spark.createDataFrame([], f"{KEY} string, step int, horizon_hours int, equal boolean"))


@query(
    "g9_trained_model",
    f"""
    SELECT asset_id, CAST(k AS INTEGER) AS step, {_FUTURE} AS "timestamp",
           CASE WHEN asset_id = 'T2' THEN 'persistence-baseline-0.1.0' ELSE 'gradient-boosting-1h' END AS model_id, 1 AS horizon_hours,
           CASE WHEN asset_id = 'T2' THEN ['{forecast.NO_MODEL_POINTS}'] ELSE CAST([] AS VARCHAR[]) END AS warnings
    FROM ({_LAST}) CROSS JOIN range(1, 7) AS r(k)
    """,
)
def choose_trained_model(spark, sf_dir):
    """The newest model of a written registry is for the horizon: its points, and persistence for an asset it lacks."""
    rows = _numbered(spark, sf_dir)
    root = new_table_path(spark, "models")
    for h, day in ((6, 1), (1, 2)):
        if fitted := _boosted(spark, sf_dir, h):
            stamp = datetime(2019, 1, day)
            registry.save_model(spark, root, f"trees-{h}h", fitted[0].pipeline, learned.GBT_TYPE, h, {}, trained_at=stamp)
    newest = registry.latest_model(registry.registry(spark, root), learned.GBT_TYPE)
    points = rollforward.roll_forward(_boosted(spark, sf_dir, newest["horizon_hours"])[0], rows).where(F.col(KEY) != "T2")
    counts = rows.groupBy(KEY).agg(F.count("*").alias("n_obs"))
    chosen = forecast.choose_forecast(forecast.persistence_forecast(rows, 1), newest["horizon_hours"], counts, 1, points)
    return chosen.select(KEY, "step", TS, "model_id", "horizon_hours", "warnings")


def forget_fits() -> None:
    """Fit anew from here on, as a benchmark must."""
    _FITTED.clear()


# ---- registry and files --------------------------------------------------------------------------


def _registry_rows(spark, sf_dir):
    """Registry rows made from the backtest: one per asset, model and horizon, with their scores."""
    scores = metrics.model_metrics(outputs(spark, sf_dir))
    kind = F.when(F.col("model_type") == "rolling_mean", F.lit("gradient_boosting")).otherwise(F.col("model_type"))
    offset = F.make_dt_interval(F.lit(0), F.lit(24) - F.col("horizon_hours"), F.substring(KEY, 2, 1).cast("int"))
    return scores.select(
        "model_id",
        kind.alias("model_type"),
        "horizon_hours",
        (F.lit(datetime(2019, 1, 1)).cast("timestamp_ntz") + offset).alias("training_timestamp"),
        F.create_map(F.lit(POWER), F.lit("double"), F.lit(WIND), F.lit("double")).alias("feature_schema"),
        "mae",
        "rmse",
        "skill_score",
        "coverage_p90",
    )


_REGISTRY = f"""
    SELECT model_id, CASE model_type WHEN 'rolling_mean' THEN 'gradient_boosting' ELSE model_type END AS model_type,
           horizon_hours, TIMESTAMP '2019-01-01 00:00:00' + to_hours(24 - horizon_hours)
             + to_minutes(CAST(substr(asset_id, 2, 1) AS BIGINT)) AS training_timestamp,
           mae, rmse, skill_score, coverage_p90 FROM ({metrics_sql()})
"""


@query(
    "s9b_latest_models",
    f"""
    SELECT model_type, arg_max(model_id, training_timestamp) AS model_id,
           max(training_timestamp) AS training_timestamp FROM ({_REGISTRY}) GROUP BY model_type
    """,
    tables=BACKTEST,
)
def latest_models(spark, sf_dir):
    return registry.latest_models(_registry_rows(spark, sf_dir))


@query("s9b_list_models", "SELECT DISTINCT model_id FROM outp", tables=BACKTEST)
def list_models(spark, sf_dir):
    return registry.list_models(registry.newest_per_id(_registry_rows(spark, sf_dir)))


@query(
    "b9_registry_table",
    f"""
    SELECT model_type, model_id AS version, horizon_hours, 2 AS feature_count, round(mae, 1) AS mae_kw,
           round(rmse, 1) AS rmse_kw, round(skill_score, 3) AS skill_score,
           round(coverage_p90*100, 1) AS coverage_pct FROM ({_REGISTRY})
    """,
    "skill_score",
    tables=BACKTEST,
)
def registry_table(spark, sf_dir):
    return reporting.registry_table(_registry_rows(spark, sf_dir))


@query("s6_s8_test_outputs", "SELECT * FROM outp", OUTPUT_DOUBLES, BACKTEST)
def test_outputs_round_trip(spark, sf_dir):
    path = new_table_path(spark, "test-outputs")
    files.save_test_outputs(outputs(spark, sf_dir), path)
    return files.load_test_outputs(spark, path)


@query("s7_s8_metrics_json", metrics_sql(), METRIC_DOUBLES, BACKTEST)
def metrics_json(spark, sf_dir):
    path = new_table_path(spark, "metrics")
    scores = metrics.model_metrics(outputs(spark, sf_dir))
    files.save_json(scores, path)
    return files.load_json(spark, path, scores.schema)


@query(
    "s7_comparison_record",
    f"""
    SELECT m.asset_id, any_value(s.rows_train) AS rows_train, any_value(s.train_end_ts) AS train_end_ts,
           count(*) AS results, min(mae) AS lowest_mae
    FROM ({metrics_sql()}) m
    JOIN (SELECT asset_id, count(CASE WHEN split = 'train' THEN 1 END) AS rows_train,
                 max(CASE WHEN split = 'train' THEN "timestamp" END) AS train_end_ts FROM sp GROUP BY asset_id) s
      ON s.asset_id = m.asset_id GROUP BY m.asset_id
    """,
    "lowest_mae",
    BACKTEST,
)
def comparison_record(spark, sf_dir):
    rows = indexed(spark, sf_dir)
    record = files.comparison_record(metrics.model_metrics(outputs(spark, sf_dir)), splits.split_summary(rows))
    path = new_table_path(spark, "comparison")
    files.save_json(record, path)
    back = files.load_json(spark, path, record.schema)
    return back.select(
        KEY,
        F.col("split.rows_train").alias("rows_train"),
        F.col("split.train_end_ts").alias("train_end_ts"),
        F.size("results").cast("long").alias("results"),
        F.array_min(F.transform("results", lambda r: r["mae"])).alias("lowest_mae"),
    )


def _responses(spark, sf_dir, *more):
    """Weather responses per asset and day, made from ``events``: a short array, a missing one, bad values."""
    events = table(spark, sf_dir, "events")
    hour = F.col("event_id") % 24
    rows = events.select(
        F.concat(F.lit("T"), (F.col("event_id") % 4 + 1).cast("string")).alias(KEY),
        F.floor(F.col("event_id") / 96).alias("day"),
        (F.floor(F.col("event_id") / 4) % 24).cast("int").alias("hour"),
        "value",
        hour.alias("direction"),
    )
    entry = F.struct("hour", "value", "direction")
    days = rows.groupBy(KEY, "day").agg(F.sort_array(F.collect_list(entry)).alias("r"))
    start = F.lit(datetime(2018, 1, 1)).cast("timestamp_ntz")

    def time_text(x):
        at = start + F.make_dt_interval(F.col("day").cast("int"), x["hour"])
        good = F.date_format(at, "yyyy-MM-dd'T'HH:mm")
        return F.when(x["hour"] == 23, F.lit("no time")).otherwise(good)

    hourly = F.struct(
        F.transform("r", time_text).alias("time"),
        F.transform("r", lambda x: x["value"].cast("string")).alias("wind_speed_10m"),
        F.slice(F.transform("r", lambda x: x["value"].cast("string")), 1, 12).alias("wind_speed_100m"),
        F.transform("r", lambda x: F.when(x["hour"] == 5, F.lit("n/a")).otherwise(x["direction"].cast("string"))).alias(
            "wind_direction_10m"
        ),
        F.transform("r", lambda x: (x["value"] / 10).cast("string")).alias("temperature_2m"),
    )
    return days.select(KEY, *more, F.to_json(F.struct(hourly.alias("hourly"))).alias("response"))


_WEATHER_OF_DAYS = """
    SELECT asset_id, day, TIMESTAMP '2018-01-01 00:00:00' + to_days(CAST(day AS INTEGER)) + to_hours(hour) AS "timestamp",
           value AS wind_speed_10m_mps, CASE WHEN place < 12 THEN value END AS wind_speed_100m_mps,
           CASE WHEN hour <> 5 THEN CAST(event_id%24 AS DOUBLE) END AS wind_direction_deg, value/1e1 AS temperature_c,
           CAST(NULL AS DOUBLE) AS pressure_hpa
    FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, day ORDER BY hour) - 1 AS place FROM
            (SELECT *, concat('T', CAST(event_id%4+1 AS VARCHAR)) AS asset_id, event_id//96 AS day,
                    (event_id//4)%24 AS hour FROM events)) WHERE hour <> 23
"""
_WEATHER = f"SELECT * EXCLUDE (day) FROM ({_WEATHER_OF_DAYS})"
_WEATHER_DOUBLES = "wind_speed_10m_mps wind_speed_100m_mps wind_direction_deg temperature_c pressure_hpa"


@query("s10_weather_json", _WEATHER, _WEATHER_DOUBLES)
def weather_json(spark, sf_dir):
    return flatten_hourly(_responses(spark, sf_dir))


def _landed_responses(spark, sf_dir, path):
    """Lands a file per response, in two parts; the stream takes what is there after each. Every fifth is laid out over many lines,
    every seventh is cut short."""
    text = F.col("response")
    parsed = F.from_json(text, RESPONSE_DDL)
    pretty = F.to_json(parsed, {"pretty": "true"})
    day = F.col("day")
    shown = F.when(day % 7 == 3, F.substring(text, F.lit(1), F.length(text) - 9)).when(day % 5 == 2, pretty).otherwise(text)
    rows = _responses(spark, sf_dir, "day").select(KEY, day.cast("string").alias("landed"), shown.alias("value"))
    landed, seen = f"{path}/landed", appending({f"{path}/rows": weather_rows, f"{path}/files": file_accounts})
    for part in (0, 1):
        own = rows.where(F.col("landed").cast("int") % 2 == part)
        land_responses(own, landed, KEY, "landed")
        stream = stream_responses(spark, landed)
        (
            stream.writeStream.option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True)
            .foreachBatch(seen).start().awaitTermination()
        )
    return weather_rows(stream).schema, file_accounts(stream).schema


@query("s10_landed_stream", f"SELECT * FROM ({_WEATHER_OF_DAYS}) WHERE day % 7 <> 3", _WEATHER_DOUBLES)
def landed_stream(spark, sf_dir):
    path = new_table_path(spark, "weather-stream")
    kind, _ = _landed_responses(spark, sf_dir, path)
    day = F.regexp_extract(FILE, r"landed=([0-9]+)/", 1).cast("long")
    return appended(spark, f"{path}/rows", kind).withColumn("day", day).drop(FILE)


@query(
    "s10_landed_files",
    """
    SELECT asset_id, day, day % 7 <> 3 AS readable, CASE WHEN day % 7 <> 3 THEN count(*) ELSE 0 END AS hours
    FROM (SELECT *, concat('T', CAST(event_id%4+1 AS VARCHAR)) AS asset_id, event_id//96 AS day FROM events) GROUP BY asset_id, day
    """,
)
def landed_files(spark, sf_dir):
    """The account of each landed file: whether it could be read, and the hours in it."""
    path = new_table_path(spark, "weather-stream")
    _, kind = _landed_responses(spark, sf_dir, path)
    day = F.regexp_extract(FILE, r"landed=([0-9]+)/", 1).cast("long")
    return appended(spark, f"{path}/files", kind).select(KEY, day.alias("day"), "readable", "hours")


@query(
    "j3_with_weather",
    f"""
    SELECT s.asset_id, s."timestamp", s.active_power_kw, w.wind_speed_100m_mps AS weather_wind_speed_100m_mps,
           w.temperature_c + CASE WHEN hour(s."timestamp") % 2 = 0 THEN 1 ELSE 0 END AS weather_temperature_c
    FROM scada s LEFT JOIN ({_WEATHER}) w ON w.asset_id = s.asset_id AND w."timestamp" = date_trunc('hour', s."timestamp")
    """,
    "active_power_kw weather_wind_speed_100m_mps weather_temperature_c",
)
def with_weather(spark, sf_dir):
    """Every second hour a later response has landed as well."""
    first = flatten_hourly(_responses(spark, sf_dir))
    half = plus_minutes(F.col(TS), F.lit(30))
    later = first.where(F.hour(TS) % 2 == 0).withColumns({TS: half, "temperature_c": F.col("temperature_c") + 1})
    joined = reporting.with_weather(scada(spark, sf_dir), first.unionByName(later))
    return joined.select(KEY, TS, POWER, "weather_wind_speed_100m_mps", "weather_temperature_c")


# ---- report tables -------------------------------------------------------------------------------


@query(
    "a16_describe",
    " UNION ALL ".join(
        f"""
        SELECT asset_id, '{c}' AS "column", count({c}) AS "count", round(avg({c}), 2) AS mean,
               round(stddev_samp({c}), 2) AS std, round(min({c}), 2) AS min, round(max({c}), 2) AS max,
               round(quantile_cont({c}, 25e-2), 2) AS p25, round(quantile_cont({c}, 5e-1), 2) AS p50,
               round(quantile_cont({c}, 75e-2), 2) AS p75 FROM scada GROUP BY asset_id
        """
        for c in MEASURES
    ),
)
def describe(spark, sf_dir):
    return reporting.describe(scada(spark, sf_dir))


@query(
    "a17_wind_histogram",
    """
    SELECT asset_id, CASE WHEN hi > lo THEN CAST(greatest(least(ceil((wind_speed_mps - lo)/(hi - lo)*20) - 1, 19), 0) AS BIGINT)
           ELSE 0 END AS bin, count(*) AS rows, min(wind_speed_mps) AS lowest, max(wind_speed_mps) AS highest
    FROM (SELECT *, min(wind_speed_mps) OVER (PARTITION BY asset_id) AS lo, max(wind_speed_mps) OVER (PARTITION BY asset_id) AS hi
          FROM (SELECT * REPLACE (CASE WHEN asset_id = 'T4' THEN 7e0 ELSE wind_speed_mps END AS wind_speed_mps) FROM scada))
    GROUP BY asset_id, bin
    """,
    "lowest highest",
)
def wind_histogram(spark, sf_dir):
    """One of the assets has the same wind all the time."""
    wind = F.when(F.col(KEY) == "T4", F.lit(7.0)).otherwise(F.col(WIND))
    return reporting.wind_histogram(scada(spark, sf_dir).withColumn(WIND, wind))


@query(
    "a18_situation",
    """
    SELECT asset_id, count(*) AS records,
           (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 86400000000 AS days,
           avg(active_power_kw)/36e2*100 AS capacity_factor_pct FROM scada GROUP BY asset_id
    """,
    "capacity_factor_pct",
)
def situation(spark, sf_dir):
    return reporting.situation(scada(spark, sf_dir))


@query(
    "o1_sorted_rows",
    'SELECT asset_id, "timestamp", active_power_kw FROM scada ORDER BY asset_id, "timestamp"',
    "active_power_kw",
)
def sorted_rows(spark, sf_dir):
    from fleetcast.operators.cleaning import sorted_rows as in_order

    return in_order(scada(spark, sf_dir)).select(KEY, TS, POWER)


@query(
    "o2_first_risks",
    f'SELECT asset_id, "timestamp", expected_shortfall_kw FROM ({_SHORTFALL}) ORDER BY "timestamp", asset_id LIMIT 10',
    "expected_shortfall_kw",
    BACKTEST,
)
def first_risks(spark, sf_dir):
    risks = risk.shortfall_risk(_forecasts(spark, sf_dir), RATED_KW)
    return reporting.first_rows(risks, 10, TS, KEY).select(KEY, TS, "expected_shortfall_kw")


@query(
    "o3_row_slice",
    'SELECT asset_id, "timestamp", active_power_kw FROM idx WHERE row_index >= 144 AND row_index < 576',
    "active_power_kw",
)
def row_slice(spark, sf_dir):
    return reporting.row_slice(indexed(spark, sf_dir), 144, 432).select(KEY, TS, POWER)


@query(
    "u3_melt",
    """
    SELECT asset_id, "timestamp", wind_speed_mps, 'active_power_kw' AS series, active_power_kw AS power FROM scada
    UNION ALL SELECT asset_id, "timestamp", wind_speed_mps, 'theoretical_power_kwh', theoretical_power_kwh FROM scada
    """,
    "wind_speed_mps power",
)
def melt(spark, sf_dir):
    rows = scada(spark, sf_dir)
    return reporting.melt(rows, [KEY, TS, WIND], [POWER, THEORETICAL])
