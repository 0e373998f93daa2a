"""Queries over backtests, scores, intervals and their calibration."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from fleetcast.catalog.base import BACKTEST, query
from fleetcast.catalog.feature_queries import stored
from fleetcast.catalog.testview import scada
from fleetcast.operators import conformal, metrics, reporting, risk, splits
from fleetcast.operators.timeline import ROW, with_row_index
from fleetcast.plans import backtest
from fleetcast.schemas import KEY, POWER, TS, WIND


def indexed(spark, sf_dir):
    return with_row_index(scada(spark, sf_dir))


def predictions(spark, sf_dir, **options):
    return backtest.baseline_predictions(indexed(spark, sf_dir), **options)


def outputs(spark, sf_dir, **options):
    return backtest.baseline_outputs(indexed(spark, sf_dir), **options)


_SCORES = """
    avg(abs(actual_kw - predicted_kw)) AS mae,
    sqrt(avg((actual_kw - predicted_kw) * (actual_kw - predicted_kw))) AS rmse,
    coalesce(avg(CASE WHEN abs(actual_kw) + abs(predicted_kw) > 0
                      THEN 2e2 * abs(predicted_kw - actual_kw) / (abs(actual_kw) + abs(predicted_kw)) END), 0e0) AS mape
"""


def metrics_sql(source: str = "outp", extra: str = "") -> str:
    keys = "asset_id, model_id, model_type, horizon_hours" + extra
    return f"""
    SELECT {keys}, mae, rmse, mape, CASE WHEN base > 0 THEN 1e0 - mae / base END AS skill_score, coverage_p90, test_rows
    FROM (SELECT {keys}, {_SCORES}, avg(abs(actual_kw - baseline_kw)) AS base,
                 avg(CASE WHEN actual_kw BETWEEN p10 AND p90 THEN 1e0 ELSE 0e0 END) AS coverage_p90,
                 count(*) AS test_rows
          FROM {source} GROUP BY {keys})
    """


METRIC_DOUBLES = "mae rmse mape skill_score coverage_p90"
OUTPUT_DOUBLES = "actual_kw predicted_kw p10 p90 baseline_kw residual_kw"


@query("a6_model_metrics", metrics_sql(), METRIC_DOUBLES, BACKTEST)
def model_metrics(spark, sf_dir):
    return metrics.model_metrics(outputs(spark, sf_dir))


@query(
    "a5_scores_of_steps",
    f"""
    SELECT asset_id, {_SCORES} FROM (SELECT asset_id, active_power_kw AS actual_kw,
                                           theoretical_power_kwh AS predicted_kw FROM scada) GROUP BY asset_id
    """,
    "mae rmse mape",
)
def scores_of_steps(spark, sf_dir):
    from fleetcast.functions.columns import mae, rmse, smape

    a, p = F.col(POWER), F.col("theoretical_power_kwh")
    return (
        scada(spark, sf_dir)
        .groupBy(KEY)
        .agg(mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), smape(a, p).alias("mape"))
    )


@query(
    "a7_power_curve_scores",
    """
    SELECT asset_id, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(a, 2) AS actual_mean,
           round(t, 2) AS theoretical_mean, CASE WHEN t > 0 THEN round(a/t, 3) ELSE 0e0 END AS capacity_ratio
    FROM (SELECT asset_id, avg(abs(active_power_kw - theoretical_power_kwh)) AS mae,
                 sqrt(avg((active_power_kw - theoretical_power_kwh)*(active_power_kw - theoretical_power_kwh))) AS rmse,
                 avg(active_power_kw) AS a, avg(theoretical_power_kwh) AS t FROM scada GROUP BY asset_id)
    """,
)
def power_curve_scores(spark, sf_dir):
    return metrics.power_curve_scores(scada(spark, sf_dir))


@query("a8_residual_p90", "SELECT model_id, residual_p90 FROM band", "residual_p90", BACKTEST)
def residual_p90(spark, sf_dir):
    val = predictions(spark, sf_dir).where("split = 'val'")
    return metrics.residual_p90(val, metrics.MODEL_KEYS).select("model_id", "residual_p90")


@query(
    "a9_change_residual",
    """
    SELECT asset_id, 2*quantile_cont(d, 9e-1) AS residual_p90 FROM
      (SELECT asset_id, abs(active_power_kw - lag(active_power_kw) OVER (PARTITION BY asset_id ORDER BY row_index)) AS d
       FROM sp WHERE split = 'train') WHERE d IS NOT NULL GROUP BY asset_id
    """,
    "residual_p90",
)
def change_residual(spark, sf_dir):
    return metrics.change_residual(backtest.split_rows(indexed(spark, sf_dir), "train"))


_CONFORMAL = (
    BACKTEST
    + """,
fit AS (SELECT model_id, quantile_cont(abs(actual_kw - predicted_kw), 9e-1) AS interval_q,
               median(abs(actual_kw - predicted_kw)) AS median_residual,
               max(abs(actual_kw - predicted_kw)) AS max_residual, count(*) AS n_cal
        FROM pred WHERE split = 'val' GROUP BY model_id),
cin AS (SELECT *, p90 - p10 AS width FROM
         (SELECT p.*, predicted_kw AS p50, greatest(0e0, predicted_kw - interval_q) AS p10,
                 greatest(greatest(0e0, predicted_kw - interval_q) + 1e0, predicted_kw + interval_q) AS p90
          FROM pred p JOIN fit USING (model_id) WHERE split = 'test'))
"""
)


def _intervals(spark, sf_dir):
    both = predictions(spark, sf_dir).withColumns({"p10": F.lit(None).cast("double"), "p90": F.lit(None).cast("double")})
    return backtest.conformal_intervals(both)


@query(
    "c1_conformal_fit",
    "SELECT model_id, interval_q, median_residual, max_residual, n_cal FROM fit",
    "interval_q median_residual max_residual",
    _CONFORMAL,
)
def conformal_fit(spark, sf_dir):
    val = predictions(spark, sf_dir).where("split = 'val'")
    return conformal.fit(val).select("model_id", "interval_q", "median_residual", "max_residual", "n_cal")


@query(
    "c2_conformal_intervals",
    'SELECT asset_id, "timestamp", model_id, p10, p50, p90, width FROM cin',
    "p10 p50 p90 width",
    _CONFORMAL,
)
def conformal_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir).select(KEY, TS, "model_id", "p10", "p50", "p90", "width")


@query(
    "c2b_raw_intervals",
    """
    SELECT p.asset_id, p."timestamp", model_id, predicted_kw - interval_q AS lower_kw,
           predicted_kw + interval_q AS upper_kw FROM pred p JOIN fit USING (model_id) WHERE split = 'test'
    """,
    "lower_kw upper_kw",
    _CONFORMAL,
)
def raw_intervals(spark, sf_dir):
    from fleetcast.operators.timeline import attach

    both = predictions(spark, sf_dir)
    fitted = conformal.fit(both.where("split = 'val'")).select(*metrics.MODEL_KEYS, "interval_q")
    lower, upper = conformal.raw_interval(F.col("predicted_kw"), F.col("interval_q"))
    rows = attach(both.where("split = 'test'"), fitted, metrics.MODEL_KEYS)
    return rows.select(KEY, TS, "model_id", lower.alias("lower_kw"), upper.alias("upper_kw"))


@query(
    "c3_interval_evaluation",
    """
    SELECT model_id, avg(CASE WHEN actual_kw BETWEEN p10 AND p90 THEN 1e0 ELSE 0e0 END) AS empirical_coverage,
           avg(width) AS mean_width, max(width) AS max_width, median(width) AS median_width, 8e-1 AS target_coverage
    FROM cin GROUP BY model_id
    """,
    "empirical_coverage mean_width max_width median_width",
    _CONFORMAL,
)
def interval_evaluation(spark, sf_dir):
    return conformal.evaluate(_intervals(spark, sf_dir)).drop(KEY, "model_type", "horizon_hours")


_A10 = """
    SELECT asset_id, model_id, model_type, CAST(horizon_hours AS INTEGER) AS horizon_hours, n_samples,
           empirical_coverage, mean_interval_width, median_interval_width, mean_absolute_error, rmse,
           8e-1 AS target_coverage, 1e0/mean_interval_width AS sharpness,
           abs(empirical_coverage - 8e-1) <= 5e-2 AS is_well_calibrated
    FROM (SELECT asset_id, model_id, model_type, horizon_hours, count(*) AS n_samples,
                 avg(CASE WHEN actual_kw BETWEEN p10 AND p90 THEN 1e0 ELSE 0e0 END) AS empirical_coverage,
                 avg(width) AS mean_interval_width, median(width) AS median_interval_width,
                 avg(abs(actual_kw - predicted_kw)) AS mean_absolute_error,
                 sqrt(avg((actual_kw - predicted_kw)*(actual_kw - predicted_kw))) AS rmse
          FROM cin GROUP BY asset_id, model_id, model_type, horizon_hours)
"""
_A10_DOUBLES = (
    "empirical_coverage mean_interval_width median_interval_width mean_absolute_error rmse target_coverage sharpness"
)


@query("a10_calibration_metrics", _A10, _A10_DOUBLES, _CONFORMAL)
def calibration_metrics(spark, sf_dir):
    return conformal.calibration_metrics(_intervals(spark, sf_dir))


def _bins_sql(source: str) -> str:
    arms = [
        f"""SELECT asset_id, model_id, model_type, CAST(horizon_hours AS INTEGER) AS horizon_hours,
                  '{name}' AS power_bin, count(CASE WHEN actual_kw >= {low} AND actual_kw < {high} THEN 1 END) AS rows,
                  coalesce(avg(CASE WHEN actual_kw >= {low} AND actual_kw < {high} THEN
                    CASE WHEN actual_kw BETWEEN p10 AND p90 THEN 1e0 ELSE 0e0 END END), 1e0) AS coverage
           FROM {source} GROUP BY asset_id, model_id, model_type, horizon_hours"""
        for name, low, high in (("low_power", 0, 500), ("medium_power", 500, 1500), ("high_power", 1500, 3000))
    ]
    return " UNION ALL ".join(arms)


@query("a11_coverage_by_power", _bins_sql("cin"), "coverage", _CONFORMAL)
def coverage_by_power(spark, sf_dir):
    return metrics.coverage_by_power(_intervals(spark, sf_dir))


@query(
    "a12_report_summary",
    f"""
    SELECT asset_id, model_type, count(*) AS horizons,
           sum(empirical_coverage*n_samples)/sum(n_samples) AS overall_coverage,
           sum(mean_interval_width*n_samples)/sum(n_samples) AS mean_interval_width,
           max(CASE WHEN horizon_hours = 6 THEN sharpness END) AS sharpness_6h
    FROM ({_A10}) GROUP BY asset_id, model_type
    """,
    "overall_coverage mean_interval_width sharpness_6h",
    _CONFORMAL,
)
def report_summary(spark, sf_dir):
    report = conformal.report_summary(conformal.calibration_metrics(_intervals(spark, sf_dir)))
    return report.withColumn("sharpness_6h", F.col("horizon_reports")["6h"]["sharpness"]).drop("horizon_reports")


@query(
    "c5_calibration_report",
    f"""
    SELECT a.*, b.low_power, b.medium_power, b.high_power FROM ({_A10}) a JOIN
      (SELECT model_id, max(CASE WHEN power_bin = 'low_power' THEN coverage END) AS low_power,
              max(CASE WHEN power_bin = 'medium_power' THEN coverage END) AS medium_power,
              max(CASE WHEN power_bin = 'high_power' THEN coverage END) AS high_power
       FROM ({_bins_sql("cin")}) GROUP BY model_id) b ON b.model_id = a.model_id
    """,
    _A10_DOUBLES + " low_power medium_power high_power",
    _CONFORMAL,
)
def calibration_report(spark, sf_dir):
    report = backtest.calibration_report(predictions(spark, sf_dir))
    bins = [F.col("coverage_by_power_bin")[b].alias(b) for b in ("low_power", "medium_power", "high_power")]
    return report.select(*[c for c in report.columns if c != "coverage_by_power_bin"], *bins)


@query(
    "p14_finite_pairs",
    """
    SELECT asset_id, "timestamp", active_power_kw AS actual_kw, theoretical_power_kwh AS predicted_kw FROM scada
    WHERE ingest_seq % 5 <> 0 AND ingest_seq % 7 <> 0
    """,
    "actual_kw predicted_kw",
)
def finite_pairs(spark, sf_dir):
    rows = scada(spark, sf_dir).select(
        KEY,
        TS,
        F.when(F.col("ingest_seq") % 5 == 0, F.lit(float("nan"))).otherwise(F.col(POWER)).alias("actual_kw"),
        F.when(F.col("ingest_seq") % 7 == 0, F.lit(float("inf")))
        .otherwise(F.col("theoretical_power_kwh"))
        .alias("predicted_kw"),
    )
    return metrics.finite_pairs(rows)


@query(
    "p17_forecast_point_checks",
    """
    SELECT asset_id, "timestamp", model_id, true AS points_finite, p10 <= p90 AS interval_valid,
           p10 <= predicted_kw AND predicted_kw <= p90 AS points_ordered FROM outp
    """,
    tables=BACKTEST,
)
def forecast_point_checks(spark, sf_dir):
    rows = outputs(spark, sf_dir).select(KEY, TS, "model_id", "p10", F.col("predicted_kw").alias("p50"), "p90")
    return conformal.check_points(rows).drop("p10", "p50", "p90")


def _outputs_sql(model: str) -> str:
    return f'SELECT * FROM outp WHERE model_type = \'{model}\''


@query("b1_persistence", _outputs_sql("persistence"), OUTPUT_DOUBLES, BACKTEST)
def persistence(spark, sf_dir):
    return outputs(spark, sf_dir, models=["persistence"])


@query("b2_power_curve", _outputs_sql("power_curve"), OUTPUT_DOUBLES, BACKTEST)
def power_curve(spark, sf_dir):
    return outputs(spark, sf_dir, models=["power_curve"])


@query("b3_rolling_mean", _outputs_sql("rolling_mean"), OUTPUT_DOUBLES, BACKTEST)
def rolling_mean(spark, sf_dir):
    return outputs(spark, sf_dir, models=["rolling_mean"])


@query("b6_uniform_outputs", "SELECT * FROM outp", OUTPUT_DOUBLES, BACKTEST)
def uniform_outputs(spark, sf_dir):
    return outputs(spark, sf_dir)


@query("b6_stored_outputs", "SELECT * FROM outp", OUTPUT_DOUBLES, BACKTEST)
def stored_outputs(spark, sf_dir):
    """The whole backtest of the baselines from a stored timeline: its windows need no exchange."""
    return backtest.baseline_outputs(stored(spark, sf_dir)[1])


@query(
    "b8_one_step_scores",
    f"""
    SELECT asset_id, model_type, {_SCORES}, count(*) AS rows FROM
      (SELECT asset_id, active_power_kw AS actual_kw, 'persistence' AS model_type, lag(active_power_kw) OVER t
              AS predicted_kw FROM sp WHERE split = 'test' WINDOW t AS (PARTITION BY asset_id ORDER BY row_index)
       UNION ALL
       SELECT asset_id, active_power_kw, 'rolling_mean_6', CASE WHEN count(*) OVER t = 6
              THEN avg(active_power_kw) OVER t END FROM sp WHERE split = 'test'
       WINDOW t AS (PARTITION BY asset_id ORDER BY row_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
    WHERE predicted_kw IS NOT NULL GROUP BY asset_id, model_type
    """,
    "mae rmse mape",
)
def one_step_scores(spark, sf_dir):
    return metrics.one_step_scores(backtest.split_rows(indexed(spark, sf_dir), "test"))


@query(
    "b9_comparison_table",
    f"""
    SELECT asset_id, model_type, horizon_hours, round(mae, 2) AS mae_kw, round(rmse, 2) AS rmse_kw,
           round(mape, 2) AS smape_pct, round(skill_score, 3) AS skill_vs_persistence,
           round(coverage_p90*100, 1) AS coverage_pct, test_rows FROM ({metrics_sql()})
    """,
    "skill_vs_persistence",
    BACKTEST,
)
def comparison_table(spark, sf_dir):
    return reporting.comparison_table(metrics.model_metrics(outputs(spark, sf_dir)))


@query(
    "a13_best_model",
    f"""
    SELECT asset_id, horizon_hours, mae, model_type, model_id, skill_score FROM
      (SELECT *, row_number() OVER (PARTITION BY asset_id, horizon_hours ORDER BY mae, model_type) AS k
       FROM ({metrics_sql()})) WHERE k = 1
    """,
    "mae skill_score",
    BACKTEST,
)
def best_model(spark, sf_dir):
    return metrics.best_by_mae(metrics.model_metrics(outputs(spark, sf_dir)), [KEY, "horizon_hours"])


@query(
    "a14_window_scores",
    """
    SELECT asset_id, model_id, count(*) AS rows, round(avg(abs(actual_kw - predicted_kw)), 1) AS mae_kw,
           round(sqrt(avg((actual_kw - predicted_kw)*(actual_kw - predicted_kw))), 1) AS rmse_kw,
           round(avg(actual_kw - predicted_kw), 1) AS bias_kw,
           avg(CASE WHEN actual_kw BETWEEN p10 AND p90 THEN 1e0 ELSE 0e0 END) AS coverage
    FROM outp WHERE "timestamp" >= (SELECT max("timestamp") FROM scada) - to_hours(36)
                AND "timestamp" < (SELECT max("timestamp") FROM scada)
    GROUP BY asset_id, model_id
    """,
    "mae_kw rmse_kw bias_kw coverage",
    BACKTEST,
)
def window_scores(spark, sf_dir):
    """The 36 hours before the newest row."""
    newest = scada(spark, sf_dir).agg(F.max(TS)).first()[0]
    start, end = (F.lit(t).cast("timestamp_ntz") for t in (newest - timedelta(hours=36), newest))
    return metrics.window_scores(outputs(spark, sf_dir), start, end, [KEY, "model_id"])


@query(
    "a20_bias_correction",
    "SELECT model_id, avg(actual_kw - predicted_kw) AS bias_kw FROM pred WHERE split = 'val' GROUP BY model_id",
    "bias_kw",
    BACKTEST,
)
def bias_correction(spark, sf_dir):
    return metrics.mean_residual(predictions(spark, sf_dir).where("split = 'val'"), ["model_id"])


@query(
    "k1_metrics_by_wind",
    metrics_sql(
        "(SELECT o.*, CAST(floor(s.wind_speed_mps) AS BIGINT) AS wind_bin FROM outp o JOIN scada s "
        'ON s.asset_id = o.asset_id AND s."timestamp" = o."timestamp")',
        ", wind_bin",
    ),
    METRIC_DOUBLES,
    BACKTEST,
)
def metrics_by_wind(spark, sf_dir):
    return metrics.metrics_by_wind(outputs(spark, sf_dir, carry={"wind": lambda w: F.col(WIND)}), wind="wind")


_STEP = "(abs({b} - {a}) >= 500 OR ({a} > 0 AND abs(({b} - {a})/{a}*100) >= 30))"
RAMP_ROWS = f"""
    SELECT asset_id, "timestamp", coalesce({_STEP.format(a="prev", b="active_power_kw")}, false)
           OR coalesce({_STEP.format(a="active_power_kw", b="nxt")}, false) AS in_ramp
    FROM (SELECT *, lag(active_power_kw) OVER t AS prev, lead(active_power_kw) OVER t AS nxt FROM idx
          WINDOW t AS (PARTITION BY asset_id ORDER BY row_index))
"""


@query(
    "k2_metrics_by_ramp",
    metrics_sql(
        f'(SELECT o.*, r.in_ramp FROM outp o JOIN ({RAMP_ROWS}) r ON r.asset_id = o.asset_id '
        'AND r."timestamp" = o."timestamp")',
        ", in_ramp",
    ),
    METRIC_DOUBLES,
    BACKTEST,
)
def metrics_by_ramp(spark, sf_dir):
    return metrics.metrics_by_ramp(outputs(spark, sf_dir, carry={"in_ramp": risk.in_ramp()}))


@query(
    "k3_metrics_by_regime",
    metrics_sql(
        "(SELECT *, CASE WHEN actual_kw < 500 THEN 'low_power' WHEN actual_kw < 1500 THEN 'medium_power' "
        "WHEN actual_kw < 3000 THEN 'high_power' ELSE 'above' END AS power_bin FROM outp)",
        ", power_bin",
    ),
    METRIC_DOUBLES,
    BACKTEST,
)
def metrics_by_regime(spark, sf_dir):
    return metrics.metrics_by_regime(outputs(spark, sf_dir))


_SERIES_DOUBLES = "actual_kw persistence power_curve rolling_mean"


def _series_sql(cell: str) -> str:
    models = ", ".join(
        f"{cell} FILTER (WHERE model_type = '{m}') AS {m}" for m in ("persistence", "power_curve", "rolling_mean")
    )
    return f'SELECT asset_id, "timestamp", max(actual_kw) AS actual_kw, {models} FROM outp GROUP BY asset_id, "timestamp"'


def _pivoted(spark, sf_dir, **options):
    """Three values per cell, one of each horizon."""
    rows = outputs(spark, sf_dir)
    values = {"actual_kw": F.col("actual_kw"), "predicted": F.col("predicted_kw")}
    long = rows.select(
        KEY,
        TS,
        "horizon_hours",
        F.inline(
            F.array(
                F.struct(F.lit("actual_kw").alias("series"), values["actual_kw"].alias("value")),
                F.struct(F.col("model_type").alias("series"), values["predicted"].alias("value")),
            )
        ),
    )
    return reporting.pivot_series(long, _SERIES_DOUBLES.split(), **options)


@query("a15_pivot_series", _series_sql("arg_max(predicted_kw, horizon_hours)"), _SERIES_DOUBLES, BACKTEST)
def pivot_series(spark, sf_dir):
    """Of the three forecasts for one time the one made first."""
    return _pivoted(spark, sf_dir, how="last", order="horizon_hours")


@query("a15_pivot_mean", _series_sql("avg(predicted_kw)"), _SERIES_DOUBLES, BACKTEST)
def pivot_mean(spark, sf_dir):
    return _pivoted(spark, sf_dir, how="mean")


@query(
    "u2_error_series",
    """
    SELECT asset_id, "timestamp", actual_kw - predicted_kw AS error_kw, model_id AS series FROM outp
    """,
    "error_kw",
    BACKTEST,
)
def error_series(spark, sf_dir):
    return reporting.error_series(outputs(spark, sf_dir), "model_id")


_U1 = """
    SELECT asset_id, "timestamp", active_power_kw AS value, 'Observed history' AS series, 'history' AS kind
    FROM sp WHERE row_index >= val_end - 144 AND row_index < val_end
    UNION ALL SELECT asset_id, "timestamp", active_power_kw, 'Gold data', 'actual' FROM sp WHERE split = 'test'
    UNION ALL SELECT asset_id, "timestamp", predicted_kw, model_id, 'model' FROM outp
"""


@query("u1_j4_long_series", _U1, "value", BACKTEST)
def long_series(spark, sf_dir):
    rows = splits.row_split(indexed(spark, sf_dir))
    _, val_end = splits.row_bounds(F.col("n_rows"))
    history = rows.where((F.col(ROW) >= val_end - 144) & (F.col(ROW) < val_end))
    points = outputs(spark, sf_dir)
    return reporting.long_series(history, rows.where("split = 'test'"), points, "model_id", "predicted_kw")


@query(
    "j1_forecast_against_actual",
    """
    SELECT asset_id, model_type, CAST(horizon_hours AS INTEGER) AS horizon_hours, count(*) AS rows,
           avg(abs(actual_kw - predicted_kw)) AS mae,
           sqrt(avg((actual_kw - predicted_kw)*(actual_kw - predicted_kw))) AS rmse,
           avg(CASE WHEN actual_kw BETWEEN p10 AND p90 THEN 1e0 ELSE 0e0 END) AS coverage
    FROM outp GROUP BY asset_id, model_type, horizon_hours
    """,
    "mae rmse coverage",
    BACKTEST,
)
def forecast_against_actual(spark, sf_dir):
    points = outputs(spark, sf_dir).select(
        KEY, TS, "model_type", "horizon_hours", "p10", F.col("predicted_kw").alias("p50"), "p90"
    )
    aligned = reporting.forecast_against_actual(points, scada(spark, sf_dir))
    return reporting.alignment_scores(aligned, [KEY, "model_type", "horizon_hours"])
