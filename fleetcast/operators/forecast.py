"""Forecast points after the last row of each asset, from baselines (G1-G5) and the choice of model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.columns import clipped_power, floored_power, plus_minutes
from fleetcast.operators.metrics import change_residual
from fleetcast.operators.splits import cadence
from fleetcast.operators.timeline import CHUNK_ROWS, last_rows
from fleetcast.schemas import HORIZONS, KEY, POWER, THEORETICAL, TS

PERSISTENCE_ID = "persistence-baseline-0.1.0"
ROLLING_MEAN_ID = "rolling-mean-baseline-0.1.0"
# Fixed value: the text of a warning in the output.
SHORT_HISTORY = "Very short observation history; uncertainty band is approximate."

NO_MODEL_POINTS = "The trained model gave no points for this asset; using persistence."


def check_horizon(horizon_hours: int) -> int:
    if horizon_hours not in HORIZONS:
        raise ValueError(f"{horizon_hours} h is no known horizon; there are {sorted(HORIZONS)}")
    return horizon_hours


def _recent(df: DataFrame, n: int, *figures: Column) -> DataFrame:
    return (
        last_rows(df.select(KEY, TS, POWER, THEORETICAL), n)
        .groupBy(KEY)
        .agg(
            F.max(TS).alias("last_ts"),
            F.max_by(POWER, TS).alias("last_power"),
            F.max_by(THEORETICAL, TS).alias("last_theoretical"),
            F.count("*").alias("n_recent"),
            *figures,
        )
    )


def _points(latest: DataFrame, count: Column, step_minutes: Column, *columns: Column) -> DataFrame:
    """``count`` future rows per asset, ``step_minutes`` apart."""
    steps = latest.withColumn("step", F.explode(F.sequence(F.lit(1), count.cast("int"))))
    return steps.select(
        KEY, "step", plus_minutes(F.col("last_ts"), F.col("step") * step_minutes).alias(TS), *columns
    )


def persistence_forecast(
    indexed: DataFrame, horizon_hours: int, rated_kw: float | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """G1: the last power, with a band from the spread of the last 18 rows, at the asset's own cadence."""
    hours = check_horizon(horizon_hours)
    spread = F.when(F.count(POWER) >= 2, F.stddev_pop(POWER)).otherwise(F.lit(0.0)).alias("variability")
    latest = _recent(indexed, 18, spread).join(cadence(indexed, upper=True, chunk_rows=chunk_rows), KEY)
    band = F.greatest(F.lit(50.0), F.col("last_power") * 0.1, F.col("variability") * 1.28)
    count = F.greatest(F.lit(1), F.floor(F.lit(hours * 60) / F.col("step_minutes")))
    p50 = clipped_power(F.col("last_power"), rated_kw)
    warnings = F.when(F.col("n_recent") < 3, F.array(F.lit(SHORT_HISTORY))).otherwise(F.array().cast("array<string>"))
    return _points(
        latest,
        count,
        F.col("step_minutes"),
        F.lit(PERSISTENCE_ID).alias("model_id"),
        F.lit(hours).alias("horizon_hours"),
        clipped_power(p50 - band, rated_kw).alias("p10"),
        p50.alias("p50"),
        clipped_power(p50 + band, rated_kw).alias("p90"),
        warnings.alias("warnings"),
    )


def _band_points(
    latest: DataFrame, model_id: str, hours: int, value: Column, residual: Column, step_minutes: float
) -> DataFrame:
    count = F.lit(max(1, round(hours * 60 / step_minutes)))
    return _points(
        latest,
        count,
        F.lit(float(step_minutes)),
        F.lit(model_id).alias("model_id"),
        F.lit(hours).alias("horizon_hours"),
        floored_power(value - residual).alias("p10"),
        F.round(value, 3).alias("p50"),
        F.round(value + residual, 3).alias("p90"),
    )


def residual_persistence_forecast(
    observations: DataFrame, indexed_train: DataFrame, horizon_hours: int = 6, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The last power, with the step-change residual (A9) learnt on the train rows."""
    latest = _recent(observations, 1).join(change_residual(indexed_train, chunk_rows), KEY, "left")
    residual = F.coalesce("residual_p90", F.lit(200.0))
    return _band_points(latest, PERSISTENCE_ID, horizon_hours, F.col("last_power"), residual, 10.0)


def rolling_mean_forecast(observations: DataFrame, horizon_hours: int, window_hours: int = 1) -> DataFrame:
    """The mean of the last ``6 * window_hours`` rows, with 1.645 deviations either side."""
    latest = _recent(
        observations,
        window_hours * 6,
        F.avg(POWER).alias("mean_power"),
        F.when(F.count("*") > 1, F.stddev_pop(POWER) * 1.645).otherwise(F.lit(200.0)).alias("residual_p90"),
    )
    return _band_points(
        latest, ROLLING_MEAN_ID, horizon_hours, F.col("mean_power"), F.col("residual_p90"), 10.0
    )


def power_curve_forecast(df: DataFrame) -> DataFrame:
    """The theoretical power itself."""
    return df.select(KEY, TS, F.col(THEORETICAL).alias("predicted_kw"))


def three_baselines(observations: DataFrame, horizon_hours: int, step_minutes: float = 10.0) -> DataFrame:
    """Last power, last theoretical power and mean of the last 36 rows, with one common band."""
    deviation = F.when(F.count("*") >= 6, F.stddev_samp(POWER)).otherwise(F.lit(200.0))
    latest = _recent(
        observations,
        36,
        F.avg(POWER).alias("mean_power"),
        F.greatest(F.lit(50.0), deviation * 1.5).alias("residual"),
    )
    values = {"persistence": "last_power", "power_curve": "last_theoretical", "rolling_mean": "mean_power"}
    entries = [F.struct(F.lit(m).alias("model_id"), F.col(c).alias("value")) for m, c in values.items()]
    each = latest.select(KEY, "last_ts", "residual", F.inline(F.array(*entries)))
    return _points(
        each,
        F.lit(max(1, round(horizon_hours * 60 / step_minutes))),
        F.lit(float(step_minutes)),
        "model_id",
        F.lit(horizon_hours).alias("horizon_hours"),
        floored_power(F.col("value") - F.col("residual")).alias("p10"),
        F.round("value", 3).alias("p50"),
        F.round(F.col("value") + F.col("residual"), 3).alias("p90"),
    )


def choose_forecast(
    persistence: DataFrame,
    trained_hours: int | None,
    observation_counts: DataFrame,
    horizon_hours: int,
    model_points: DataFrame | None = None,
) -> DataFrame:
    """The trained model's points where its horizon matches, persistence with a warning otherwise, also for an
    asset of which the model gave no points.

    ``trained_hours`` is the horizon of the registry's newest model, ``None`` without one;
    ``observation_counts`` has (asset, n_obs): a warning needs at least 10 observations.
    """
    fallback = persistence
    if trained_hours is not None and trained_hours != horizon_hours:
        text = f"ML model trained for {trained_hours}h horizon; using persistence for {horizon_hours}h."
        extended = F.when(F.col("n_obs") >= 10, F.array_append("warnings", F.lit(text))).otherwise(F.col("warnings"))
        fallback = persistence.join(observation_counts, KEY).withColumn("warnings", extended).drop("n_obs")
    if model_points is None or trained_hours != horizon_hours:
        return fallback
    own = model_points.withColumn("warnings", F.array().cast("array<string>")).select(*fallback.columns)
    without = fallback.join(model_points.select(KEY).distinct(), KEY, "left_anti").join(observation_counts, KEY)
    told = F.array_append("warnings", F.lit(NO_MODEL_POINTS))
    without = without.withColumn("warnings", F.when(F.col("n_obs") >= 10, told).otherwise(F.col("warnings"))).drop("n_obs")
    return own.unionByName(without.select(*fallback.columns))


def nested_forecast(points: DataFrame) -> DataFrame:
    """One row per asset and model with its points as an array, in step order."""
    point = F.struct("step", TS, "p10", "p50", "p90")
    return points.groupBy(KEY, "model_id", "horizon_hours").agg(
        F.sort_array(F.collect_list(point)).alias("forecast")
    )
