"""Scores of predictions: per model and horizon, per power regime, per window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.columns import coverage, mae, rmse, skill, smape
from fleetcast.operators.quantiles import group_quantiles, is_finite
from fleetcast.operators.timeline import CHUNK_ROWS, ROW, TOTAL, along_timeline, kept_columns
from fleetcast.schemas import KEY, POWER, THEORETICAL, TS, WIND

MODEL_KEYS = [KEY, "model_id", "model_type", "horizon_hours"]

# Power regimes in kW, lower end included.
POWER_BINS = (("low_power", 0.0, 500.0), ("medium_power", 500.0, 1500.0), ("high_power", 1500.0, 3000.0))


def model_metrics(
    outputs: DataFrame, keys: Sequence[str] = tuple(MODEL_KEYS), with_interval: bool = True, strict: bool = True
) -> DataFrame:
    """MAE, RMSE, sMAPE, skill against the baseline and interval coverage, one row per key group.

    ``strict`` fails on non-finite inputs (P14) instead of returning NaN.
    """
    a, p, b = F.col("actual_kw"), F.col("predicted_kw"), F.col("baseline_kw")
    inputs = [a, p, b] + ([F.col("p10"), F.col("p90")] if with_interval else [])
    bad = F.lit(False)
    for c in inputs:
        bad = bad | ~is_finite(c)
    aggs = [
        mae(a, p).alias("mae"),
        rmse(a, p).alias("rmse"),
        smape(a, p).alias("mape"),
        mae(a, b).alias("_baseline_mae"),
        F.count("*").alias("test_rows"),
        F.count_if(bad).alias("_bad"),
    ]
    if with_interval:
        aggs.append(coverage(a, F.col("p10"), F.col("p90")).alias("coverage_p90"))
    scored = outputs.groupBy(*keys).agg(*aggs)
    if strict:
        checked = F.when(F.col("_bad") == 0, F.col("mae")).otherwise(F.raise_error("Metric inputs must be finite"))
        scored = scored.withColumn("mae", checked)
    names = [*keys, "mae", "rmse", "mape", skill(F.col("mae"), F.col("_baseline_mae")).alias("skill_score")]
    return scored.select(*names, *(["coverage_p90"] if with_interval else []), "test_rows")


def finite_pairs(df: DataFrame, actual: str = "actual_kw", predicted: str = "predicted_kw") -> DataFrame:
    """Rows whose actual and predicted values are both finite."""
    return df.where(is_finite(F.col(actual)) & is_finite(F.col(predicted)))


def residual_p90(
    df: DataFrame,
    keys: Sequence[str],
    actual: str = "actual_kw",
    predicted: str = "predicted_kw",
    floor_kw: float = 50.0,
) -> DataFrame:
    """The 0.9 quantile of the absolute residual, never below the floor.

    Groups with no finite residual are absent: ``coalesce`` to the floor after the join.
    """
    errors = finite_pairs(df, actual, predicted).withColumn("_abs", F.abs(F.col(actual) - F.col(predicted)))
    found = group_quantiles(errors, list(keys), "_abs", {"residual_p90": 0.9})
    return found.withColumn("residual_p90", F.greatest(F.col("residual_p90"), F.lit(float(floor_kw))))


def mean_residual(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mean of actual minus predicted, used as a bias correction."""
    return df.groupBy(*keys).agg(F.avg(F.col("actual_kw") - F.col("predicted_kw")).alias("bias_kw"))


def power_curve_scores(df: DataFrame) -> DataFrame:
    """The theoretical curve against the observed power."""
    a, t = F.col(POWER), F.col(THEORETICAL)
    return (
        df.groupBy(KEY)
        .agg(mae(a, t).alias("mae"), rmse(a, t).alias("rmse"), F.avg(a).alias("_a"), F.avg(t).alias("_t"))
        .select(
            KEY,
            F.round("mae", 2).alias("mae"),
            F.round("rmse", 2).alias("rmse"),
            F.round("_a", 2).alias("actual_mean"),
            F.round("_t", 2).alias("theoretical_mean"),
            F.when(F.col("_t") > 0, F.round(F.col("_a") / F.col("_t"), 3)).otherwise(0.0).alias("capacity_ratio"),
        )
    )


def change_residual(indexed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Twice the 0.9 quantile of the absolute step changes; 200 for assets with no step."""
    changes = along_timeline(
        kept_columns(indexed, KEY, TS, POWER, ROW, TOTAL),
        {"_change": lambda w: F.abs(F.col(POWER) - F.lag(POWER).over(w))},
        back=1,
        chunk_rows=chunk_rows,
    )
    found = group_quantiles(changes, [KEY], "_change", {"_q": 0.9})
    return (
        indexed.groupBy(KEY)
        .agg(F.count("*").alias("_n"))
        .join(found, KEY, "left")
        .select(KEY, F.coalesce(F.col("_q") * 2, F.lit(200.0)).alias("residual_p90"))
    )


def best_by_mae(metrics: DataFrame, keys: Sequence[str] = ("horizon_hours",)) -> DataFrame:
    """The model with the lowest MAE per horizon; ties go to the first model type by name."""
    best = F.min(F.struct("mae", "model_type", "model_id", "skill_score")).alias("best")
    return metrics.groupBy(*keys).agg(best).select(*keys, "best.*")


def window_scores(outputs: DataFrame, start: Column, end: Column, keys: Sequence[str] = (KEY, "model_type")) -> DataFrame:
    """Rows, MAE, RMSE, bias and coverage in ``[start, end)``."""
    a, p = F.col("actual_kw"), F.col("predicted_kw")
    return (
        outputs.where((F.col(TS) >= start) & (F.col(TS) < end))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("rows"),
            F.round(mae(a, p), 1).alias("mae_kw"),
            F.round(rmse(a, p), 1).alias("rmse_kw"),
            F.round(F.avg(a - p), 1).alias("bias_kw"),
            coverage(a, F.col("p10"), F.col("p90")).alias("coverage"),
        )
    )


def power_bin(c: Column) -> Column:
    """A11 regimes; null outside all of them."""
    out = None
    for name, low, high in POWER_BINS:
        here = (c >= low) & (c < high)
        out = F.when(here, F.lit(name)) if out is None else out.when(here, F.lit(name))
    return out


def coverage_by_power(outputs: DataFrame, keys: Sequence[str] = tuple(MODEL_KEYS)) -> DataFrame:
    """Coverage per power regime; 1.0 for a regime with no rows. No join: one row, then unfolded."""
    a = F.col("actual_kw")
    hit = (a >= F.col("p10")) & (a <= F.col("p90"))
    figures, rows = [], []
    for name, low, high in POWER_BINS:
        here = (a >= low) & (a < high)
        figures += [F.count_if(here).alias(f"_n_{name}"), F.count_if(here & hit).alias(f"_hit_{name}")]
        n = F.col(f"_n_{name}")
        share = F.when(n > 0, F.col(f"_hit_{name}") / n).otherwise(F.lit(1.0))
        rows.append(F.struct(F.lit(name).alias("power_bin"), n.alias("rows"), share.alias("coverage")))
    return outputs.groupBy(*keys).agg(*figures).select(*keys, F.inline(F.array(*rows)))


def metrics_by_wind(outputs: DataFrame, observations: DataFrame | None = None, width_mps: float = 1.0, wind: str = WIND) -> DataFrame:
    """K1: scores per wind-speed bin of ``width_mps``. The outputs carry the column ``wind``, or the observations have it."""
    rows = outputs if observations is None else outputs.join(observations.select(KEY, TS, wind), [KEY, TS])
    bin_ = F.floor(F.col(wind) / F.lit(width_mps)).cast("long")
    return model_metrics(rows.withColumn("wind_bin", bin_), [*MODEL_KEYS, "wind_bin"])


def metrics_by_regime(outputs: DataFrame) -> DataFrame:
    """K3: scores per power regime; rows outside all regimes are grouped under ``above``."""
    regime = F.coalesce(power_bin(F.col("actual_kw")), F.lit("above"))
    return model_metrics(outputs.withColumn("power_bin", regime), [*MODEL_KEYS, "power_bin"])


def metrics_by_ramp(outputs: DataFrame, ramp_rows: DataFrame | None = None) -> DataFrame:
    """K2: scores inside and outside ramps. The outputs carry ``in_ramp``, or ``ramp_rows`` has (asset, timestamp, in_ramp)."""
    rows = outputs if ramp_rows is None else outputs.join(ramp_rows, [KEY, TS])
    return model_metrics(rows, [*MODEL_KEYS, "in_ramp"])


def one_step_scores(indexed: DataFrame, window: int = 6, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One-step persistence, and the mean of the previous ``window`` rows."""
    steps = along_timeline(
        indexed.select(KEY, TS, POWER, ROW, TOTAL),
        {
            "persistence": lambda w: F.lag(POWER).over(w),
            f"rolling_mean_{window}": lambda w: F.when(
                F.col(ROW) >= window, F.avg(POWER).over(w.rowsBetween(-window, -1))
            ),
        },
        back=window,
        chunk_rows=chunk_rows,
    )
    long = steps.unpivot(
        [KEY, TS, POWER], ["persistence", f"rolling_mean_{window}"], "model_type", "predicted_kw"
    ).where(F.col("predicted_kw").isNotNull())
    a, p = F.col(POWER), F.col("predicted_kw")
    return long.groupBy(KEY, "model_type").agg(
        mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), smape(a, p).alias("mape"), F.count("*").alias("rows")
    )
