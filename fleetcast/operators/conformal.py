"""Split-conformal intervals and their calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.columns import coverage, inside, mae, rmse
from fleetcast.operators.metrics import MODEL_KEYS, finite_pairs
from fleetcast.operators.quantiles import group_quantiles
from fleetcast.operators.timeline import attach

COVERAGE = 0.80
TOLERANCE = 0.05


def quantile_level(target: float) -> float:
    if not 0 < target < 1:
        raise ValueError(f"the wanted coverage is {target}; it has to lie between 0 and 1")
    return target + (1 - target) / 2


def fit(
    calibration: DataFrame,
    keys: Sequence[str] = tuple(MODEL_KEYS),
    target: float = COVERAGE,
    finite_sample: bool = False,
) -> DataFrame:
    """Per key group the score quantile, the median and largest absolute residual, and the row count.

    ``finite_sample`` takes the (n+1)-corrected rank instead of the plain quantile.
    """
    level = quantile_level(target)

    def corrected(total: Column) -> Column:
        return F.least(F.ceil((total + 1) * F.lit(level)) - 1, total - 1)

    scores = finite_pairs(calibration).withColumn("_score", F.abs(F.col("actual_kw") - F.col("predicted_kw")))
    wanted = {
        "interval_q": corrected if finite_sample else level,
        "median_residual": 0.5,
        "max_residual": 1.0,
    }
    return group_quantiles(scores, list(keys), "_score", wanted, count="n_cal").withColumn(
        "quantile_level", F.lit(level)
    )


def raw_interval(point: Column, q: Column) -> tuple[Column, Column]:
    """Symmetric, without floor."""
    return point - q, point + q


def floored_interval(point: Column, q: Column) -> tuple[Column, Column]:
    """No lower end below 0, no width below 1."""
    lower = F.greatest(F.lit(0.0), point - q)
    return lower, F.greatest(lower + 1.0, point + q)


def predict_intervals(
    predictions: DataFrame, fitted: DataFrame, keys: Sequence[str] = tuple(MODEL_KEYS), target: float = COVERAGE
) -> DataFrame:
    """C2 on every row: ``p10``, ``p50``, ``p90``, ``width`` and the target coverage."""
    rows = attach(predictions.drop("p10", "p90"), fitted.select(*keys, "interval_q"), list(keys))
    lower, upper = floored_interval(F.col("predicted_kw"), F.col("interval_q"))
    return (
        rows.withColumn("p50", F.col("predicted_kw"))
        .withColumn("p10", lower)
        .withColumn("p90", upper)
        .withColumn("width", F.col("p90") - F.col("p10"))
        .withColumn("coverage_target", F.lit(target))
    )


def check_points(points: DataFrame) -> DataFrame:
    """Are the three values finite, and are they in order?"""
    big = F.lit(float("inf"))
    finite = F.lit(True)
    for c in ("p10", "p50", "p90"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < big)
    ordered = (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90"))
    return points.withColumns(
        {"points_finite": finite, "interval_valid": F.col("p10") <= F.col("p90"), "points_ordered": ordered}
    )


def evaluate(intervals: DataFrame, keys: Sequence[str] = tuple(MODEL_KEYS), target: float = COVERAGE) -> DataFrame:
    """Coverage and mean, median and largest width over finite rows."""
    rows = finite_pairs(intervals)
    keys = list(keys)
    widths = group_quantiles(rows, keys, "width", {"median_width": 0.5})
    return (
        rows.groupBy(*keys)
        .agg(
            F.avg(inside(F.col("actual_kw"), F.col("p10"), F.col("p90"))).alias("empirical_coverage"),
            F.avg("width").alias("mean_width"),
            F.max("width").alias("max_width"),
        )
        .join(widths, keys)
        .withColumn("target_coverage", F.lit(target))
    )


def calibration_metrics(
    intervals: DataFrame,
    keys: Sequence[str] = tuple(MODEL_KEYS),
    target: float = COVERAGE,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """A10, one row per key group; A12 is this table over all horizons of a model."""
    keys = list(keys)
    a, p = F.col("actual_kw"), F.col("predicted_kw")
    widths = group_quantiles(intervals, keys, "width", {"median_interval_width": 0.5})
    mean = F.col("mean_interval_width")
    return (
        intervals.groupBy(*keys)
        .agg(
            F.count("*").alias("n_samples"),
            coverage(a, F.col("p10"), F.col("p90")).alias("empirical_coverage"),
            F.avg("width").alias("mean_interval_width"),
            mae(a, p).alias("mean_absolute_error"),
            rmse(a, p).alias("rmse"),
        )
        .join(widths, keys)
        .withColumns(
            {
                "target_coverage": F.lit(target),
                "sharpness": F.when(mean > 0, F.lit(1.0) / mean).otherwise(F.lit(0.0)),
                "is_well_calibrated": F.abs(F.col("empirical_coverage") - F.lit(target)) <= F.lit(tolerance),
            }
        )
    )


def report_summary(report: DataFrame) -> DataFrame:
    """Per model the figures of each horizon as a map keyed ``"1h"``, and the overall coverage."""
    label = F.concat(F.col("horizon_hours").cast("string"), F.lit("h"))
    entry = F.struct(label.alias("key"), F.struct("n_samples", "empirical_coverage", "sharpness").alias("value"))
    rows = F.sum("n_samples")
    return report.groupBy("asset_id", "model_type").agg(
        F.count("*").alias("horizons"),
        (F.sum(F.col("empirical_coverage") * F.col("n_samples")) / rows).alias("overall_coverage"),
        (F.sum(F.col("mean_interval_width") * F.col("n_samples")) / rows).alias("mean_interval_width"),
        F.map_from_entries(F.sort_array(F.collect_set(entry))).alias("horizon_reports"),
    )
