"""Backtests of the baselines on one shared split, all models and horizons in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetcast.functions.columns import micros
from fleetcast.operators import conformal
from fleetcast.operators.features import rolling
from fleetcast.operators.metrics import MODEL_KEYS, coverage_by_power, model_metrics, residual_p90
from fleetcast.operators.splits import DEFAULT_STEP_MINUTES, TRAIN_RATIO, VAL_RATIO, row_bounds, row_split
from fleetcast.operators.timeline import CHUNK_ROWS, ROW, TOTAL, along_timeline, attach, kept_columns
from fleetcast.schemas import HORIZONS, KEY, POWER, TEST_OUTPUT_COLUMNS, THEORETICAL, TS, WIND
from fleetcast.session import written

BASELINES = ("persistence", "power_curve", "rolling_mean")


def horizon_steps(horizon_hours: int, step_minutes: float = DEFAULT_STEP_MINUTES) -> int:
    return max(1, round(horizon_hours * 60 / step_minutes))


def anchors(
    indexed: DataFrame, steps: int, strict_step_minutes: float | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Each row with the power ``steps`` rows earlier, and its split.

    The horizon counts rows. ``strict_step_minutes`` keeps only pairs that are also exactly
    ``steps`` time steps apart, i.e. with no gap between them.
    """
    columns = {"baseline_kw": lambda w: F.lag(POWER, steps).over(w)}
    if strict_step_minutes is not None:
        columns["_base_ts"] = lambda w: F.lag(TS, steps).over(w)
    needed = kept_columns(indexed, KEY, ROW, TOTAL, TS, POWER, THEORETICAL, WIND)
    rows = row_split(along_timeline(needed, columns, steps, 0, chunk_rows)).where(F.col(ROW) >= steps)
    if strict_step_minutes is not None:
        exact = micros(F.col(TS)) - micros(F.col("_base_ts")) == int(steps * strict_step_minutes * 60e6)
        rows = rows.where(exact).drop("_base_ts")
    return rows.select(
        KEY,
        F.col(ROW).alias("idx"),
        TS,
        F.col(POWER).alias("actual_kw"),
        "baseline_kw",
        F.col(THEORETICAL).alias("theoretical_kw"),
        F.col(WIND).alias("wind_speed"),
        "split",
    )


def with_model_id(df: DataFrame) -> DataFrame:
    """``persistence-T1-6h`` and the like."""
    name = F.concat_ws(
        "-",
        F.translate("model_type", "_", "-"),
        KEY,
        F.concat(F.col("horizon_hours").cast("string"), F.lit("h")),
    )
    return df.withColumn("model_id", name)


def baseline_predictions(
    indexed: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    models: Sequence[str] = BASELINES,
    window: int = 6,
    step_minutes: float = DEFAULT_STEP_MINUTES,
    train_ratio: float = TRAIN_RATIO,
    val_ratio: float = VAL_RATIO,
    chunk_rows: int = CHUNK_ROWS,
    carry: Mapping[str, Callable[[WindowSpec], Column]] | None = None,
) -> DataFrame:
    """Val and test rows of every baseline and horizon, without intervals.

    ``carry`` adds columns of the predicted row under new names, as ``along_timeline`` takes them (they may look one row ahead). One exchange and one sort serve the whole grid: each horizon adds two window columns, and a row
    is unfolded into its (model, horizon) predictions at the end.
    """
    steps = {h: horizon_steps(h, step_minutes) for h in horizons}
    columns = {}
    for h, n in steps.items():
        columns[f"_base_{h}"] = lambda w, n=n: F.lag(POWER, n).over(w)
        if "rolling_mean" in models:
            columns[f"_roll_{h}"] = lambda w, n=n: rolling(F.avg, POWER, window, w, until=-n)
    carry = carry or {}
    needed = kept_columns(indexed, KEY, ROW, TOTAL, TS, POWER, THEORETICAL, *([WIND] if carry else []))
    back = max(steps.values()) + window - 1
    along = along_timeline(needed, {**columns, **carry}, back, 1 if carry else 0, chunk_rows)
    rows = row_split(along, train_ratio, val_ratio)
    entries = []
    for h, n in steps.items():
        predicted = {"persistence": f"_base_{h}", "power_curve": THEORETICAL, "rolling_mean": f"_roll_{h}"}
        for model in models:
            known = F.col(ROW) >= n
            if model == "rolling_mean":
                known = known & F.col(predicted[model]).isNotNull()
            entries.append(
                F.struct(
                    F.lit(model).alias("model_type"),
                    F.lit(h).alias("horizon_hours"),
                    F.col(predicted[model]).alias("predicted_kw"),
                    F.col(f"_base_{h}").alias("baseline_kw"),
                    known.alias("_known"),
                )
            )
    unfolded = rows.where(F.col("split") != "train").select(
        KEY,
        TS,
        "split",
        F.col(POWER).alias("actual_kw"),
        *carry,
        F.inline(F.array(*entries)),
    )
    return with_model_id(unfolded.where("_known").drop("_known"))


def residual_intervals(predictions: DataFrame, default_p90: float = 50.0, carried: Sequence[str] = ()) -> DataFrame:
    """Test rows with p10/p90 from the validation residuals (A8), in the uniform output shape (B6) and behind it the carried columns."""
    predictions = written(predictions, "predictions")  # the val rows are read for the bands, then the test rows
    band = residual_p90(predictions.where(F.col("split") == "val"), MODEL_KEYS)
    test = attach(predictions.where(F.col("split") == "test"), band, MODEL_KEYS)
    width = F.coalesce("residual_p90", F.lit(default_p90))
    return uniform_outputs(
        test.withColumn("p10", F.greatest(F.lit(0.0), F.col("predicted_kw") - width)).withColumn(
            "p90", F.col("predicted_kw") + width
        ),
        carried,
    )


def uniform_outputs(df: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The ten output columns behind the asset. Rows are ordered when written, not here."""
    return df.withColumn("residual_kw", F.col("actual_kw") - F.col("predicted_kw")).select(KEY, *TEST_OUTPUT_COLUMNS, *carried)


def baseline_outputs(indexed: DataFrame, **options) -> DataFrame:
    """B1-B3."""
    return residual_intervals(baseline_predictions(indexed, **options), carried=list(options.get("carry") or ()))


def comparison(outputs: DataFrame) -> DataFrame:
    """The comparison table of all models and horizons in one aggregate."""
    return model_metrics(outputs)


def split_rows(indexed: DataFrame, split: str) -> DataFrame:
    """The rows of one split as a timeline of their own: a split is contiguous, so numbers only shift."""
    train_end, val_end = row_bounds(F.col(TOTAL))
    first, end = {
        "train": (F.lit(0), train_end),
        "val": (train_end, val_end),
        "test": (val_end, F.col(TOTAL)),
    }[split]
    rows = indexed.where((F.col(ROW) >= first) & (F.col(ROW) < end))
    return rows.withColumns({ROW: F.col(ROW) - first, TOTAL: end - first})


def conformal_intervals(predictions: DataFrame, target: float = conformal.COVERAGE) -> DataFrame:
    """C1 on the val rows, C2 on the test rows."""
    predictions = written(predictions, "predictions")
    fitted = conformal.fit(predictions.where(F.col("split") == "val"), MODEL_KEYS, target)
    return conformal.predict_intervals(predictions.where(F.col("split") == "test"), fitted, MODEL_KEYS, target)


def calibration_report(
    predictions: DataFrame, target: float = conformal.COVERAGE, tolerance: float = conformal.TOLERANCE
) -> DataFrame:
    """One row per asset, model and horizon: A10 with the coverage per power regime as a map."""
    intervals = written(conformal_intervals(predictions, target), "intervals")
    entry = F.struct(F.col("power_bin").alias("key"), F.col("coverage").alias("value"))
    bins = coverage_by_power(intervals).groupBy(*MODEL_KEYS)
    by_bin = bins.agg(F.map_from_entries(F.collect_list(entry)).alias("coverage_by_power_bin"))
    return conformal.calibration_metrics(intervals, MODEL_KEYS, target, tolerance).join(by_bin, MODEL_KEYS)
