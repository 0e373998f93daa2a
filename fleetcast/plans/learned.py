"""Models fitted on the pooled fleet: MLlib's boosted trees (B4, G6) and a ridge on sequences.

One model serves all assets of a horizon; bias and interval are taken per asset from its val rows.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.functions.columns import calendar_columns, direction_columns, floored_power, physics_columns
from fleetcast.functions.columns import plus_minutes, sample_weight
from fleetcast.operators import conformal
from fleetcast.operators.features import (
    TARGET,
    TRAINING_LAGS,
    TRAINING_WINDOWS,
    active_rows,
    feature_columns,
    supervised_features,
    supervised_for_horizons,
    supervised_rows,
    tabular_features,
)
from fleetcast.operators.lagged import ridge, train_windows, window_moments, window_scores
from fleetcast.operators.metrics import MODEL_KEYS, mean_residual, residual_p90
from fleetcast.operators.sequences import (
    PRED_LEN,
    SEQ_LEN,
    SEQUENCE_FEATURES,
    latest_sequence,
)
from fleetcast.operators.splits import DEFAULT_STEP_MINUTES, forecast_time_split, split_times
from fleetcast.operators.timeline import CHUNK_ROWS, ROW, TOTAL, attach, last_rows
from fleetcast.plans.backtest import BASELINES, baseline_outputs, horizon_steps, uniform_outputs, with_model_id
from fleetcast.schemas import KEY, MEASURES, POWER, TS, WIND
from fleetcast.session import written
from fleetcast.sources import registry

log = logging.getLogger(__name__)

FLOOR_KW = 50.0
GBT_TYPE = "gradient_boosting"
SEQUENCE_TYPE = "sequence"


@dataclass(frozen=True)
class BoostedModel:
    """A fitted tree model for one horizon, with per-asset ``bias_kw`` and ``residual_p90``."""

    pipeline: PipelineModel
    features: list[str]
    figures: DataFrame
    horizon_hours: int
    lags: Sequence[int] = TRAINING_LAGS
    windows: Sequence[int] = TRAINING_WINDOWS
    predicts_delta: bool = True


def _delta_frame(
    indexed: DataFrame, steps: int, lags, windows, step_minutes: float, complete_rows: bool, chunk_rows: int, known: DataFrame | None
) -> DataFrame:
    bounds = written(split_times(indexed), "split-times")
    if known is None:
        frame = supervised_features(indexed, steps, lags, windows, complete_rows, chunk_rows)
    else:
        frame = supervised_rows(known, steps)
    frame = forecast_time_split(frame, bounds, steps, step_minutes)
    return frame.withColumn("delta_kw", F.col(TARGET) - F.col(POWER))


def training_features(
    indexed: DataFrame,
    horizons: Sequence[int],
    lags: Sequence[int] = TRAINING_LAGS,
    windows: Sequence[int] = TRAINING_WINDOWS,
    step_minutes: float = DEFAULT_STEP_MINUTES,
    chunk_rows: int = CHUNK_ROWS,
    more_steps: Sequence[int] = (),
) -> DataFrame:
    """The features of all rows with a target per horizon, and for ``more_steps``: a written table that serves the fits of all horizons."""
    steps = sorted({*[horizon_steps(h, step_minutes) for h in horizons], *more_steps})
    return supervised_for_horizons(indexed, steps, lags, windows, chunk_rows, table="training-features")


def boosted_pipeline(features: Sequence[str], max_iter: int, max_depth: int, seed: int) -> Pipeline:
    """Trees on the absolute error of ``delta_kw``; boosting stops on the rows marked ``is_val``."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features"),
            GBTRegressor(
                labelCol="delta_kw",
                lossType="absolute",
                weightCol="weight",
                validationIndicatorCol="is_val",
                maxIter=max_iter,
                maxDepth=max_depth,
                stepSize=0.05,
                subsamplingRate=0.8,
                minInstancesPerNode=25,
                seed=seed,
            ),
        ]
    )


def learning_rows(rows: DataFrame, least: Mapping[str, int] | None = None) -> DataFrame:
    """Active train and val rows (P8) with their weights (P9); val rows are marked ``is_val``."""
    return (
        active_rows(rows.where(F.col("split") != "test"), least)
        .withColumn("is_val", F.col("split") == "val")
        .withColumn("weight", F.when(F.col("is_val"), F.lit(1.0)).otherwise(sample_weight(F.col(POWER))))
    )


def fit_boosted(
    indexed: DataFrame,
    horizon_hours: int,
    lags: Sequence[int] = TRAINING_LAGS,
    windows: Sequence[int] = TRAINING_WINDOWS,
    step_minutes: float = DEFAULT_STEP_MINUTES,
    max_iter: int = 50,
    max_depth: int = 5,
    seed: int = 42,
    complete_rows: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    known: DataFrame | None = None,
) -> tuple[BoostedModel, DataFrame]:
    """Train on the change of power over the horizon; returns the model and its test outputs.

    ``known`` may be the ``training_features`` of the same lags and windows. Raises ``ValueError`` if no asset has a train row.

    Train and val keep the active rows (P8) and weights (P9); boosting stops on the val error. The
    test rows are all rows of the test part, clipped at 0.
    """
    steps = horizon_steps(horizon_hours, step_minutes)
    frame = _delta_frame(indexed, steps, lags, windows, step_minutes, complete_rows, chunk_rows, known)
    if known is None:
        frame = written(frame, "training-frame")
    features = feature_columns(frame)
    learn = learning_rows(frame)
    if learn.where(~F.col("is_val")).isEmpty():
        raise ValueError(f"no rows to train on: the look-back and {steps} steps ahead do not fit into the train part")
    pipeline = boosted_pipeline(features, max_iter, max_depth, seed).fit(learn)
    val = _identified(pipeline.transform(learn.where("is_val")), GBT_TYPE, horizon_hours)
    raw = F.col(POWER) + F.col("prediction")
    val = written(val.select(*MODEL_KEYS, TS, F.col(TARGET).alias("actual_kw"), raw.alias("predicted_kw")), "boosted-val")
    bias = written(mean_residual(val, [KEY]), "boosted-bias")
    corrected = attach(val, bias).withColumn("predicted_kw", F.col("predicted_kw") + F.col("bias_kw"))
    band = residual_p90(corrected, [KEY], floor_kw=FLOOR_KW)
    figures = written(
        indexed.select(KEY)
        .distinct()
        .join(bias, KEY, "left")
        .join(band, KEY, "left")
        .select(
            KEY,
            F.coalesce("bias_kw", F.lit(0.0)).alias("bias_kw"),
            F.coalesce("residual_p90", F.lit(FLOOR_KW)).alias("residual_p90"),
        ),
        "boosted-figures",
    )
    model = BoostedModel(pipeline, features, figures, horizon_hours, tuple(lags), tuple(windows))
    test = attach(pipeline.transform(frame.where(F.col("split") == "test")), figures)
    predicted = F.greatest(F.lit(0.0), raw + F.col("bias_kw"))
    return model, _outputs(
        test.select(
            KEY,
            F.col("forecast_ts").alias(TS),
            F.col(TARGET).alias("actual_kw"),
            predicted.alias("predicted_kw"),
            F.col(POWER).alias("baseline_kw"),
            "residual_p90",
        ),
        GBT_TYPE,
        horizon_hours,
    )


def _identified(df: DataFrame, model_type: str, horizon_hours: int) -> DataFrame:
    named = df.withColumns({"model_type": F.lit(model_type), "horizon_hours": F.lit(horizon_hours)})
    return with_model_id(named)


def _outputs(df: DataFrame, model_type: str, horizon_hours: int) -> DataFrame:
    banded = df.withColumns(
        {
            "p10": F.greatest(F.lit(0.0), F.col("predicted_kw") - F.col("residual_p90")),
            "p90": F.col("predicted_kw") + F.col("residual_p90"),
        }
    )
    return uniform_outputs(_identified(banded, model_type, horizon_hours))


def predict_latest(model: BoostedModel, indexed: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One value per asset, ``horizon_hours`` after its latest feature row."""
    reach = max(*model.lags, *model.windows) + 1
    recent = indexed.where(F.col(ROW) >= F.col(TOTAL) - reach)
    latest = last_rows(tabular_features(recent, model.lags, model.windows, chunk_rows), 1)
    scored = attach(model.pipeline.transform(latest), model.figures)
    value = F.col("prediction") + F.col("bias_kw")
    if model.predicts_delta:
        value = value + F.col(POWER)
    return scored.select(
        KEY, F.col(TS).alias("last_ts"), F.greatest(F.lit(0.0), value).alias("predicted_kw"), "residual_p90"
    )


@dataclass(frozen=True)
class SequenceModel:
    """A linear model over flattened windows (row by row), with per-asset ``residual_p90``."""

    weights: tuple[float, ...]
    intercept: float
    figures: DataFrame
    horizon_hours: int
    seq_len: int = SEQ_LEN
    pred_len: int = PRED_LEN
    features: Sequence[str] = SEQUENCE_FEATURES


def fit_sequence(
    indexed: DataFrame,
    horizon_hours: int,
    seq_len: int = SEQ_LEN,
    reg_param: float = 1.0,
    min_train: int = 200,
    step_minutes: float = DEFAULT_STEP_MINUTES,
    chunk_rows: int = CHUNK_ROWS,
    features: Sequence[str] = SEQUENCE_FEATURES,
) -> tuple[SequenceModel, DataFrame] | None:
    """Ridge regression on standardised windows; ``None`` with fewer than ``min_train`` train windows.

    Returns the model and val and test predictions with ``split`` (T7: by the forecast row). No window is built: the
    normal equations come from sums of lagged products, and scoring is a correlation along the rows.
    """
    steps = horizon_steps(horizon_hours, step_minutes)
    totals = indexed.groupBy(KEY).agg(F.max(TOTAL).alias(TOTAL))
    if (totals.agg(F.sum(train_windows(seq_len, steps)).alias("n")).first()["n"] or 0) < min_train:
        return None
    weights, intercept = ridge(window_moments(indexed, features, seq_len, steps, chunk_rows=chunk_rows), reg_param)
    found = window_scores(indexed, features, weights, intercept, seq_len, steps, chunk_rows=chunk_rows)
    scored = _identified(found, SEQUENCE_TYPE, horizon_hours).select(
        KEY,
        plus_minutes(F.col(TS), F.lit(DEFAULT_STEP_MINUTES * (steps - 1))).alias(TS),
        "split",
        "actual_kw",
        "baseline_kw",
        "raw_kw",
        F.greatest(F.lit(0.0), F.col("raw_kw")).alias("predicted_kw"),
        "model_id",
        "model_type",
        "horizon_hours",
    )
    scored = written(scored, "sequence-scores")
    val = scored.where(F.col("split") == "val")
    band = residual_p90(val, [KEY], predicted="raw_kw", floor_kw=FLOOR_KW)
    figures = written(
        indexed.select(KEY)
        .distinct()
        .join(band, KEY, "left")
        .select(KEY, F.coalesce("residual_p90", F.lit(200.0)).alias("residual_p90")),
        "sequence-figures",
    )
    return SequenceModel(tuple(weights.tolist()), intercept, figures, horizon_hours, seq_len, steps, tuple(features)), scored


def sequence_outputs(model: SequenceModel, scored: DataFrame) -> DataFrame:
    test = attach(scored.where(F.col("split") == "test"), model.figures)
    return _outputs(
        test.select(KEY, TS, "actual_kw", "predicted_kw", "baseline_kw", "residual_p90"),
        SEQUENCE_TYPE,
        model.horizon_hours,
    )


def calibrate_sequence(scored: DataFrame, target: float = conformal.COVERAGE) -> DataFrame:
    """C4: the conformal figures of the sequence model from its val windows."""
    val = scored.where(F.col("split") == "val")
    return conformal.fit(val.withColumn("predicted_kw", F.col("raw_kw")), MODEL_KEYS, target)


def sequence_forecast(model: SequenceModel, observations: DataFrame) -> DataFrame:
    """The value from the last window of each asset, repeated for every step of the horizon."""
    latest = latest_sequence(observations, model.features, model.seq_len)
    weights = F.array(*map(F.lit, model.weights))
    terms = F.zip_with(F.flatten("input_sequence"), weights, lambda x, w: x * w)
    value = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) + F.lit(model.intercept)
    scored = latest.withColumn("prediction", value).join(model.figures, KEY)
    gap = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("before_last_ts").cast("timestamp")))
    steps = scored.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(model.pred_len))))
    return steps.select(
        KEY,
        "step",
        plus_minutes(F.col("last_ts"), F.col("step") * gap / F.lit(60e6)).alias(TS),
        F.lit(f"{SEQUENCE_TYPE}-{model.horizon_hours}h").alias("model_id"),
        F.lit(model.horizon_hours).alias("horizon_hours"),
        floored_power(F.col("prediction") - F.col("residual_p90")).alias("p10"),
        F.round("prediction", 3).alias("p50"),
        F.round(F.col("prediction") + F.col("residual_p90"), 3).alias("p90"),
    )



def save_boosted(spark: SparkSession, root: str, model_id: str, model: BoostedModel, metrics: dict | None = None) -> str:
    """The pipeline and its metadata in the registry, the per-asset figures as a table beside them."""
    config = {
        "lags": ",".join(map(str, model.lags)),
        "windows": ",".join(map(str, model.windows)),
        "predicts_delta": str(model.predicts_delta).lower(),
    }
    schema = {c: "double" for c in model.features}
    path = registry.save_model(
        spark, root, model_id, model.pipeline, GBT_TYPE, model.horizon_hours, schema, metrics, config
    )
    model.figures.write.mode("overwrite").parquet(f"{path}-figures")
    return path


def load_boosted(spark: SparkSession, root: str, model_id: str) -> BoostedModel:
    pipeline, row = registry.load_model(spark, root, model_id)
    config = row["config"]
    features = pipeline.stages[0].getInputCols()
    figures = spark.read.parquet(f"{root.rstrip('/')}/models/{model_id}-figures")
    lags, windows = (tuple(int(n) for n in config[k].split(",")) for k in ("lags", "windows"))
    return BoostedModel(
        pipeline, features, figures, row["horizon_hours"], lags, windows, config["predicts_delta"] == "true"
    )


def save_sequence(spark: SparkSession, root: str, model_id: str, model: SequenceModel, metrics: dict | None = None) -> str:
    """S9a for the sequence model, in the same registry: its weights are a table."""
    config = {"seq_len": str(model.seq_len), "pred_len": str(model.pred_len), "features": ",".join(model.features)}
    schema = {c: "double" for c in model.features}
    weights = spark.createDataFrame([(model.intercept, list(model.weights))], "intercept double, weights array<double>").coalesce(1)
    path = registry.save_model(spark, root, model_id, weights, SEQUENCE_TYPE, model.horizon_hours, schema, metrics, config)
    model.figures.write.mode("overwrite").parquet(f"{path}-figures")
    return path


def load_sequence(spark: SparkSession, root: str, model_id: str) -> SequenceModel:
    row = registry.metadata(spark, root, model_id)
    path = f"{root.rstrip('/')}/models/{model_id}"
    held, config = spark.read.parquet(path).first(), row["config"]
    return SequenceModel(
        tuple(held["weights"]), held["intercept"], spark.read.parquet(f"{path}-figures"), row["horizon_hours"], int(config["seq_len"]),
        int(config["pred_len"]), tuple(config["features"].split(",")),
    )


def problem_table(spark: SparkSession, problems: Sequence[tuple[str, int, str]]) -> DataFrame:
    """The models left out of a grid: model_type, horizon_hours, reason. A row per model and horizon at most."""
    return spark.createDataFrame(list(problems), "model_type string, horizon_hours int, reason string")


def grid_outputs(
    indexed: DataFrame,
    horizons: Sequence[int],
    models: Sequence[str] = (*BASELINES, GBT_TYPE, SEQUENCE_TYPE),
    trees: dict | None = None,
    step_minutes: float = DEFAULT_STEP_MINUTES,
    problems: list[tuple[str, int, str]] | None = None,
) -> DataFrame:
    """Test outputs of all models and horizons in one table.

    A model that cannot be fitted does not stop the others: its type, horizon and the reason are added to ``problems``,
    which ``problem_table`` shows beside the comparison.
    """
    left_out = problems if problems is not None else []
    baselines = [m for m in models if m in BASELINES]
    parts = []
    if baselines:
        parts.append(baseline_outputs(indexed, horizons=horizons, models=baselines, step_minutes=step_minutes))
    options = dict(trees or {})
    known = options.pop("known", None)
    if GBT_TYPE in models and known is None and not options.get("complete_rows"):
        sets = {k: options[k] for k in ("lags", "windows", "chunk_rows") if k in options}
        known = training_features(indexed, horizons, step_minutes=step_minutes, **sets)
    for hours in horizons:
        for name in models:
            if name in BASELINES:
                continue
            try:
                if name == GBT_TYPE:
                    part = fit_boosted(indexed, hours, step_minutes=step_minutes, known=known, **options)[1]
                else:
                    fitted = fit_sequence(indexed, hours, step_minutes=step_minutes)
                    part = None if fitted is None else sequence_outputs(*fitted)
            except (PySparkException, ValueError) as problem:
                log.warning("%s at %sh left out: %s", name, hours, problem)
                left_out.append((name, hours, str(problem).splitlines()[0]))
                continue
            if part is None:
                left_out.append((name, hours, "too few train windows"))
            else:
                parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
