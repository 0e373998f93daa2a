"""Forecasts of all steps of a horizon from boosted trees (G7): rolled forward, or directly.

Rolling forward, each predicted step becomes the next step's input. The trees of a fitted model are a small table; they are sent to the
tasks, which step through many assets at once in numpy. The plan is one pass over a row per asset, whatever the number of steps.

The direct form fits one model with the step as an input, on a spread of steps, and predicts all steps of every asset in one
transform of its latest features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.columns import AIR_DENSITY, calendar_columns, direction_columns, floored_power, plus_minutes
from fleetcast.operators.features import TARGET, TRAINING_LAGS, TRAINING_WINDOWS, feature_columns, supervised_for_horizons, tabular_features, target_of
from fleetcast.operators.metrics import residual_p90
from fleetcast.operators.splits import DEFAULT_STEP_MINUTES, forecast_time_split, split_times
from fleetcast.operators.timeline import CHUNK_ROWS, ROW, TOTAL, attach, last_rows
from fleetcast.plans.learned import FLOOR_KW, GBT_TYPE, BoostedModel, boosted_pipeline, learning_rows
from fleetcast.schemas import HORIZONS, KEY, MEASURES, POWER, TS, WIND
from fleetcast.session import new_table_path, written

#: Assets stepped through together in a task.
TOGETHER = 2048


@dataclass(frozen=True)
class Trees:
    """A boosted model as arrays over all nodes; a leaf's children are itself. ``roots`` and ``weights`` are per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The weighted sum of the trees for each row of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at] @ self.weights


def trees_of(model: BoostedModel) -> Trees:
    """The trees of the fitted pipeline, read from its saved form: at most (trees x 2^depth) rows."""
    fitted = model.pipeline.stages[-1]
    spark = model.figures.sparkSession
    path = new_table_path(spark, "trees")
    fitted.write().overwrite().save(path)
    split = F.col("nodeData.split")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    ).orderBy("treeID", "id").collect()
    first: dict[int, int] = {}
    for k, r in enumerate(rows):
        first.setdefault(r["treeID"], k)  # nodes are numbered from 0, in order, in each tree
    leaf = np.array([r["leftChild"] < 0 for r in rows])
    base, own = np.array([first[r["treeID"]] for r in rows]), np.arange(len(rows))
    left = np.where(leaf, own, base + [r["leftChild"] for r in rows])
    right = np.where(leaf, own, base + [r["rightChild"] for r in rows])
    feature = np.where(leaf, 0, [r["feature"] for r in rows])
    threshold = np.array([0.0 if r["threshold"] is None else r["threshold"] for r in rows])
    return Trees(
        feature, threshold, left, right, np.array([r["prediction"] for r in rows]), np.array(list(first.values())),
        np.array(fitted.treeWeights), max(t.depth for t in fitted.trees),
    )


def _history_features(power: np.ndarray, wind: np.ndarray, theoretical: np.ndarray, lags: Sequence[int], windows: Sequence[int]) -> dict[str, np.ndarray]:
    """The features that follow from the recent rows (one line per asset, oldest first), but for the physics."""
    out = {"persistence_kw": power[:, -1], "wind_speed_mps": wind[:, -1], "theoretical_power_kwh": theoretical}
    for name, x in (("active_power", power), ("wind_speed", wind)):
        out |= {f"{name}_lag_{k}": x[:, -1 - k] for k in lags}
        out |= {f"{name}_roll_mean_{n}": x[:, -n:].mean(axis=1) for n in windows}
    out |= {f"active_power_roll_std_{n}": power[:, -n:].std(axis=1, ddof=1) for n in windows}
    out["power_rate_of_change"] = power[:, -1] - power[:, -2]
    out["wind_speed_rate_of_change"] = wind[:, -1] - wind[:, -2]
    return out


def _physics(power: np.ndarray, wind: np.ndarray, theoretical: np.ndarray) -> dict[str, np.ndarray]:
    """``physics_columns`` of the newest rows."""
    p, w, mean, std = power[:, -1], wind[:, -1], power[:, -3:].mean(axis=1), power[:, -3:].std(axis=1, ddof=1)
    squared, cubed = w * w, w * w * w

    def ratio(top: np.ndarray, bottom: np.ndarray, where: np.ndarray, otherwise: float) -> np.ndarray:
        return np.where(where, top / np.where(where, bottom, 1.0), otherwise)

    return {
        "wind_speed_sq": squared, "wind_speed_cb": cubed, "power_curve_deviation": p - theoretical,
        "power_efficiency": ratio(p, theoretical, theoretical > 50, 1.0), "turbulence_intensity": ratio(std, mean, mean > 50, 0.0),
        "wind_power_density": 0.5 * AIR_DENSITY * cubed, "capacity_factor": ratio(p, theoretical, theoretical > 100, 0.0),
        "wind_shear_indicator": ratio(p, squared + 1, w > 3, 0.0),
    }


def roll_forward(model: BoostedModel, observations: DataFrame, horizon_hours: int | None = None) -> DataFrame:
    """Each predicted step becomes the next step's input; wind, direction and theoretical power stay as last seen.

    An asset's state is its recent rows, as many as the longest look-back; assets with fewer rows have no points. The margin grows
    from one to two times the residual over the horizon.
    """
    hours = horizon_hours or model.horizon_hours
    count = hours * 6
    keep = max(*model.lags, max(model.windows) - 1, 2) + 1
    entry = F.struct(TS, *MEASURES)
    recent = last_rows(observations.select(KEY, TS, *MEASURES), keep).groupBy(KEY)
    state = recent.agg(F.sort_array(F.collect_list(entry)).alias("_rows")).where(F.size("_rows") == keep).join(model.figures, KEY)
    last = F.element_at("_rows", -1)
    # what the calendar and the direction say of each step's input row
    steps = state.select(
        KEY, last[TS].alias("origin"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("step"), *[last[c].alias(c) for c in MEASURES]
    ).withColumn(TS, plus_minutes(F.col("origin"), F.lit(10.0) * F.col("step")))
    known = {**direction_columns(), **calendar_columns()}
    known = {k: v for k, v in known.items() if k in model.features}
    names = list(known)
    if "wind_direction_deg" in model.features:
        known["wind_direction_deg"] = F.col("wind_direction_deg")
        names = list(known)
    steps = steps.select(KEY, "step", F.array(*[known[c].cast("double") for c in names]).alias("_known"))
    by_step = steps.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("step", "_known"))).alias("_steps"))
    wide = state.join(by_step, KEY).select(
        KEY, last[TS].alias("origin"), "residual_p90", "bias_kw", last["theoretical_power_kwh"].alias("_theoretical"),
        F.transform("_rows", lambda r: r[POWER]).alias("_power"), F.transform("_rows", lambda r: r[WIND]).alias("_wind"),
        F.flatten(F.transform("_steps", lambda s: s["_known"])).alias("_known"),
    )
    trees, features, lags, windows, delta = trees_of(model), list(model.features), tuple(model.lags), tuple(model.windows), model.predicts_delta

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), TOGETHER):
                part = frame.iloc[begin : begin + TOGETHER]
                power, wind = np.stack(part["_power"]).astype(float), np.stack(part["_wind"]).astype(float)
                theoretical, bias = part["_theoretical"].to_numpy(float), part["bias_kw"].to_numpy(float)
                calendar = np.stack(part["_known"]).astype(float).reshape(len(part), count, len(names))
                path = np.empty((len(part), count))
                for k in range(count):
                    held = _history_features(power, wind, theoretical, lags, windows) | _physics(power, wind, theoretical)
                    held |= {c: calendar[:, k, i] for i, c in enumerate(names)}
                    value = trees.predict(np.stack([held[c] for c in features], axis=1)) + bias + (power[:, -1] if delta else 0.0)
                    path[:, k] = np.maximum(value, 0.0)
                    power = np.concatenate([power[:, 1:], path[:, k : k + 1]], axis=1)
                    wind = np.concatenate([wind[:, 1:], wind[:, -1:]], axis=1)
                yield part[[KEY, "origin", "residual_p90"]].assign(path=list(path))

    rolled = wide.mapInPandas(run, f"{KEY} string, origin timestamp_ntz, residual_p90 double, path array<double>")
    points = rolled.select(KEY, "origin", "residual_p90", F.posexplode("path").alias("_i", "p50"))
    margin = F.col("residual_p90") * (F.lit(1.0) + F.col("_i") / F.lit(max(1, count - 1)))
    return _points(points, margin, f"{GBT_TYPE.replace('_', '-')}-{hours}h", hours)


def _points(points: DataFrame, margin, model_id: str, hours: int) -> DataFrame:
    return points.select(
        KEY,
        (F.col("_i") + 1).alias("step"),
        plus_minutes(F.col("origin"), (F.col("_i") + 1) * F.lit(10.0)).alias(TS),
        F.lit(model_id).alias("model_id"),
        F.lit(hours).alias("horizon_hours"),
        floored_power(F.col("p50") - margin).alias("p10"),
        F.round("p50", 3).alias("p50"),
        F.round(F.col("p50") + margin, 3).alias("p90"),
    )


# Direct ----------------------------------------------------------------------------------------------

#: Steps on which the direct model is fitted; a step between two of them takes the band of the next one.
DIRECT_STEPS = (1, 3, 6, 12, 24, 36, 72, 108, 144)
STEP = "step"


@dataclass(frozen=True)
class DirectModel:
    """One model of all steps: its ``figures`` are bias_kw and residual_p90 per asset and fitted step."""

    pipeline: PipelineModel
    figures: DataFrame
    steps: tuple[int, ...]
    lags: Sequence[int] = TRAINING_LAGS
    windows: Sequence[int] = TRAINING_WINDOWS


def _long_frame(indexed: DataFrame, steps: Sequence[int], lags, windows, chunk_rows: int, known: DataFrame | None) -> DataFrame:
    """The feature rows once per step, with the step, its target and the split by the label's time.

    The rows are repeated as they are read: what is written has each feature row once, whatever the number of steps.
    """
    if known is None:
        known = supervised_for_horizons(indexed, steps, lags, windows, chunk_rows, table="direct-features")
    bounds = written(split_times(indexed), "split-times")
    targets = F.array(*[F.struct(F.lit(s).alias(STEP), F.col(target_of(s)).alias(TARGET)) for s in steps])
    others = [c for c in known.columns if not c.startswith(f"{TARGET}_")]
    long = known.select(*others, F.inline(targets)).where(F.col(TARGET).isNotNull())
    ahead = long.withColumn("_ts", F.col(TS)).withColumn(TS, plus_minutes(F.col(TS), F.col(STEP) * F.lit(DEFAULT_STEP_MINUTES)))
    split = forecast_time_split(ahead, bounds, 0).withColumn(TS, F.col("_ts")).drop("_ts")
    return split.withColumn("delta_kw", F.col(TARGET) - F.col(POWER))


def fit_direct(
    indexed: DataFrame,
    horizon_hours: int = max(HORIZONS),
    steps: Sequence[int] = DIRECT_STEPS,
    lags: Sequence[int] = TRAINING_LAGS,
    windows: Sequence[int] = TRAINING_WINDOWS,
    max_iter: int = 50,
    max_depth: int = 6,
    seed: int = 42,
    chunk_rows: int = CHUNK_ROWS,
    known: DataFrame | None = None,
) -> DirectModel:
    """Fits the change of power over all ``steps`` up to the horizon at once, split by the label's time as B4's. Raises ``ValueError`` if
    no asset has a train row. ``known`` may be written ``training_features`` with these lags, windows and steps."""
    steps = tuple(s for s in steps if s <= horizon_hours * 6)
    frame = _long_frame(indexed, steps, lags, windows, chunk_rows, known).where(F.col("split") != "test")
    learn = learning_rows(frame)
    if learn.where(~F.col("is_val")).isEmpty():
        raise ValueError("no rows to train on: the look-back and the steps ahead do not fit into the train part")
    pipeline = boosted_pipeline(feature_columns(frame), max_iter, max_depth, seed).fit(learn)
    val = pipeline.transform(learn.where("is_val")).select(
        KEY, TS, STEP, F.col(TARGET).alias("actual_kw"), (F.col(POWER) + F.col("prediction")).alias("raw_kw")
    )
    val = written(val, "direct-val")
    bias = written(val.groupBy(KEY, STEP).agg(F.avg(F.col("actual_kw") - F.col("raw_kw")).alias("bias_kw")), "direct-bias")
    corrected = attach(val, bias, [KEY, STEP]).withColumn("predicted_kw", F.col("raw_kw") + F.col("bias_kw"))
    figures = written(bias.join(residual_p90(corrected, [KEY, STEP], floor_kw=FLOOR_KW), [KEY, STEP]), "direct-figures")
    return DirectModel(pipeline, figures, steps, tuple(lags), tuple(windows))


def scored_steps(model: DirectModel, indexed: DataFrame, steps: Sequence[int], split: str, chunk_rows: int = CHUNK_ROWS, known: DataFrame | None = None) -> DataFrame:
    """The rows of one part of the split with actual_kw and predicted_kw of some fitted steps: for scores. ``known`` as in ``fit_direct``."""
    rows = _long_frame(indexed, steps, model.lags, model.windows, chunk_rows, known).where(F.col("split") == split)
    scored = attach(model.pipeline.transform(rows), model.figures, [KEY, STEP])
    predicted = F.greatest(F.lit(0.0), F.col(POWER) + F.col("prediction") + F.col("bias_kw"))
    return scored.select(KEY, TS, STEP, POWER, F.col(TARGET).alias("actual_kw"), predicted.alias("predicted_kw"))


def direct_forecast(model: DirectModel, indexed: DataFrame, horizon_hours: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """G7, direct: every step of the horizon from each asset's latest feature row, in one transform. Assets without figures have no points."""
    count = horizon_hours * 6
    reach = max(*model.lags, *model.windows) + 1
    recent = indexed.where(F.col(ROW) >= F.col(TOTAL) - reach)
    latest = last_rows(tabular_features(recent, model.lags, model.windows, chunk_rows), 1)
    rows = latest.withColumn(STEP, F.explode(F.sequence(F.lit(1), F.lit(count))))
    fitted = F.lit(model.steps[-1])
    for s in reversed(model.steps):
        fitted = F.when(F.col(STEP) <= s, F.lit(s)).otherwise(fitted)
    scored = model.pipeline.transform(rows).select(
        KEY, F.col(TS).alias("origin"), (F.col(STEP) - 1).alias("_i"), (F.col(POWER) + F.col("prediction")).alias("raw_kw"), fitted.alias("_fitted")
    )
    figures = model.figures.withColumnRenamed(STEP, "_fitted")
    found = scored.join(figures, [KEY, "_fitted"]).withColumn("p50", F.greatest(F.lit(0.0), F.col("raw_kw") + F.col("bias_kw")))
    return _points(found, F.col("residual_p90"), f"{GBT_TYPE.replace('_', '-')}-direct-{horizon_hours}h", horizon_hours)
