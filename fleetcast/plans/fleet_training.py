"""Training a fleet of assets of very different length (B4's older form, driven by F4).

Every asset takes the largest lag set that leaves it rows enough; assets with the same set share a model. The split goes by row
number over the feature rows (T3), or sets a tail aside (T4). An asset without outputs has a status row that says why.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.operators.features import (
    FALLBACK_SETS,
    TARGET,
    active_rows,
    feature_columns,
    feature_set_choice,
    supervised_for_horizons,
    supervised_rows,
)
from fleetcast.operators.metrics import MODEL_KEYS, mean_residual, residual_p90
from fleetcast.operators.splits import DEFAULT_STEP_MINUTES, TRAIN_RATIO, VAL_RATIO, row_split, tail_split
from fleetcast.operators.timeline import CHUNK_ROWS, ROW, TOTAL, attach
from fleetcast.plans.backtest import horizon_steps, uniform_outputs, with_model_id
from fleetcast.plans.learned import FLOOR_KW, GBT_TYPE, boosted_pipeline, learning_rows
from fleetcast.schemas import HORIZONS, KEY, POWER, TEST_OUTPUT_SCHEMA, TS
from fleetcast.session import written

MIN_FEATURE_ROWS = 10
#: Active rows a part must have for the others to be left out.
LEAST_ACTIVE = {"train": 100, "val": 50, "test": 50}
TRAINED = "trained"


@dataclass(frozen=True)
class FleetTraining:
    """``models`` by (horizon, feature set); test ``outputs`` in the uniform shape; a ``status`` row per asset and horizon:
    feature_set, lags, windows, feature_rows, train_rows, val_rows, test_rows (all of the part, 0 without a model), reason."""

    models: dict[tuple[int, int], PipelineModel]
    outputs: DataFrame
    status: DataFrame


def _reason() -> Column:
    """Why an asset gets no model, from its number of feature rows; null if it gets one."""
    n = F.coalesce(F.col("feature_rows"), F.lit(0))
    few = F.concat(F.lit("too few feature rows: "), n.cast("string"), F.lit(f" of {MIN_FEATURE_ROWS}"))
    empty = F.least(*[F.coalesce(f"{s}_rows", F.lit(0)) for s in ("train", "val", "test")]) == 0
    return F.when(n < MIN_FEATURE_ROWS, few).when(empty, F.lit("a part of the split is empty"))


def _split(frame: DataFrame, test_start: float | None) -> DataFrame:
    """T3 or T4 on feature rows numbered by ROW of TOTAL; too short assets have no split."""
    if test_start is not None:
        return tail_split(frame, test_start)
    return row_split(frame, TRAIN_RATIO, VAL_RATIO, min_rows=2, strict=False).drop("split_problem")


def train_fleet(
    indexed: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    test_start: float | None = None,
    step_minutes: float = DEFAULT_STEP_MINUTES,
    max_iter: int = 50,
    max_depth: int = 4,
    seed: int = 42,
    chunk_rows: int = CHUNK_ROWS,
) -> FleetTraining:
    """Fits one model per horizon and lag set in use, at most four a horizon, and scores each asset's test part.

    ``test_start`` (a share of the rows) sets the tail from there aside as test (T4). Bias and band come per asset from its val
    rows; the band is that of the residuals before the bias. Test rows are stamped with the time they are predicted from, and
    their power is the baseline; predictions aren't cut at 0, their lower bounds are.
    """
    steps = {h: horizon_steps(h, step_minutes) for h in horizons}
    choices = {h: written(feature_set_choice(indexed, n, MIN_FEATURE_ROWS), "fleet-choice") for h, n in steps.items()}
    used = {h: sorted(r[0] for r in c.select("feature_set").distinct().collect()) for h, c in choices.items()}  # four at most
    frames: dict[int, DataFrame] = {}
    for i in sorted({i for sets in used.values() for i in sets}):
        own = [h for h in steps if i in used[h]]
        assets = choices[own[0]].where(F.col("feature_set") == i).select(KEY)
        for h in own[1:]:
            assets = assets.unionByName(choices[h].where(F.col("feature_set") == i).select(KEY))
        rows = indexed.join(assets.distinct(), KEY, "left_semi")
        lags, windows = FALLBACK_SETS[i]
        frames[i] = supervised_for_horizons(rows, [steps[h] for h in own], lags, windows, chunk_rows, table="fleet-features")
    models, outputs, status = {}, [], []
    for h, n in steps.items():
        for i in used[h]:
            chosen = choices[h].where(F.col("feature_set") == i)
            rows = supervised_rows(frames[i], n).join(chosen.select(KEY), KEY, "left_semi")
            # the last n of an asset's complete rows have no target
            split = _split(rows.withColumn(TOTAL, F.col(TOTAL) - n), test_start)
            parts = [F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")]
            counts = split.groupBy(KEY).agg(F.count("*").alias("feature_rows"), *parts)
            known = chosen.join(counts, KEY, "left").withColumns({"reason": _reason(), "horizon_hours": F.lit(h)})
            known = written(known, "fleet-status")
            fit = split.join(known.where(F.col("reason").isNull()).select(KEY), KEY, "left_semi")
            fit = fit.withColumn("delta_kw", F.col(TARGET) - F.col(POWER))  # small tables joined to written features: no need to write it
            status.append(known)
            if fit.isEmpty():
                continue
            features = feature_columns(fit)
            learn = learning_rows(fit, LEAST_ACTIVE)
            model = models[h, i] = boosted_pipeline(features, max_iter, max_depth, seed).fit(learn)
            outputs.append(_scored(model, fit, learn, h))
    known = status[0]
    for more in status[1:]:
        known = known.unionByName(more)
    zero = {f"{s}_rows": F.when(F.col("reason").isNull(), F.col(f"{s}_rows")).otherwise(0) for s in ("train", "val", "test")}
    zero["feature_rows"] = F.coalesce("feature_rows", F.lit(0))
    known = known.withColumns({**zero, "reason": F.coalesce("reason", F.lit(TRAINED)), "model_type": F.lit(GBT_TYPE)}).drop(TOTAL)
    scored = indexed.sparkSession.createDataFrame([], TEST_OUTPUT_SCHEMA)
    for part in outputs:
        scored = scored.unionByName(part)
    return FleetTraining(models, scored, known)


def _scored(model: PipelineModel, frame: DataFrame, learn: DataFrame, hours: int) -> DataFrame:
    """Test outputs of one model."""

    def identified(df: DataFrame) -> DataFrame:
        return with_model_id(df.withColumns({"model_type": F.lit(GBT_TYPE), "horizon_hours": F.lit(hours)}))

    raw = (F.col(POWER) + F.col("prediction")).alias("predicted_kw")
    val = identified(model.transform(learn.where("is_val"))).select(*MODEL_KEYS, TS, F.col(TARGET).alias("actual_kw"), raw)
    val = written(val, "fleet-val")
    figures = written(
        mean_residual(val, [KEY]).join(residual_p90(val, [KEY], floor_kw=FLOOR_KW), KEY), "fleet-figures"
    )
    test = active_rows(frame.where(F.col("split") == "test"), LEAST_ACTIVE)
    scored = attach(identified(model.transform(test)), figures)
    predicted = F.col(POWER) + F.col("prediction") + F.col("bias_kw")
    rows = scored.select(
        *MODEL_KEYS, TS, F.col(TARGET).alias("actual_kw"), predicted.alias("predicted_kw"), F.col(POWER).alias("baseline_kw"), "residual_p90"
    )
    return uniform_outputs(
        rows.withColumns({
            "p10": F.greatest(F.lit(0.0), F.col("predicted_kw") - F.col("residual_p90")),
            "p90": F.col("predicted_kw") + F.col("residual_p90"),
        })
    )
