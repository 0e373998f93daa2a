"""The sequence regression from lagged products against windows that are really built."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from fleetcast.operators.lagged import ridge, train_windows, window_moments, window_scores
from fleetcast.operators.sequences import SEQUENCE_FEATURES, sequence_samples
from fleetcast.operators.splits import named_split, row_bounds
from fleetcast.operators.timeline import with_row_index
from fleetcast.schemas import KEY, POWER

START = datetime(2018, 1, 1)
DDL = "asset_id string, timestamp timestamp_ntz, active_power_kw double, wind_speed_mps double, theoretical_power_kwh double, wind_direction_deg double"
LENGTH, STEPS = 9, 4


@pytest.fixture(scope="module")
def fleet(spark):
    """Assets of very different length: one of many chunks, one with fewer train windows than a window is long, one without any."""
    rng = random.Random(9)
    rows = []
    for asset, n in {"long": 400, "mid": 61, "few": 24, "none": 14}.items():
        power = 900.0
        for i in range(n):
            power = min(3600.0, max(0.0, power + rng.uniform(-300, 300)))
            rows.append((asset, START + timedelta(minutes=10 * i), power, power / 300 + rng.random(), rng.uniform(0, 3600), 77.0))
    return with_row_index(spark.createDataFrame(rows, DDL).repartition(5))


@pytest.fixture(scope="module")
def windows(fleet):
    samples = sequence_samples(fleet, seq_len=LENGTH, pred_len=STEPS)
    train_end, val_end = row_bounds(F.col("n_rows"))
    return samples.select(
        KEY, "sample_index", F.flatten("input_sequence").alias("x"), F.element_at("target", STEPS).alias("y"), "last_target",
        named_split(F.col("sample_index") + (LENGTH + STEPS - 1), train_end, val_end).alias("split"),
    ).cache()


@pytest.mark.parametrize("chunk_rows", [1, 16, 60, 8192])
def test_moments_equal_those_of_built_windows(fleet, windows, chunk_rows):
    rows = windows.where("split = 'train'").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    m = window_moments(fleet, SEQUENCE_FEATURES, LENGTH, STEPS, chunk_rows=chunk_rows)
    off = x - x.mean(axis=0)
    assert m.n == len(rows) and np.allclose(m.x_mean, x.mean(axis=0)) and m.y_mean == pytest.approx(y.mean())
    assert np.allclose(m.xx, off.T @ off / len(x), rtol=1e-9, atol=1e-6)
    assert np.allclose(m.xy, off.T @ (y - y.mean()) / len(x), rtol=1e-9, atol=1e-6) and m.yy == pytest.approx(y.var())


def test_weights_equal_the_fit_on_built_windows(fleet, windows):
    train = windows.where("split = 'train'").select(array_to_vector("x").alias("window"), F.col("y").alias("actual_kw"))
    built = LinearRegression(featuresCol="window", labelCol="actual_kw", regParam=1.0, elasticNetParam=0.0, standardization=True, solver="normal").fit(train)
    weights, intercept = ridge(window_moments(fleet, SEQUENCE_FEATURES, LENGTH, STEPS, chunk_rows=32), 1.0)
    assert np.allclose(weights, built.coefficients.toArray(), rtol=1e-6, atol=1e-9)
    assert intercept == pytest.approx(built.intercept, rel=1e-6)


@pytest.mark.parametrize("chunk_rows", [16, 8192])
def test_scores_equal_those_of_built_windows(fleet, windows, chunk_rows):
    weights = np.linspace(-1, 1, LENGTH * len(SEQUENCE_FEATURES))
    got = window_scores(fleet, SEQUENCE_FEATURES, weights, 5.0, LENGTH, STEPS, chunk_rows=chunk_rows).collect()
    want = {(r[KEY], r.sample_index): r for r in windows.where("split <> 'train'").collect()}
    assert len(got) == len(want)
    for r in got:
        w = want[r[KEY], r.sample_index]
        assert r.raw_kw == pytest.approx(5.0 + np.dot(weights, w.x)) and r.split == w.split
        assert (r.actual_kw, r.baseline_kw) == (w.y, w.last_target)


def test_the_fit_builds_no_windows(fleet):
    """Neither plan holds an array of a window's values, and the train part has windows only where the target fits."""
    plan = window_scores(fleet, SEQUENCE_FEATURES, np.zeros(LENGTH * 4), 0.0, LENGTH, STEPS)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    totals = {r[KEY]: r.n for r in fleet.groupBy(KEY).agg(F.max(train_windows(LENGTH, STEPS)).alias("n")).collect()}
    assert totals == {"long": 280 - 12, "mid": 42 - 12, "few": 16 - 12, "none": 0}


def test_no_train_window_and_missing_values(fleet):
    none = fleet.where(F.col(KEY) == "none")
    assert window_moments(none, SEQUENCE_FEATURES, LENGTH, STEPS).n == 0
    holes = fleet.withColumn(POWER, F.when(F.col("row_index") != 3, F.col(POWER)))
    with pytest.raises(ValueError, match="missing"):
        ridge(window_moments(holes, SEQUENCE_FEATURES, LENGTH, STEPS), 1.0)


def test_windows_carry_each_column_once(fleet):
    """The target, one of the features, went through each exchange twice."""
    plan = window_scores(fleet, SEQUENCE_FEATURES, np.zeros(LENGTH * 4), 0.0, LENGTH, STEPS)._jdf.queryExecution().executedPlan().toString()
    assert "_x0" in plan and "_y" not in plan
    other = window_scores(fleet, SEQUENCE_FEATURES[1:], np.zeros(LENGTH * 3), 2.0, LENGTH, STEPS).collect()
    want = {(r[KEY], r.sample_index): r.actual_kw for r in window_scores(fleet, SEQUENCE_FEATURES, np.zeros(LENGTH * 4), 2.0, LENGTH, STEPS).collect()}
    assert {(r[KEY], r.sample_index): r.actual_kw for r in other} == want and {r.raw_kw for r in other} == {2.0}
    without = window_moments(fleet, SEQUENCE_FEATURES[1:], LENGTH, STEPS)
    whole = window_moments(fleet, SEQUENCE_FEATURES, LENGTH, STEPS)
    held = np.arange(LENGTH * 4) % 4 > 0
    assert np.allclose(without.xx, whole.xx[np.ix_(held, held)]) and np.allclose(without.xy, whole.xy[held]) and without.yy == pytest.approx(whole.yy)
