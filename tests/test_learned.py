"""Fitted models end to end on a small fleet: train, save, load, forecast."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcast import session
from fleetcast.operators import metrics
from fleetcast.operators.features import tabular_features
from fleetcast.operators.timeline import last_rows, with_row_index
from fleetcast.plans import backtest, learned, rollforward
from fleetcast.schemas import KEY, TEST_OUTPUT_COLUMNS, TS
from fleetcast.sources import outputs, registry

START = datetime(2018, 1, 1)
DDL = (
    "asset_id string, timestamp timestamp_ntz, active_power_kw double, wind_speed_mps double, "
    "theoretical_power_kwh double, wind_direction_deg double"
)


@pytest.fixture(scope="module")
def fleet(spark):
    rows = []
    for a in ("T1", "T2"):
        for i in range(360):
            power = 1500 + 1200 * math.sin(2 * math.pi * i / 72) + 5 * (i % 3)
            rows.append((a, START + timedelta(minutes=10 * i), power, 5 + power / 400, power * 1.05, 110.0 + i % 10))
    return with_row_index(spark.createDataFrame(rows, DDL))


@pytest.fixture(scope="module")
def trees(fleet):
    return learned.fit_boosted(
        fleet, 1, lags=(1, 3, 6), windows=(3, 6), max_iter=8, max_depth=3, complete_rows=True, chunk_rows=128
    )


def test_boosted_outputs(trees, fleet):
    _, out = trees
    assert out.columns == [KEY, *TEST_OUTPUT_COLUMNS]
    persistence = backtest.baseline_outputs(fleet, horizons=[1], models=["persistence"])
    own = metrics.model_metrics(out, ["model_type"]).first()
    base = metrics.model_metrics(persistence, ["model_type"]).first()
    assert own["mae"] < base["mae"] and own["skill_score"] > 0 and own["coverage_p90"] > 0.5
    assert out.where("p10 < 0 OR p10 > predicted_kw OR predicted_kw > p90").count() == 0


def test_round_trip_through_the_registry(spark, trees, fleet, tmp_path):
    model, _ = trees
    root = str(tmp_path)
    learned.save_boosted(spark, root, "gbt-1h", model, {"mae": 1.0})
    learned.save_boosted(spark, root, "gbt-1h", model, {"mae": 2.0})
    rows = registry.registry(spark, root)
    assert rows.count() == 1 and rows.first()["mae"] == 2.0
    assert registry.latest_model(rows, "gradient_boosting")["model_id"] == "gbt-1h"
    assert registry.latest_model(rows, "sequence") is None
    with pytest.raises(FileNotFoundError):
        registry.load_model(spark, root, "none")
    back = learned.load_boosted(spark, root, "gbt-1h")
    assert sorted(learned.predict_latest(back, fleet).collect()) == sorted(learned.predict_latest(model, fleet).collect())


def test_first_rolled_step_is_the_latest_prediction(trees, fleet):
    model, _ = trees
    latest = {r[KEY]: r["predicted_kw"] for r in learned.predict_latest(model, fleet).collect()}
    points = rollforward.roll_forward(model, fleet).collect()
    assert len(points) == 12
    for p in points:
        if p["step"] == 1:
            assert p["p50"] == pytest.approx(latest[p[KEY]], abs=1e-3)
            first_width = p["p90"] - p["p50"]
        assert p[TS] == START + timedelta(minutes=10 * (359 + p["step"]))
    last = [p for p in points if p["step"] == 6 and p[KEY] == points[0][KEY]][0]
    assert last["p90"] - last["p50"] == pytest.approx(2 * first_width, rel=0.5)


def test_each_rolled_step_is_the_next_steps_input(spark, trees, fleet):
    """Predicting the latest row, appending it and predicting again gives the same path."""
    model, _ = trees
    rolled = {(r[KEY], r["step"]): r["p50"] for r in rollforward.roll_forward(model, fleet, horizon_hours=6).collect()}
    assert len(rolled) == 2 * 36
    seen = [tuple(r) for r in fleet.drop("row_index", "n_rows").collect()]
    for step in range(1, 5):
        latest = learned.predict_latest(model, with_row_index(spark.createDataFrame(seen, DDL))).collect()
        for r in latest:
            assert rolled[r[KEY], step] == pytest.approx(r["predicted_kw"], abs=2e-3)
            last = max((x for x in seen if x[0] == r[KEY]), key=lambda x: x[1])
            seen.append((last[0], last[1] + timedelta(minutes=10), r["predicted_kw"], *last[3:]))


def test_trees_as_arrays_predict_as_the_pipeline(trees, fleet):
    model, _ = trees
    rows = model.pipeline.transform(tabular_features(fleet, model.lags, model.windows)).select("prediction", *model.features).collect()
    got = rollforward.trees_of(model).predict(np.array([[r[c] for c in model.features] for r in rows], float))
    assert np.allclose(got, [r["prediction"] for r in rows], rtol=1e-9, atol=1e-9)


def test_direct_forecast_of_all_steps(fleet):
    model = rollforward.fit_direct(fleet, 1, steps=(1, 3, 6), lags=(1, 3, 6), windows=(3, 6), max_iter=8, max_depth=4, chunk_rows=128)
    points = rollforward.direct_forecast(model, fleet, 1).collect()
    assert sorted((p[KEY], p["step"]) for p in points) == [(a, k) for a in ("T1", "T2") for k in range(1, 7)]
    assert all(0 <= p["p10"] <= p["p50"] <= p["p90"] for p in points)
    assert all(p[TS] == START + timedelta(minutes=10 * (359 + p["step"])) for p in points)
    val = rollforward.scored_steps(model, fleet, [6], "val").collect()
    own = np.mean([abs(r["actual_kw"] - r["predicted_kw"]) for r in val])
    assert own < 0.7 * np.mean([abs(r["actual_kw"] - r["active_power_kw"]) for r in val])
    with pytest.raises(ValueError, match="no rows"):
        rollforward.fit_direct(fleet.where("row_index < 20").withColumn("n_rows", F.lit(20)), 1, steps=(6,))


def test_sequence_model(fleet):
    model, scored = learned.fit_sequence(fleet, 1, seq_len=24, min_train=50, chunk_rows=128)
    out = learned.sequence_outputs(model, scored)
    assert metrics.model_metrics(out, ["model_type"]).first()["skill_score"] > 0
    assert learned.calibrate_sequence(scored).count() == 2
    points = learned.sequence_forecast(model, fleet).collect()
    assert len(points) == 12 and min(p[TS] for p in points) == START + timedelta(minutes=3600)
    assert learned.fit_sequence(fleet, 1, seq_len=24, min_train=10_000) is None


def test_grid_leaves_out_what_cannot_be_fitted(fleet):
    short = last_rows(fleet, 120).drop("row_index", "n_rows")
    out = learned.grid_outputs(with_row_index(short), [1], models=["persistence", "sequence"])
    assert {r["model_type"] for r in out.select("model_type").distinct().collect()} == {"persistence"}


def test_test_outputs_on_disk(spark, fleet, tmp_path):
    out = backtest.baseline_outputs(fleet, horizons=[1])
    outputs.save_test_outputs(out, str(tmp_path / "out"))
    one = outputs.load_test_outputs(spark, str(tmp_path / "out"), "persistence-T1-1h")
    want = out.where("model_id = 'persistence-T1-1h'")
    assert sorted(one.collect()) == sorted(want.collect())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_feature_rows_are_not_exchanged(spark, fleet):
    from fleetcast.operators import features

    known = learned.training_features(fleet, [1], lags=(1, 3), windows=(3,), chunk_rows=128, more_steps=(1, 3))
    assert [c for c in known.columns if c.startswith(features.TARGET)] == [features.target_of(n) for n in (1, 3, 6)]
    learn = learned.learning_rows(learned._delta_frame(fleet, 6, (1, 3), (3,), 10.0, False, 128, known))
    assert "SortMergeJoin" not in _plan(learn) and "hashpartitioning" not in _plan(learn)
    long = rollforward._long_frame(fleet, (1, 3, 6), (1, 3), (3,), 128, known)
    assert "SortMergeJoin" not in _plan(long) and "hashpartitioning" not in _plan(long)


def test_features_of_horizons_with_missing_and_repeated_rows(spark):
    from fleetcast.operators import features

    rows = []
    for i in range(40):
        wind = None if i == 17 else 5.0 + i
        rows.append(("T1", START + timedelta(minutes=10 * i), 100.0 + i * i, wind, 1.0, float(i)))
    rows.append(("T1", START + timedelta(minutes=100), 7.0, 8.0, 1.0, 2.0))
    indexed = with_row_index(spark.createDataFrame(rows, DDL))
    kept = features.tabular_features(indexed, (1,), (2,), 8).orderBy("row_index").collect()
    found = features.supervised_for_horizons(indexed, [1, 4], (1,), (2,), 8).orderBy("row_index").collect()
    assert [r["row_index"] for r in found] == list(range(len(kept))) and {r["n_rows"] for r in found} == {len(kept)}
    assert len(kept) == 41 - 2 - 2  # the first two, and the two whose windows hold the missing wind
    for n in (1, 4):
        wanted = [kept[k + n]["active_power_kw"] if k + n < len(kept) else None for k in range(len(kept))]
        assert [r[features.target_of(n)] for r in found] == wanted
    assert [r["active_power_lag_1"] for r in found] == [r["active_power_lag_1"] for r in kept]


def _exchanges(df):
    """The columns of each exchange by a key in the plan."""
    return [line for line in _plan(df).splitlines() if "Exchange hashpartitioning" in line]


def test_features_and_targets_meet_in_one_exchange(spark, fleet):
    """targets went to the measures by a join of both tables, whose rows were then exchanged once more."""
    from fleetcast.operators import features

    found = features.supervised_for_horizons(session.written(fleet, "fleet"), [1, 6], (1, 3), (3,), 128)
    assert "SortMergeJoin" not in _plan(found)
    assert len(_exchanges(found)) == 2  # the powers for the targets, then measures and targets into the chunks


def test_the_feature_table_holds_what_its_columns_dont_give(spark, fleet):
    """the physics, calendar and direction columns were written with the rest."""
    from fleetcast.operators import features

    rows = session.written(fleet, "fleet")
    known = learned.training_features(rows, [1], lags=(1, 3), windows=(3,), chunk_rows=128)
    held = spark.read.parquet(*known.inputFiles()).columns
    assert {"active_power_lag_1", "active_power_roll_std_3", "target_active_power_kw_6"} <= set(held)
    assert not {"wind_speed_cb", "hour_sin", "wind_direction_sin", "persistence_kw", "_mean_3", "power_rate_of_change"} & set(held)
    direct = features.supervised_for_horizons(rows, [6], (1, 3), (3,), 128)
    assert known.columns == direct.columns
    assert sorted(known.collect()) == sorted(direct.collect())


@pytest.mark.parametrize(("lags", "windows"), [((1,), (2,)), ((1, 5), (2, 3)), ((3, 6), (4,)), ((2,), (1, 3))])
def test_complete_rows_are_those_without_a_missing_window_column(spark, lags, windows):
    from fleetcast.operators import features

    rows = []
    for a, n in (("T1", 60), ("T2", 4), ("T3", 33)):
        for i in range(n):
            power, wind = (None if i in (9, 10, 30) else 100.0 + i * i % 91), (None if i == 20 else 5.0 + i % 7)
            rows.append((a, START + timedelta(minutes=10 * i), power, wind, None if i == 40 else 1.0, float(i)))
    indexed = with_row_index(spark.createDataFrame(rows, DDL))
    kept = {}
    for r in features.tabular_features(indexed, lags, windows, 8).orderBy(KEY, "row_index").collect():
        kept.setdefault(r[KEY], []).append(r.asDict())
    steps = (1, 11)
    found = features.supervised_for_horizons(indexed, steps, lags, windows, 8).collect()
    assert len(found) == sum(map(len, kept.values()))
    for r in found:
        own = kept[r[KEY]]
        want = own[r["row_index"]] | {"row_index": r["row_index"], "n_rows": len(own)}
        for n in steps:
            later = r["row_index"] + n
            want[features.target_of(n)] = own[later]["active_power_kw"] if later < len(own) else None
        assert r.asDict() == want


def test_written_rows_are_not_written_again(spark, fleet):
    once = session.written(fleet, "fleet")
    assert session.written_once(once, "fleet") is once
    assert session.written_once(fleet, "fleet").inputFiles() and session.written_once(once.where("row_index > 3"), "fleet") is not once
