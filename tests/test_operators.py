"""Operator semantics on small tables with known answers."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetcast.functions.columns import coverage, mae, parsed_timestamp, rmse, skill, smape
from fleetcast.operators import cleaning, conformal, forecast, metrics, quality, reporting, risk, splits
from fleetcast.operators.timeline import with_row_index
from fleetcast.plans import backtest
from fleetcast.schemas import KEY, POWER, RAW_TO_INTERNAL, SEQ, TS
from fleetcast.sources import scada as source
from fleetcast.sources import weather as weather_files
from fleetcast.sources.weather import flatten_hourly
from fleetcast.streaming.ramps import ramp_runs

START = datetime(2018, 1, 1)
DDL = (
    "asset_id string, timestamp timestamp_ntz, active_power_kw double, wind_speed_mps double, "
    "theoretical_power_kwh double, wind_direction_deg double, ingest_seq long"
)


def rising(spark, n=96, asset="T1"):
    rows = [
        (asset, START + timedelta(minutes=10 * i), 150.0 + 7 * i, 4 + 0.05 * i, 180 + 7.5 * i, 20.0 + 3 * (i % 9), i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, DDL)


def test_metric_values(spark):
    df = spark.createDataFrame([(40.0, 52.0), (75.0, 70.0), (130.0, 120.0), (9.0, 0.0)], "a double, p double")
    a, p = F.col("a"), F.col("p")
    r = df.agg(mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), smape(a, p).alias("mape")).first()
    # errors 12, 5, 10, 9; relative ones 24/92, 10/145, 20/250, 2
    assert r["mae"] == pytest.approx(9.0) and r["rmse"] == pytest.approx(87.5**0.5)
    assert r["mape"] == pytest.approx((24 / 92 + 10 / 145 + 20 / 250 + 2) * 25)
    zeros = spark.createDataFrame([(0.0, 0.0)], "a double, p double")
    assert zeros.agg(smape(a, p).alias("m")).first()["m"] == 0.0


def test_coverage_and_skill(spark):
    df = spark.createDataFrame([(7.0, 7.0, 8.0), (7.0, 6.0, 7.0), (7.0, 7.5, 9.0)], "a double, l double, u double")
    assert df.agg(coverage(F.col("a"), F.col("l"), F.col("u")).alias("c")).first()["c"] == pytest.approx(2 / 3)
    one = spark.range(1).select(skill(F.lit(3.0), F.lit(12.0)).alias("s"), skill(F.lit(3.0), F.lit(0.0)).alias("none"))
    assert one.first()["s"] == pytest.approx(0.75) and one.first()["none"] is None


def test_metrics_refuse_non_finite_inputs(spark):
    row = [("T1", "m", "m", 1, 1.0, float("nan"), 1.0, 0.0, 2.0)]
    ddl = (
        "asset_id string, model_id string, model_type string, horizon_hours int, actual_kw double, "
        "predicted_kw double, baseline_kw double, p10 double, p90 double"
    )
    with pytest.raises(Exception, match="finite"):
        metrics.model_metrics(spark.createDataFrame(row, ddl)).collect()


def test_rename_is_strict(spark):
    raw = rising(spark, 3).withColumnsRenamed({v: k for k, v in RAW_TO_INTERNAL.items()})
    assert POWER in cleaning.rename_raw(raw).columns
    with pytest.raises(ValueError, match="lacks these SCADA columns"):
        cleaning.rename_raw(raw.drop("Wind Speed (m/s)"))


def test_timestamps_of_both_formats(spark):
    texts = ["31 12 2018 23:50", "2018-12-31 23:50:00", "2018-12-31T23:50:00Z", "soon", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parsed_timestamp(F.col("t"))).collect()
    assert [r[0] for r in got] == [datetime(2018, 12, 31, 23, 50)] * 3 + [None, None]


def test_normalise_wraps_and_keeps_last(spark):
    rows = [("T1", START, 1.0, 2.0, 3.0, -5.0, 0), ("T1", START, 9.0, float("nan"), 3.0, 725.0, 1)]
    (r,) = cleaning.normalise(spark.createDataFrame(rows, DDL)).collect()
    assert (r[POWER], r["wind_speed_mps"], r["wind_direction_deg"]) == (9.0, None, 5.0)
    (r,) = cleaning.normalise(spark.createDataFrame(rows, DDL), keep="first").collect()
    assert (r[POWER], r["wind_direction_deg"]) == (1.0, 355.0)


def test_contract_bounds(spark):
    rows = [
        ("a", START, -100.0, 1.0, 1.0, 1.0, 0),
        ("a", START, 1.0, 1.0, 1.0, 360.0, 1),
        ("a", START, 1.0, 1.0, 1.0, 0.0, 2),
        ("a", START, 1.0, None, 1.0, 0.0, 3),
    ]
    valid, quarantined = cleaning.split_by_contract(spark.createDataFrame(rows, DDL))
    assert [r[SEQ] for r in valid.collect()] == [2]
    assert sorted(r[SEQ] for r in quarantined.collect()) == [0, 1, 3]


def test_validation_of_a_missing_column(spark):
    issues = quality.validation_issues(rising(spark, 5).drop("wind_direction_deg")).collect()
    assert [(r["field"], r["check"], r["count"], r["severity"]) for r in issues] == [("columns", "required", 1, "error")]
    assert not quality.validation_summary(rising(spark, 5).drop("wind_direction_deg")).first()["passed"]
    assert quality.validation_summary(rising(spark, 5), strict=True).first()["passed"]


def test_raw_csv_files_of_several_blocks_keep_their_line_order(spark, tmp_path):
    lines = ["Date/Time,LV ActivePower (kW),Wind Speed (m/s),Theoretical_Power_Curve (KWh),Wind Direction (°)"]
    lines += [f"01 01 2018 {i // 60 % 24:02d}:{i % 60:02d},{i},5,6,7" for i in range(2000)]
    (tmp_path / "T7.csv").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        raw = source.read_raw_csv(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 3
        rows = sorted(raw.collect(), key=lambda r: r[SEQ])
        assert [int(r["LV ActivePower (kW)"]) for r in rows] == list(range(2000)) and rows[0][KEY] == "T7"
        kept = {r[TS]: r[POWER] for r in source.ingest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(kept) == 1440 and kept[START] == 0.0


def test_time_split_order_and_ratio_error(spark):
    rows = splits.time_split(rising(spark, 100)).orderBy(TS).collect()
    names = [r["split"] for r in rows]
    assert names == sorted(names, key=["train", "val", "test"].index) and names.count("train") == 70
    with pytest.raises(ValueError):
        splits.time_split(rising(spark, 5), 0.8, 0.2)


def test_row_split_needs_enough_rows(spark):
    with pytest.raises(Exception, match="too few rows to split: 96 of 100"):
        splits.row_split(with_row_index(rising(spark, 96))).collect()
    with pytest.raises(ValueError):
        splits.row_split(with_row_index(rising(spark, 96)), 0.9, 0.1)


def test_no_part_may_be_empty(spark):
    three = with_row_index(rising(spark, 3))
    with pytest.raises(Exception, match="a part would be empty"):
        splits.row_split(three, min_rows=3).collect()
    rows = splits.row_split(three, min_rows=3, strict=False).collect()
    assert {r["split"] for r in rows} == {None} and all("empty" in r["split_problem"] for r in rows)


def test_pivot_keeps_the_last_value(spark):
    long = spark.createDataFrame([("T1", START, "a", 9.0, 1), ("T1", START, "a", 1.0, 2)], "asset_id string, timestamp timestamp_ntz, series string, value double, k int")
    assert reporting.pivot_series(long, ["a"], order="k").first()["a"] == 1.0
    assert reporting.pivot_series(long, ["a"], how="mean").first()["a"] == 5.0


def test_histogram_of_constant_wind(spark):
    (r,) = reporting.wind_histogram(rising(spark, 5).withColumn("wind_speed_mps", F.lit(3.0))).collect()
    assert (r["bin"], r["rows"]) == (0, 5)


def test_one_weather_row_per_hour(spark):
    rows = rising(spark, 20)
    weather = spark.createDataFrame(
        [("T1", START, 1.0), ("T1", START + timedelta(minutes=30), 2.0)], "asset_id string, timestamp timestamp_ntz, temperature_c double"
    )
    joined = reporting.with_weather(rows, weather).collect()
    assert len(joined) == 20 and {r["weather_temperature_c"] for r in joined} == {2.0, None}


def test_weather_files_of_any_layout(spark, tmp_path):
    for name, text in (("lines/asset_id=A/x.json", '{"hourly": {"time": ["2018-01-01T00:00"]}}\nno json\n'), ("files/asset_id=B/y.json", '{\n "hourly": {\n  "time": ["2018-01-01T05:00"]\n }\n}')):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_text(text)
    assert [r[KEY] for r in weather_files.read_weather_json(spark, f"{tmp_path}/lines").collect()] == ["A"]
    assert weather_files.unreadable_responses(spark, f"{tmp_path}/lines").first()["unreadable"] == 1
    assert [r[KEY] for r in weather_files.read_weather_json(spark, f"{tmp_path}/files", multi_line=True).collect()] == ["B"]


def test_repeats_across_files_keep_the_order_of_the_files(spark, tmp_path):
    head = "Date/Time,LV ActivePower (kW),Wind Speed (m/s),Theoretical_Power_Curve (KWh),Wind Direction (°)"
    for k in (2, 0, 1):
        folder = tmp_path / "asset_id=T1"
        folder.mkdir(exist_ok=True)
        (folder / f"part{k}.csv").write_text(f"{head}\n01 01 2018 00:00,{k},5,6,7\n01 01 2018 00:10,{10 + k},5,6,7\n")
    for keep, value in (("first", 0.0), ("last", 2.0)):
        rows = source.ingest(spark, str(tmp_path), keep).orderBy(TS).collect()
        assert [r[POWER] for r in rows] == [value, value + 10]


def test_late_rows_take_their_place_in_a_stream(spark, tmp_path):
    """Minutes 0, 10, 30 arrive first, then 20, 40, 50 and a row long after: one run of all steps up to 40."""
    power = {0: 100.0, 10: 800.0, 20: 1500.0, 30: 2200.0, 40: 2900.0, 50: 2950.0, 500: 2950.0, 1000: 2950.0}
    for k, minutes in enumerate(([0, 10, 30], [20, 40, 50], [500], [1000])):
        rows = [("T1", START + timedelta(minutes=m), power[m], 1.0, 1.0, 1.0, m) for m in minutes]
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in (tmp_path / "in").glob("part-*.parquet"):
            f.rename(tmp_path / "in" / f"f{k}.parquet") if not f.name.startswith("f") else None
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = ramp_runs(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c")
    out.trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    (run,) = spark.read.parquet(f"{tmp_path}/out").collect()
    assert (run["steps"], run["power_before_kw"], run["power_after_kw"]) == (4, 100.0, 2900.0)


def test_persistence_forecast(spark):
    seven = spark.createDataFrame(
        [("T1", START + timedelta(minutes=10 * i), 820.0 - 15 * i, 7.5, 900.0, 45.0, i) for i in range(7)], DDL
    )
    points = forecast.persistence_forecast(with_row_index(seven), 1).orderBy("step").collect()
    assert len(points) == 6 and points[0][TS] == START + timedelta(minutes=70)
    assert all(p["p10"] <= p["p50"] <= p["p90"] and p["p50"] == 730.0 for p in points)
    short = forecast.persistence_forecast(with_row_index(seven.limit(2)), 1).first()
    assert short["warnings"] == [forecast.SHORT_HISTORY]
    with pytest.raises(ValueError, match="no known horizon"):
        forecast.persistence_forecast(with_row_index(seven), 2)


def test_model_choice(spark):
    rows = with_row_index(rising(spark, 12))
    base = forecast.persistence_forecast(rows, 1)
    counts = rows.groupBy(KEY).agg(F.count("*").alias("n_obs"))
    assert forecast.choose_forecast(base, None, counts, 1).first()["warnings"] == []
    assert "trained for 6h" in forecast.choose_forecast(base, 6, counts, 1).first()["warnings"][0]
    own = base.drop("warnings").withColumn("model_id", F.lit("trees"))
    assert {r["model_id"] for r in forecast.choose_forecast(base, 1, counts, 1, own).collect()} == {"trees"}


def test_adjacent_ramp(spark):
    rows = [("T1", START + timedelta(minutes=10 * i), p, 6.0, 5.0, 1.0, i) for i, p in enumerate([1900.0, 1850.0, 1200.0])]
    (event,) = risk.adjacent_ramps(with_row_index(spark.createDataFrame(rows, DDL))).collect()
    assert event["change_kw"] == -650.0


def test_strict_anchors_skip_gaps(spark):
    rows = rising(spark, 140).where("ingest_seq NOT BETWEEN 40 AND 49")
    indexed = with_row_index(rows)
    assert backtest.anchors(indexed, 6).count() == 124
    assert backtest.anchors(indexed, 6, strict_step_minutes=10.0).count() == 118


def test_conformal_interval_floor_and_finite_sample(spark):
    rows = [("T1", "m", "m", 1, float(i), 0.0) for i in range(10)]
    ddl = "asset_id string, model_id string, model_type string, horizon_hours int, actual_kw double, predicted_kw double"
    df = spark.createDataFrame(rows, ddl)
    assert conformal.fit(df).first()["interval_q"] == pytest.approx(8.1)
    assert conformal.fit(df, finite_sample=True).first()["interval_q"] == 9.0
    lower, upper = conformal.floored_interval(F.lit(0.2), F.lit(0.1))
    r = spark.range(1).select(lower.alias("l"), upper.alias("u")).first()
    assert (r["l"], r["u"]) == (pytest.approx(0.1), pytest.approx(1.1))
    with pytest.raises(ValueError):
        conformal.quantile_level(1.0)


def test_weather_arrays_of_unequal_length(spark):
    text = '{"hourly": {"time": ["2018-01-01T00:00", "bad", "2018-01-01T02:00"], "wind_speed_10m": [1.5, 2, null], "temperature_2m": [3]}}'
    rows = flatten_hourly(spark.createDataFrame([("T1", text)], "asset_id string, response string")).orderBy(TS).collect()
    assert [(r["wind_speed_10m_mps"], r["temperature_c"], r["pressure_hpa"]) for r in rows] == [
        (1.5, 3.0, None),
        (None, None, None),
    ]


def test_shortfall_levels(spark):
    rows = [("T1", START, 1500.0, 1600.0), ("T1", START, 1300.0, 1500.0), ("T1", START, 100.0, 300.0)]
    got = risk.shortfall_risk(spark.createDataFrame(rows, "asset_id string, timestamp timestamp_ntz, p10 double, p50 double"))
    assert sorted((r["shortfall_probability"], r["risk_level"]) for r in got.collect()) == [(0.5, "medium"), (0.8, "critical")]
