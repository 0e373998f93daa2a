"""As-of joins, arrival over files, fleets of uneven assets, and streams that stop, restart and replay."""

from __future__ import annotations

import bisect
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcast.operators import quality
from fleetcast.operators.asof import as_of
from fleetcast.operators.quantiles import group_quantiles
from fleetcast.operators.timeline import with_row_index
from fleetcast.plans.fleet_training import train_fleet
from fleetcast.schemas import KEY, POWER, SEQ, SOURCE_FILE, TS
from fleetcast.streaming import landing
from fleetcast.streaming import scada as streams
from fleetcast.streaming.ramps import Run, advance, first_of_each_time, ramp_runs

START = datetime(2018, 1, 1)


# As-of ------------------------------------------------------------------------------------------------


def uneven(seed: int):
    """Observations and reports at odd minutes, with ties, gaps of weeks, nulls, and an asset on one side only."""
    rng = random.Random(seed)
    left, right = [], []
    for asset, n, m in (("hot", 300, 90), ("few", 9, 3), ("blind", 20, 0), ("unseen", 0, 5)):
        at = START
        for _ in range(n):
            at += timedelta(minutes=rng.choice([0, 1, 10, 10, 30_000]))
            left.append((asset, at, rng.random()))
        at = START
        for _ in range(m):
            at += timedelta(minutes=rng.choice([0, 0, 10, 47, 40_000]))
            right.append((asset, at, rng.randint(0, 3), rng.choice([None, "a", "b"])))
    left += [("hot", None, 0.5), (None, START, 0.25), left[3], left[3]]
    right += [("hot", None, 9, "z"), right[5]]
    rng.shuffle(left)
    return left, right


@pytest.mark.parametrize(("strict", "max_age", "chunk_rows"), [(False, None, 1), (False, 60, 25), (True, None, 8192), (True, 10, 7)])
def test_as_of_against_a_search(spark, strict, max_age, chunk_rows):
    left, right = uneven(5)
    a = spark.createDataFrame(left, f"{KEY} string, {TS} timestamp_ntz, p double").repartition(4)
    b = spark.createDataFrame(right, f"{KEY} string, {TS} timestamp_ntz, v int, w string").repartition(3)
    got = as_of(a, b, max_age_minutes=max_age, strict=strict, chunk_rows=chunk_rows)
    assert got.columns == [KEY, TS, "p", f"right_{TS}", "right_v", "right_w"]
    best: dict = {}
    for asset, at, v, w in right:
        if at is not None:
            best[asset, at] = max(best.get((asset, at), (-1, "")), (v, w or ""))
    times = {asset: sorted(t for k, t in best if k == asset) for asset in {k for k, _ in best}}
    want = []
    for asset, at, p in left:
        own = times.get(asset, []) if at is not None else []
        i = (bisect.bisect_left if strict else bisect.bisect_right)(own, at) - 1 if own else -1
        found = own[i] if i >= 0 and (max_age is None or at - own[i] <= timedelta(minutes=max_age)) else None
        v, w = best[asset, found] if found else (None, None)
        want.append((asset, at, p, found, v, w or None))
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_as_of_of_nothing_and_clashing_names(spark):
    a = spark.createDataFrame([("x", START, 1.0)], f"{KEY} string, {TS} timestamp_ntz, right_v double")
    b = spark.createDataFrame([], f"{KEY} string, {TS} timestamp_ntz, v int")
    with pytest.raises(ValueError, match="right_v"):
        as_of(a, b)
    rows = as_of(a, b, prefix="found_").collect()
    assert [tuple(r) for r in rows] == [("x", START, 1.0, None, None)]
    assert as_of(a.limit(0), b, prefix="found_").count() == 0


def test_as_of_neither_ranges_nor_windows_over_an_asset(spark):
    left, right = uneven(6)
    a = spark.createDataFrame(left, f"{KEY} string, {TS} timestamp_ntz, p double")
    b = spark.createDataFrame(right, f"{KEY} string, {TS} timestamp_ntz, v int, w string")
    plan = as_of(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# Arrival and quantiles --------------------------------------------------------------------------------


def test_files_arrive_one_after_another(spark):
    """Lines are numbered from 0 in each file; three files in perfect order have no step back."""
    rows = [("T1", START + timedelta(minutes=20 * f + k), f"day-{f}.csv", k) for f in range(3) for k in range(20)]
    rows += [("T2", START + timedelta(minutes=100 - 20 * f + k), f"day-{f}.csv", k) for f in range(3) for k in range(20)]
    rows += [("T2", START + timedelta(minutes=119), "day-0.csv", 20)]
    df = spark.createDataFrame(rows, f"{KEY} string, {TS} timestamp_ntz, {SOURCE_FILE} string, {SEQ} long").repartition(5)
    for chunk_rows in (1, 7, 8192):
        got = {r[KEY]: (r.repeats_in_arrival, r.steps_back) for r in quality.arrival_order(df, chunk_rows).collect()}
        assert got == {"T1": (0, 0), "T2": (1, 2)}


def test_quantiles_at_any_scale_and_outside_their_brackets(spark):
    rng = np.random.default_rng(1)
    data = {
        "unit": rng.random(6000), "wide": rng.lognormal(20, 4, 3000), "narrow": 1e12 + rng.random(2000), "same": np.full(900, 3.5),
        "two": np.repeat([1.0, 2.0], [1000, 1001]), "one": np.array([4.0]), "small": rng.normal(size=7),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("unit", float("inf")), ("unit", None)], "k string, v double")
    wanted = {"p10": 0.1, "p50": 0.5, "p905": 0.905, "low": 0.0, "high": 1.0}
    for options in ({}, {"sketch": 64, "slack": -0.01}):  # the second brackets miss their ranks
        for r in group_quantiles(df.repartition(6), ["k"], "v", wanted, count="n", **options).collect():
            assert r.n == len(data[r.k])
            for name, p in wanted.items():
                assert r[name] == pytest.approx(np.quantile(data[r.k], p), rel=1e-12)


# Fleets -----------------------------------------------------------------------------------------------


def test_every_asset_has_outputs_or_a_reason(spark):
    ddl = f"{KEY} string, {TS} timestamp_ntz, {POWER} double, wind_speed_mps double, theoretical_power_kwh double, wind_direction_deg double"
    rows = []
    for asset, n in {"long": 260, "short": 40, "tiny": 9}.items():
        rows += [(asset, START + timedelta(minutes=10 * i), 300.0 + 4 * (i % 90), 5 + 0.02 * i, 340 + 4.2 * (i % 90), 110.0 + i % 10) for i in range(n)]
    fleet = with_row_index(spark.createDataFrame(rows, ddl))
    trained = train_fleet(fleet, [1], max_iter=3, max_depth=2)
    status = {r[KEY]: r for r in trained.status.collect()}
    assert {a: (r.feature_set, r.reason) for a, r in status.items()} == {
        "long": (0, "trained"), "short": (1, "trained"), "tiny": (3, "too few feature rows: 1 of 10"),
    }
    counts = {r[KEY]: r["count"] for r in trained.outputs.groupBy(KEY).count().collect()}
    assert set(counts) == {"long", "short"} and set(trained.models) == {(1, 0), (1, 1)}
    assert all(counts[a] == status[a].test_rows for a in counts)
    tail = train_fleet(fleet.where(f"{KEY} = 'long'"), [1], test_start=0.9, max_iter=2, max_depth=2)
    r = tail.status.first()
    assert (r.train_rows, r.val_rows, r.test_rows) == (167, 18, 21)  # 206 feature rows
    none = train_fleet(fleet.where(f"{KEY} = 'tiny'"), [1])
    assert none.outputs.count() == 0 and none.status.count() == 1


# Streams ----------------------------------------------------------------------------------------------


def walk(us, power, kw, pct):
    out, last, steps, begin = [], None, 0, None
    for t, x in zip(us, power):
        if last is not None:
            change = x - last[1]
            if abs(change) >= kw or (last[1] > 0 and abs(change / last[1] * 100) >= pct):
                begin, steps = (begin, steps + 1) if steps else (last, 1)
            elif steps:
                out.append((begin[0], last[0], begin[1], last[1], steps))
                steps = 0
        last = (t, x)
    return out, steps


def test_runs_advance_the_same_in_any_pieces():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(1, 50)
        power = np.array([rng.choice([0.0, 100.0, 120.0, 700.0, 1500.0, float("nan")]) for _ in range(n)])
        us = np.arange(n) * 600
        run, got, at = None, [], 0
        while at < n:
            end = min(n, at + rng.randint(1, 9))
            run, ended = advance(run, us[at:end], power[at:end], 500, 30)
            got, at = got + [tuple(e) for e in ended.tolist()], end
        want, open_steps = walk(us.tolist(), power.tolist(), 500, 30)
        assert [tuple(map(str, map(float, g))) for g in got] == [tuple(map(str, map(float, w))) for w in want] and run.steps == open_steps
        assert run.closed() == Run(run.last_us, run.last_power) or np.isnan(run.last_power)
    us, power = first_of_each_time(np.array([3, 1, 3, 1]), np.array([float("nan"), 2.0, 7.0, 1.0]))
    assert us.tolist() == [1, 3] and power.tolist() == [1.0, 7.0]


def run_to_end(stream, path, mode="append", sink=None):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-offsets").trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").start(path)
    query.awaitTermination()
    return query


def test_ramps_from_shuffled_files_over_a_restart(spark, tmp_path):
    """Rows of one asset, late within the watermark, in many files and two runs of the stream: the runs of a walk along all rows."""
    rng = random.Random(4)
    rows = [("T1", START + timedelta(minutes=10 * i), float(rng.choice([100, 150, 900, 1500]))) for i in range(600)]
    rows += [("T2", START + timedelta(minutes=10 * i), 100.0 * (1 + i % 2 * 9)) for i in range(50)]  # one run, left open
    late = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.randint(0, 80)))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    ddl = f"{KEY} string, {TS} timestamp, {POWER} double"

    def land(part):
        spark.createDataFrame(part, ddl).repartition(4).write.mode("append").parquet(source)

    def runs():
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 3).parquet(source)
        return ramp_runs(stream, lateness="2 hours", silence="3 hours", bucket="2 hours")

    land(late[:200])
    land(late[200:400])
    first = run_to_end(runs(), out)
    assert len([p for p in first.recentProgress if p["numInputRows"]]) >= 2
    land(late[400:])
    land([("closing", START + timedelta(days=60), 0.0)])
    run_to_end(runs(), out)
    got = sorted((r[KEY], r.start_time, r.end_time, r.power_before_kw, r.power_after_kw, r.steps) for r in spark.read.parquet(out).collect())
    want = []
    for asset in ("T1", "T2"):
        own = [(t, p) for a, t, p in rows if a == asset]
        done, steps = walk(range(len(own)), [p for _, p in own], 500, 30)
        want += [(asset, own[a][0], own[b][0], c, d, s) for a, b, c, d, s in done]
        if steps:
            last = len(own) - 1
            want.append((asset, own[last - steps][0], own[last][0], own[last - steps][1], own[last][1], steps))
    assert got == sorted(want)


def test_ramp_rows_are_gathered_over_all_tasks(spark):
    """Before the one task of an asset its rows are put together by bucket: it gets a row per bucket, whatever their order was."""
    stream = spark.readStream.format("rate").load()
    rows = stream.select(F.lit("T1").alias(KEY), F.col("timestamp").alias(TS), F.col("value").cast("double").alias(POWER))
    plan = ramp_runs(rows)._jdf.queryExecution().analyzed().toString()
    runs, gathered = plan.index("TransformWithState"), plan.index("Aggregate")
    assert runs < gathered and "window" in plan[gathered:]


def test_a_silent_run_is_closed_between_the_buckets_of_one_batch(spark, tmp_path):
    """Runs before and behind a long gap, all in one file: the first ends at its last row, and the step over the gap begins another."""
    power = [100.0, 900.0, 100.0]
    rows = [("T1", START + timedelta(minutes=10 * i), p) for i, p in enumerate(power)]
    rows += [("T1", START + timedelta(days=3, minutes=10 * i), p) for i, p in enumerate([900.0, 100.0, 100.0])]
    rows += [rows[1], ("T1", rows[1][1], 2000.0), ("T1", rows[1][1], None), ("closing", START + timedelta(days=60), 0.0)]
    ddl = f"{KEY} string, {TS} timestamp, {POWER} double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(source)
    run_to_end(ramp_runs(spark.readStream.schema(ddl).parquet(source), lateness="2 hours", silence="3 hours", bucket="2 hours"), out)
    got = sorted((r.start_time, r.end_time, r.power_before_kw, r.power_after_kw, r.steps) for r in spark.read.parquet(out).collect())
    assert got == [(rows[0][1], rows[2][1], 100.0, 100.0, 2), (rows[2][1], rows[4][1], 100.0, 100.0, 2)]


def test_counters_survive_restarts_and_replays(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    ddl = (
        f"{KEY} string, {TS} timestamp, {POWER} double, wind_speed_mps double, theoretical_power_kwh double, wind_direction_deg double"
    )

    def land(asset, n, power):
        spark.createDataFrame([(asset, START + timedelta(minutes=10 * i), power, 5.0, 1.0, 1.0) for i in range(n)], ddl).write.mode("append").parquet(source)

    def counted():
        return streams.quality_counts(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source))

    land("T1", 10, 5.0)
    land("T2", 4, -1.0)
    sink = landing.upserting(path, [KEY])
    run_to_end(counted(), path, "update", sink)
    land("T1", 7, -1.0)
    run_to_end(counted(), path, "update", sink)
    schema = counted().schema
    state = {r[KEY]: (r.rows, r.invalid_power) for r in landing.newest(spark, path, schema).collect()}
    assert state == {"T1": (17, 7), "T2": (4, 4)}
    # a batch that is replayed, and one that was cut off before it was finished
    batch = spark.createDataFrame([("T1", 17, 0, 7, 0, 0, 0)], schema)
    versions = landing._finished(spark, path, "version")
    sink(batch, max(versions))
    assert {r[KEY]: (r.rows, r.invalid_power) for r in landing.newest(spark, path, schema).collect()} == state
    (tmp_path / "table" / f"version={max(versions) + 1}").mkdir()
    assert {r[KEY]: (r.rows, r.invalid_power) for r in landing.newest(spark, path, schema).collect()} == state
    assert len(landing._finished(spark, path, "version")) <= 2
    assert landing.newest(spark, str(tmp_path / "none"), schema).count() == 0


def test_appended_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    write = landing.appending({path: lambda df: df.withColumn("twice", F.col("v") * 2)})
    for number, values in ((0, [1, 2]), (1, [3]), (1, [3])):
        write(spark.createDataFrame([(v,) for v in values], "v long"), number)
    assert sorted(r.twice for r in landing.appended(spark, path, "v long, twice long").collect()) == [2, 4, 6]


# Stored timelines and landed files --------------------------------------------------------------------


def test_a_stored_timeline_is_read_without_an_exchange(spark, sf_dir):
    from fleetcast.catalog.feature_queries import stored
    from fleetcast.operators import features, risk
    from fleetcast.operators.timeline import along_timeline
    from fleetcast.plans import backtest
    from fleetcast.sources.scada import load_observations
    from fleetcast.sources.timeline_store import stored_rows

    name, chunks = stored(spark, sf_dir)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    frames = {
        "w1": along_timeline(chunks, {"before": lambda w: F.lag(POWER).over(w)}, back=24),
        "f2": features.tabular_features(chunks),
        "b6": backtest.baseline_predictions(chunks),
        "r1": risk.adjacent_ramps(chunks),
    }
    for label, df in frames.items():
        text = plan(df)
        assert "Exchange" not in text and text.count("FileScan") == 1, label
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    one = plan(load_observations(stored_rows(spark, name), "T2", "2018-01-01 12:00:00"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"EqualTo({KEY},T2)" in one and f"GreaterThanOrEqual({TS}" in one
    with pytest.raises(ValueError, match="reaches"):
        along_timeline(chunks, {"far": lambda w: F.lag(POWER, 999).over(w)}, back=999)
    assert stored_rows(spark, name).count() == 1000


def test_landed_files_are_taken_once(spark, tmp_path):
    import json

    from fleetcast.sources import weather

    def land(asset, name, text):
        folder = tmp_path / "in" / f"{KEY}={asset}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    def response(n):
        return {"hourly": {"time": [f"2018-01-01T{h:02}:00" for h in range(n)], "temperature_2m": [float(h) for h in range(n)]}}

    write = landing.appending({str(tmp_path / "rows"): weather.weather_rows, str(tmp_path / "files"): weather.file_accounts})

    def run():
        stream = weather.stream_responses(spark, str(tmp_path / "in"), 2)
        options = stream.writeStream.option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True)
        options.foreachBatch(write).start().awaitTermination()
        return [landing.appended(spark, str(tmp_path / p), made(stream).schema) for p, made in (("rows", weather.weather_rows), ("files", weather.file_accounts))]

    land("T1", "a.json", json.dumps(response(3)))
    land("T1", "b.json", json.dumps(response(2), indent=4))
    land("T2", "c.json", json.dumps(response(4))[:-9])
    land("T2", "d.json", json.dumps({"reason": "no data"}))
    run()
    land("T2", "e.json", json.dumps(response(1)))
    rows, files = run()
    assert sorted((r[KEY], r[TS].hour, r.temperature_c) for r in rows.collect()) == [
        ("T1", 0, 0.0), ("T1", 0, 0.0), ("T1", 1, 1.0), ("T1", 1, 1.0), ("T1", 2, 2.0), ("T2", 0, 0.0),
    ]
    accounts = sorted((r.response_file.rsplit("/", 1)[1], r[KEY], r.readable, r.hours) for r in files.collect())
    assert accounts == [("a.json", "T1", True, 3), ("b.json", "T1", True, 2), ("c.json", "T2", False, 0), ("d.json", "T2", False, 0), ("e.json", "T2", True, 1)]


def test_responses_are_landed_by_many_tasks(spark, tmp_path):
    from pathlib import Path

    from fleetcast.sources import weather

    rows = spark.createDataFrame([(f"T{i % 4}", str(i // 4), f'{{"hourly": {i}}}') for i in range(200)], f"{KEY} string, landed string, value string")
    weather.land_responses(rows, str(tmp_path / "in"), KEY, "landed")
    files = [p for p in Path(tmp_path / "in").rglob("part-*") if p.suffix != ".crc"]
    assert sorted(p.read_text() for p in files) == sorted(r.value + "\n" for r in rows.collect())
    assert len({p.name[:10] for p in files}) > 1  # the number of the task
    spark.conf.unset(weather.LISTING_TASKS)
    weather.stream_responses(spark, str(tmp_path / "in"))
    assert int(spark.conf.get(weather.LISTING_TASKS)) <= 4 * spark.sparkContext.defaultParallelism


ODD_NAMES = ["T 1", "a/b=c", "50%", "x+y", "ä#?", None, "", "T1"]


def test_landed_responses_lie_where_spark_would_put_them(spark, tmp_path):
    from pathlib import Path

    from fleetcast.sources import weather

    def held(top):
        return sorted((str(p.parent.relative_to(top)), p.read_bytes()) for p in Path(top).rglob("part-*") if p.suffix != ".crc")

    rows = spark.createDataFrame([(a, day, f"{a} {day}") for a in ODD_NAMES for day in (1, 2)], f"{KEY} string, landed int, value string")
    rows = rows.unionByName(rows.where("landed = 1 AND asset_id = 'T1'").withColumn("value", F.lit(None).cast("string")))
    in_order = rows.repartition(1).sortWithinPartitions("value")
    top, other = str(tmp_path / "in dir"), str(tmp_path / "other")
    weather.land_responses(in_order, top, KEY, "landed")
    in_order.write.partitionBy(KEY, "landed").text(other)
    lines = [(folder, sorted(text.split(b"\n"))) for folder, text in held(top)]
    merged = {}
    for folder, text in lines:  # a null and an empty name share a folder, but not always a task
        merged.setdefault(folder, []).extend(x for x in text)
    assert {k: sorted(x for x in v if x) for k, v in merged.items()} == {k: sorted(x for x in t.split(b"\n") if x) for k, t in held(other)}
    assert sum(t.count(b"\n") for _, t in held(top)) == rows.count()
    # the tasks write the files: Hadoop would start processes for each of them, and lay a checksum beside it
    assert not list(Path(top).rglob("*.crc")) and {p.name for p in Path(top).iterdir() if "=" not in p.name} == {"_SUCCESS"}
    weather.land_responses(in_order.where("landed = 2"), top, KEY, "landed")
    assert sum(t.count(b"\n") for _, t in held(top)) == rows.count() + len(ODD_NAMES)


def test_a_failed_landing_leaves_no_files(spark, tmp_path):
    from fleetcast.sources import weather

    rows = spark.range(40).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias(KEY), F.expr("if(id = 39, raise_error('no'), 'x')").alias("value"))
    with pytest.raises(Exception, match="no"):
        weather.land_responses(rows, str(tmp_path / "in"), KEY)
    assert not [p for p in (tmp_path / "in").rglob("*") if p.is_file()]


def test_the_asset_of_a_response_is_read_from_its_path(spark, tmp_path):
    import json

    from fleetcast.sources import weather

    top, seen = str(tmp_path / "in dir"), str(tmp_path / "seen")
    text = json.dumps({"hourly": {"time": ["2018-01-01T00:00"]}})
    rows = spark.createDataFrame([(a, day, text) for a in ODD_NAMES for day in ("2018-01-01", "x")], f"{KEY} string, landed string, value string")
    rows.write.partitionBy(KEY, "landed").text(top)
    stream = weather.stream_responses(spark, top, 3)
    # Spark's discovery of folders compares each folder with all others: it would have added the column ``landed``
    assert stream.columns == ["hourly", weather.CORRUPT, KEY, weather.FILE]
    options = stream.writeStream.option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True)
    options.foreachBatch(landing.appending({seen: weather.file_accounts})).start().awaitTermination()
    found = landing.appended(spark, seen, weather.file_accounts(stream).schema)
    expected = spark.read.text(top).select(KEY, F.col("_metadata.file_path").alias(weather.FILE)).distinct()
    assert sorted(map(str, found.select(KEY, weather.FILE).collect())) == sorted(map(str, expected.collect()))


def test_a_failing_table_fails_its_batch(spark, tmp_path):
    paths = [str(tmp_path / name) for name in ("good", "bad")]
    write = landing.appending({paths[0]: lambda df: df, paths[1]: lambda df: df.select(F.expr("raise_error('no')").alias("v"))})
    with pytest.raises(Exception, match="no"):
        write(spark.createDataFrame([(1,)], "v long"), 0)
    assert landing.appended(spark, paths[0], "v long").count() == 1 and landing.appended(spark, paths[1], "v long").count() == 0
