"""Chunked windows and exact quantiles against plain Python, with seams everywhere and one hot asset."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetcast.operators import features, metrics, quality, risk, sequences, splits
from fleetcast.operators.quantiles import group_quantiles, upper_median
from fleetcast.operators.timeline import ROW, TOTAL, along_timeline, last_rows, with_row_index
from fleetcast.schemas import KEY, POWER, SEQ, TS

START = datetime(2018, 1, 1)


def series(seed: int, sizes: dict[str, int], gaps: bool = True, ramps: bool = False) -> list[tuple]:
    """Rows of assets of very different length, some with holes in time."""
    rng = random.Random(seed)
    rows = []
    for asset, n in sizes.items():
        at = START
        power = 1000.0
        for _ in range(n):
            at += timedelta(minutes=10 * (rng.choice([1, 1, 1, 2, 300]) if gaps else 1))
            power = max(0.0, power + rng.uniform(-700, 700)) if ramps else rng.uniform(0, 3600)
            rows.append((asset, at, power, rng.uniform(0, 20), rng.uniform(0, 3600), rng.uniform(0, 360), len(rows)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    ddl = (
        "asset_id string, timestamp timestamp_ntz, active_power_kw double, wind_speed_mps double, "
        "theoretical_power_kwh double, wind_direction_deg double, ingest_seq long"
    )
    return spark.createDataFrame(rows, ddl).repartition(5)


SIZES = {"hot": 230, "mid": 41, "small": 7, "one": 1}


def by_asset(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_row_index_counts_each_asset(spark):
    rows = series(1, SIZES)
    got = {(r[KEY], r[TS]): (r[ROW], r[TOTAL]) for r in with_row_index(frame(spark, rows)).collect()}
    want = {(a, r[1]): (i, len(rs)) for a, rs in by_asset(rows).items() for i, r in enumerate(rs)}
    assert got == want


@pytest.mark.parametrize("chunk_rows", [1, 4, 16, 8192])
def test_windows_do_not_see_chunk_seams(spark, chunk_rows):
    rows = series(2, SIZES)
    got = along_timeline(
        with_row_index(frame(spark, rows)),
        {
            "back": lambda w: F.lag(POWER, 5).over(w),
            "ahead": lambda w: F.lead(POWER, 3).over(w),
            "mean": lambda w: features.rolling(F.avg, POWER, 6, w),
            "std": lambda w: features.rolling(F.stddev_samp, POWER, 6, w),
        },
        back=5,
        ahead=3,
        chunk_rows=chunk_rows,
    ).collect()
    assert len(got) == len(rows)
    series_of = {a: [r[2] for r in rs] for a, rs in by_asset(rows).items()}
    for r in got:
        p, i = series_of[r[KEY]], r[ROW]
        assert r["back"] == (p[i - 5] if i >= 5 else None)
        assert r["ahead"] == (p[i + 3] if i + 3 < len(p) else None)
        if i < 5:
            assert r["mean"] is None and r["std"] is None
        else:
            assert r["mean"] == pytest.approx(statistics.fmean(p[i - 5 : i + 1]))
            assert r["std"] == pytest.approx(statistics.stdev(p[i - 5 : i + 1]))


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    values = {"a": [rng.gauss(0, 500) for _ in range(501)], "ties": [7.5] * 300 + [1e9, -3.0], "one": [2.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", float("nan")), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"p10": 0.1, "median": 0.5, "p90": 0.9, "top": 1.0, "upper": upper_median}
    for r in group_quantiles(df, ["k"], "v", wanted, count="n").collect():
        vs = sorted(values[r["k"]])
        assert r["n"] == len(vs)
        for name, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9), ("top", 1.0)):
            at = p * (len(vs) - 1)
            lo, hi = vs[int(at)], vs[min(int(at) + 1, len(vs) - 1)]
            assert r[name] == pytest.approx(lo + (hi - lo) * (at - int(at)))
        assert r["upper"] == vs[len(vs) // 2]


def ramps_of(rows: list[tuple]) -> list[tuple]:
    """R2 as a walk along the rows."""
    events, begin = [], None
    for i in range(1, len(rows) + 1):
        step = False
        if i < len(rows):
            before, change = rows[i - 1][2], rows[i][2] - rows[i - 1][2]
            step = abs(change) >= 500 or (before > 0 and abs(change / before * 100) >= 30)
        if step and begin is None:
            begin = i - 1
        elif not step and begin is not None:
            first, last = rows[begin], rows[i - 1]
            events.append((first[0], first[1], last[1], first[2], last[2], (i - begin) * 10))
            begin = None
    return events


@pytest.mark.parametrize("chunk_rows", [1, 5, 8192])
def test_ramp_events_against_a_walk(spark, chunk_rows):
    rows = series(4, SIZES, ramps=True)
    names = (KEY, "start_time", "end_time", "power_before_kw", "power_after_kw", "duration_minutes")
    got = risk.ramp_events(with_row_index(frame(spark, rows)), chunk_rows=chunk_rows).select(*names).collect()
    want = [e for rs in by_asset(rows).values() for e in ramps_of(rs)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_ramp_over_many_chunks(spark):
    rows = [("T1", START + timedelta(minutes=10 * i), 1000.0 + 600.0 * i, 5.0, 5.0, 5.0, i) for i in range(50)]
    (event,) = risk.ramp_events(with_row_index(frame(spark, rows)), chunk_rows=3).collect()
    assert (event["power_before_kw"], event["power_after_kw"], event["duration_minutes"]) == (1000.0, 30400.0, 500)
    assert event["elapsed_minutes"] == 490 and event["direction"] == "up" and event["risk_level"] == "critical"


def test_rows_in_ramps_are_the_rows_of_the_events(spark):
    rows = series(5, SIZES, ramps=True)
    flagged = {(r[KEY], r[TS]) for r in risk.rows_in_ramps(with_row_index(frame(spark, rows)), chunk_rows=4).where("in_ramp").collect()}
    inside = set()
    for rs in by_asset(rows).values():
        for e in ramps_of(rs):
            inside |= {(r[0], r[1]) for r in rs if e[1] <= r[1] <= e[2]}
    assert flagged == inside


def test_sequence_samples(spark):
    rows = series(6, SIZES)
    got = sequences.sequence_samples(with_row_index(frame(spark, rows)), features=(POWER,), seq_len=8, pred_len=3, chunk_rows=6)
    of = by_asset(rows)
    found = got.collect()
    assert len(found) == sum(max(0, n - 10) for n in SIZES.values())
    for r in found:
        p, i = of[r[KEY]], r["sample_index"]
        assert [x[0] for x in r["input_sequence"]] == [x[2] for x in p[i : i + 8]]
        assert r["target"] == [x[2] for x in p[i + 8 : i + 11]]
        assert r[TS] == p[i + 8][1]


def test_both_forms_of_the_supervised_frame_agree_on_complete_rows(spark):
    rows = with_row_index(frame(spark, series(7, {"hot": 120, "mid": 40})))
    columns = [KEY, TS, features.TARGET, "active_power_lag_6", "turbulence_intensity"]
    one = features.supervised_features(rows, 4, (1, 3, 6), (3, 6), complete_rows=True, chunk_rows=16).select(*columns)
    two = features.supervised_features(rows, 4, (1, 3, 6), (3, 6), chunk_rows=16).select(*columns)
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 160 - 2 * 10


def test_no_feature_sees_the_future(spark):
    rows = series(8, {"hot": 120})
    cut = sorted(r[1] for r in rows)[80]
    changed = [r if r[1] <= cut else (*r[:2], r[2] * 3 + 1, r[3] + 1, *r[4:]) for r in rows]

    def upto(data):
        frame_ = features.tabular_features(with_row_index(frame(spark, data)), chunk_rows=32).drop(TOTAL)
        return sorted(map(tuple, frame_.where(F.col(TS) <= F.lit(cut)).collect()))

    assert upto(rows) == upto(changed)


def test_last_rows(spark):
    rows = series(9, SIZES)
    got = sorted((r[KEY], r[TS]) for r in last_rows(frame(spark, rows), 5).collect())
    assert got == sorted((a, r[1]) for a, rs in by_asset(rows).items() for r in rs[-5:])


def test_arrival_order(spark):
    rows = series(10, SIZES)
    got = {r[KEY]: (r["repeats_in_arrival"], r["steps_back"]) for r in quality.arrival_order(frame(spark, rows), 4).collect()}
    arrived = {}
    for i, r in enumerate(sorted(rows, key=lambda r: r[6])):
        arrived.setdefault(r[0], []).append(r[1])
    want = {a: (sum(x == y for x, y in zip(t, t[1:])), sum(y < x for x, y in zip(t, t[1:]))) for a, t in arrived.items()}
    assert got == want


def test_cadence_over_gaps(spark):
    rows = series(11, SIZES)
    got = {r[KEY]: r["step_minutes"] for r in splits.cadence(with_row_index(frame(spark, rows)), chunk_rows=4).collect()}
    for a, rs in by_asset(rows).items():
        steps = [(y[1] - x[1]).total_seconds() / 60 for x, y in zip(rs, rs[1:])]
        assert got[a] == (statistics.median(steps) if steps else 10.0)


def test_change_residual_default(spark):
    got = {r[KEY]: r["residual_p90"] for r in metrics.change_residual(with_row_index(frame(spark, series(12, SIZES)))).collect()}
    assert got["one"] == 200.0 and set(got) == set(SIZES)


def test_time_window_never_holds_a_whole_asset(spark):
    plan = along_timeline(with_row_index(frame(spark, series(13, SIZES))), {"x": lambda w: F.lag(POWER).over(w)}, back=1)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line and "lag(" in line]
    assert windows and all("chunk" in line for line in windows)
    assert SEQ in plan.columns
