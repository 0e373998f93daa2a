"""Ramp runs on a stream of SCADA rows (X3), as a stateful processor with timers.

Rows are gathered by asset and time bucket in Spark's own aggregate, over all tasks, and reach the processor as one row per
bucket once the watermark has passed it. The processor takes the buckets in order of time and goes on with the asset's run from one
small value: a few calls of the state per asset and micro-batch, in whatever order the rows arrive. A state entry holds a bucket's
rows, a call two numbers for each row of its asset that the micro-batch gives out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetcast.operators.risk import CAPACITY_KW, RAMP_KW, RAMP_PCT, risk_level_of_change
from fleetcast.schemas import KEY, POWER, TS

LATENESS, BUCKET = "1 hour", "6 hours"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EVENT = f"{KEY} string, start_time timestamp, end_time timestamp, power_before_kw double, power_after_kw double, steps long"
_ENDED = ["start_us", "end_us", "power_before_kw", "power_after_kw", "steps"]


def micros(span: str) -> int:
    return pd.Timedelta(span).value // 1000


@dataclass(frozen=True)
class Run:
    """The last row passed, and the run of ramp steps open there (steps 0: none)."""

    last_us: int
    last_power: float
    start_us: int = 0
    start_power: float = 0.0
    steps: int = 0

    def closed(self) -> Run:
        return Run(self.last_us, self.last_power)


def first_of_each_time(us: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of time; of several of one time that of the smallest power, a missing one last."""
    order = np.lexsort((power, us))
    us, power = us[order], power[order]
    first = np.concatenate([[True], us[1:] != us[:-1]])[: len(us)]
    return us[first], power[first]


def advance(run: Run | None, us: np.ndarray, power: np.ndarray, ramp_kw: float, ramp_pct: float) -> tuple[Run, np.ndarray]:
    """The run after more rows, in order, and the runs that end on the way: a row of _ENDED each."""
    if run is not None:
        us, power = np.concatenate([[run.last_us], us]), np.concatenate([[run.last_power], power])
    steps = run.steps if run is not None else 0
    with np.errstate(invalid="ignore", divide="ignore"):
        change = np.diff(power)
        pct = np.where(power[:-1] > 0, change / power[:-1] * 100, 0.0)
        ramp = (np.abs(change) >= ramp_kw) | (np.abs(pct) >= ramp_pct)  # a missing power is no ramp
    before = np.concatenate([[steps > 0], ramp])[: len(ramp)]
    begin, end = np.flatnonzero(ramp & ~before), np.flatnonzero(before & ~ramp)
    start_us, start_power = us[begin], power[begin]
    if steps:  # the open run began -steps steps ago
        begin = np.concatenate([[-steps], begin])
        start_us, start_power = np.concatenate([[run.start_us], start_us]), np.concatenate([[run.start_power], start_power])
    n = len(end)
    ended = np.stack([start_us[:n], us[end], start_power[:n], power[end], end - begin[:n]], axis=1).astype(object) if n else np.zeros((0, 5), object)
    after = Run(int(us[-1]), float(power[-1]))
    if len(begin) > n:
        after = Run(after.last_us, after.last_power, int(start_us[-1]), float(start_power[-1]), int(len(ramp) - begin[-1]))
    return after, ended


def _closing(run: Run) -> list:
    return [run.start_us, run.last_us, run.start_power, run.last_power, run.steps]


class RampRuns(StatefulProcessor):
    def __init__(self, ramp_kw: float, ramp_pct: float, bucket_us: int, silence_us: int) -> None:
        self.ramp_kw, self.ramp_pct, self.bucket_us, self.silence_us = ramp_kw, ramp_pct, bucket_us, silence_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last_us bigint, last_power double, start_us bigint, start_power double, steps bigint")

    def _close_us(self, run: Run) -> int:
        """The end of the bucket in which an open run's asset has been silent for long enough."""
        return -(-(run.last_us + self.silence_us) // self.bucket_us) * self.bucket_us

    def _settled(self, key, run: Run, ended: list, timerValues) -> Iterator[pd.DataFrame]:
        """Closes the run of a silent asset or sets its timer, keeps the run and gives out those that have ended."""
        if run.steps:
            close_us = self._close_us(run)
            if close_us > timerValues.getCurrentWatermarkInMs() * 1000:
                self.handle.registerTimer(close_us // 1000)
            else:
                ended.append(_closing(run))
                run = run.closed()
        self.run.update((run.last_us, run.last_power, run.start_us, run.start_power, run.steps))
        if ended:
            out = pd.DataFrame(ended, columns=_ENDED)
            times = [pd.to_datetime(out[c].astype("int64"), unit="us", utc=True) for c in ("start_us", "end_us")]
            yield pd.DataFrame({
                KEY: key[0], "start_time": times[0], "end_time": times[1], "power_before_kw": out["power_before_kw"].astype(float),
                "power_after_kw": out["power_after_kw"].astype(float), "steps": out["steps"].astype("int64"),
            })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """All buckets between the watermark before and the one now, each of which comes once: later ones end later."""
        found = [
            (start_us, np.asarray(us, np.int64), np.asarray(power, np.float64))
            for frame in rows for start_us, us, power in zip(frame["start_us"], frame["us"], frame["power"], strict=True)
        ]
        run, ended = Run(*self.run.get()) if self.run.exists() else None, []
        for start_us, us, power in sorted(found, key=lambda b: b[0]):
            if run is not None and run.steps and self._close_us(run) < start_us + self.bucket_us:
                ended.append(_closing(run))
                run = run.closed()
            run, done = advance(run, *first_of_each_time(us, power), self.ramp_kw, self.ramp_pct)
            ended.extend(done.tolist())
        if run is not None:
            yield from self._settled(key, run, ended, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A run still open is closed if its asset has been silent since."""
        if self.run.exists():
            yield from self._settled(key, Run(*self.run.get()), [], timerValues)


def bucketed(rows: DataFrame, bucket: str) -> DataFrame:
    """Per asset and bucket its distinct rows as two arrays, given out when the watermark has passed the bucket."""
    entry = F.struct(F.unix_micros(TS).alias("us"), F.coalesce(POWER, F.lit(float("nan"))).alias("power"))
    gathered = rows.groupBy(KEY, F.window(TS, bucket).alias("window")).agg(F.collect_set(entry).alias("_rows"))
    return gathered.select(
        KEY, F.window_time("window").alias(TS), F.unix_micros("window.start").alias("start_us"), F.col("_rows.us").alias("us"),
        F.col("_rows.power").alias("power"),
    )


def ramp_runs(
    stream: DataFrame,
    ramp_kw: float = RAMP_KW,
    ramp_pct: float = RAMP_PCT,
    lateness: str = LATENESS,
    silence: str = LATENESS,
    bucket: str = BUCKET,
) -> DataFrame:
    """R2 on a stream. A run is given out once a step that is no ramp ends it, or its asset has been silent.

    Rows late within the watermark take their place in the order of time; later ones still do while their bucket is open. A run still open when ``silence`` has passed since its last
    row is closed at the end of that bucket. Longer buckets mean fewer state entries and later results. Of rows of one time the
    first by power counts; rows without a time are left out. Sets the session's state store to RocksDB, which timers need.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    processor = RampRuns(ramp_kw, ramp_pct, micros(bucket), micros(silence))
    rows = stream.select(KEY, F.col(TS).cast("timestamp").alias(TS), POWER).where(F.col(TS).isNotNull())
    buckets = bucketed(rows.withWatermark(TS, lateness), bucket)
    runs = buckets.groupBy(KEY).transformWithStateInPandas(processor, _EVENT, "append", "EventTime")
    change = F.col("power_after_kw") - F.col("power_before_kw")
    return runs.select(
        "*",
        F.abs(change).alias("power_change_kw"),
        F.when(change > 0, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
        risk_level_of_change(F.abs(change), CAPACITY_KW).alias("risk_level"),
    )
