"""Linear models over sliding windows without building the windows.

The windows of a series overlap, so the products their regression needs are sums of lagged products of the series: one sum per lag for
the first row of the windows, and for the later rows what a shift adds at one end and drops at the other. Chunks of rows add up
their part in numpy; the figures of a task are one matrix of the window's length squared, whatever the rows. Scoring a window is a
correlation with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.operators.splits import named_split, row_bounds
from fleetcast.operators.timeline import CHUNK, CHUNK_ROWS, ROW, TOTAL, chunk_of, chunked
from fleetcast.schemas import KEY, POWER, TS


@dataclass(frozen=True)
class Moments:
    """Of the train windows: their number, and means and covariances (divisor n) of the flattened window (row by row) and the target."""

    n: int
    x_mean: np.ndarray
    y_mean: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float


def train_windows(seq_len: int, steps: int) -> Column:
    """Windows of an asset whose target lies in its train part."""
    return F.greatest(row_bounds(F.col(TOTAL))[0] - (seq_len + steps - 1), F.lit(0))


def _products(z: np.ndarray, y: np.ndarray, first: int, windows: int, own: int, length: int, ahead: int, into: dict) -> None:
    """Adds one chunk: rows z (values by feature) from row `first` on, of which windows start in the first `own` rows;
    the asset has `windows` train windows in all, and y is the target series of the same rows."""
    count = min(own, windows - first)
    if count <= 0:
        return
    target = y[length + ahead - 1 :][:count]
    into["n"] += count
    into["y"] += target.sum()
    into["yy"] += target @ target
    base = z[:count]
    into["x"] += base.sum(axis=0)
    for lag in range(length):
        later = z[lag : lag + count]
        into["lagged"][lag] += base.T @ later
        into["xy"][lag] += target @ later
    if first == 0:  # shifting the windows by k rows drops the first k
        _edge(z[: length - 1], -1.0, into)
    if first + count == windows:  # and adds the k behind the last start
        _edge(z[count : count + length - 1], 1.0, into)


def _edge(rows: np.ndarray, sign: float, into: dict) -> None:
    """sum over s < k of rows[s] x rows[s + l - k], for all k <= l: along a diagonal each is the one before and one product more."""
    n, f = rows.shape
    sums = np.cumsum(rows, axis=0)
    into["x_edge"][1:] += sign * sums
    held = np.zeros((n + 1, f, n + 1, f))
    for k in range(n):
        held[k + 1, :, k + 1 :, :] = held[k, :, k:-1, :] + rows[k][:, None, None] * rows[None, k:, :]
    into["edge"] += sign * held.reshape((n + 1) * f, (n + 1) * f)


def _empty(length: int, features: int) -> dict:
    wide = length * features
    return {
        "n": 0, "y": 0.0, "yy": 0.0, "x": np.zeros(features), "lagged": np.zeros((length, features, features)),
        "xy": np.zeros((length, features)), "x_edge": np.zeros((length, features)), "edge": np.zeros((wide, wide)),
    }


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (asset, chunk) after another, from batches sorted by them: a chunk has a bounded number of rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in (KEY, CHUNK)]
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(last.column(c)[0] != k[0] for c, k in zip((KEY, CHUNK), keys, strict=True)):
                yield pa.Table.from_batches(held)
                held = []
        new = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            new |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
        at = 0
        for end in (np.flatnonzero(new) + 1).tolist():
            yield pa.Table.from_batches([*held, batch.slice(at, end - at)])
            held, at = [], end
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _named(features: Sequence[str], target: str) -> tuple[dict[str, Column], list[str], str]:
    """The columns that windows need, each once, by the names they have on the way; those of the features, and of the target."""
    names = [f"_x{i}" for i in range(len(features))]
    y = names[features.index(target)] if target in features else "_y"
    return {n: F.col(c).cast("double") for n, c in {**dict(zip(names, features, strict=True)), y: target}.items()}, names, y


def _matrix(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.float64) for c in columns], axis=1)


def window_moments(
    indexed: DataFrame, features: Sequence[str], seq_len: int, steps: int, target: str = POWER, chunk_rows: int = CHUNK_ROWS
) -> Moments:
    """Means and covariances over the train windows of all assets. Missing values make them NaN."""
    features = list(features)
    train_end = row_bounds(F.col(TOTAL))[0]
    carried, names, y_name = _named(features, target)
    rows = indexed.where(F.col(ROW) < train_end).select(
        KEY, ROW, F.col(TOTAL), train_windows(seq_len, steps).alias("_windows"), *[c.alias(n) for n, c in carried.items()]
    )
    rows = rows.where(F.col("_windows") > 0)
    means = rows.agg(*[F.avg(c) for c in (*names, y_name)]).first()
    if means[0] is None:
        return Moments(0, np.zeros(seq_len * len(features)), 0.0, np.zeros((0, 0)), np.zeros(0), 0.0)
    # products are taken about these, so that nothing is lost when the means are taken off
    about = np.array(means[: len(features)], np.float64)
    y_about = float(means[len(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _empty(seq_len, len(names))
        for chunk in _chunks_of(batches):
            first = int(chunk.column(CHUNK)[0].as_py()) * chunk_rows
            z, y = _matrix(chunk, names) - about, chunk.column(y_name).to_numpy() - y_about
            _products(z, y, first, int(chunk.column("_windows")[0].as_py()), chunk_rows, seq_len, steps, total)
        if total["n"]:
            out = [("n", 0, np.array([total["n"], total["y"], total["yy"]])), ("x", 0, total["x"]), ("xy", 0, total["xy"]), ("x_edge", 0, total["x_edge"])]
            out += [("lagged", 0, total["lagged"])]
            if total["edge"].any():  # only the first and the last chunk of an asset have edges
                out += [("edge", k, row) for k, row in enumerate(total["edge"])]
            columns = [[o[0] for o in out], pa.array([o[1] for o in out], pa.int32()), [np.ascontiguousarray(o[2]).tobytes() for o in out]]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=["part", "k", "values"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        """One row of the figures, from one part per task."""
        total = sum(np.frombuffer(v, np.float64) for v in parts["values"])
        return pd.DataFrame({"part": parts["part"][:1], "k": parts["k"][:1], "values": [total.tobytes()]})

    reach = chunked(rows, 0, seq_len + steps - 1, chunk_rows, total=TOTAL)
    dealt = reach.repartition(KEY, CHUNK).sortWithinPartitions(KEY, CHUNK, ROW).drop(TOTAL, ROW)
    kind = "part string, k int, values binary"
    found = {(p, k): np.frombuffer(v, np.float64) for p, k, v in dealt.mapInArrow(run, kind).groupBy("part", "k").applyInPandas(add, kind).collect()}
    return _moments(found, seq_len, len(names), about, y_about)


def _moments(found: dict, length: int, features: int, about: np.ndarray, y_about: float) -> Moments:
    wide = length * features
    n, y, yy = found["n", 0]
    lagged = found["lagged", 0].reshape(length, features, features)
    edge = np.stack([found.get(("edge", k), np.zeros(wide)) for k in range(wide)]).reshape(length, features, length, features)
    sums = np.zeros((length, features, length, features))
    for k in range(length):
        sums[k, :, k:, :] = lagged[: length - k].transpose(1, 0, 2) + edge[k, :, k:, :]
    upper = sums.reshape(wide, wide)
    mask = np.triu(np.ones((length, length), bool)).repeat(features, axis=0).repeat(features, axis=1)
    full = np.where(mask, upper, upper.T)
    x = (found["x", 0] + found["x_edge", 0].reshape(length, features)).reshape(wide) / n
    y = y / n
    xx = full / n - np.outer(x, x)
    xy = found["xy", 0] / n - x * y
    return Moments(int(n), x + np.tile(about, length), float(y + y_about), xx, xy, float(yy / n - y * y))


def ridge(moments: Moments, reg_param: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the regression on standardised windows and target, with the penalty scaled to the target's
    deviation; a constant entry has weight 0."""
    if not np.isfinite(moments.xx).all() or not np.isfinite(moments.xy).all():
        raise ValueError("the windows hold missing values")
    x_std, y_std = np.sqrt(np.maximum(np.diag(moments.xx), 0)), float(np.sqrt(max(moments.yy, 0)))
    weights = np.zeros(len(x_std))
    live = x_std > 1e-12 * np.maximum(np.abs(moments.x_mean), 1)
    if y_std > 0 and live.any():
        scaled = moments.xx[np.ix_(live, live)] / np.outer(x_std[live], x_std[live])
        wanted = moments.xy[live] / (x_std[live] * y_std)
        solved = np.linalg.solve(scaled + reg_param / y_std * np.eye(int(live.sum())), wanted)
        weights[live] = solved * y_std / x_std[live]
    return weights, float(moments.y_mean - weights @ moments.x_mean)


def window_scores(
    indexed: DataFrame, features: Sequence[str], weights: np.ndarray, intercept: float, seq_len: int, steps: int, target: str = POWER,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """asset, timestamp (that of the row behind the window), sample_index, actual_kw, baseline_kw (the window's last), raw_kw, split of the
    windows of the val and test parts."""
    features = list(features)
    train_end, val_end = row_bounds(F.col(TOTAL))
    carried, names, y_name = _named(features, target)
    rows = indexed.where(F.col(ROW) >= train_windows(seq_len, steps)).select(KEY, TS, ROW, TOTAL, *[c.alias(n) for n, c in carried.items()])
    by_feature = np.asarray(weights, np.float64).reshape(seq_len, len(features))

    def scored(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(ROW)
        behind = chunk[TS].to_numpy()[seq_len:]
        n = max(min(len(chunk) - (seq_len + steps - 1), len(behind)), 0)
        z, y = chunk[names].to_numpy(np.float64), chunk[y_name].to_numpy(np.float64)
        raw = np.full(n, intercept)
        if n:
            for i in range(len(names)):
                raw = raw + np.correlate(z[: n + seq_len - 1, i], by_feature[:, i], "valid")
        return pd.DataFrame({
            KEY: chunk[KEY].to_numpy()[:n], TS: behind[:n], "sample_index": chunk[ROW].to_numpy()[:n], TOTAL: chunk[TOTAL].to_numpy()[:n],
            CHUNK: chunk[CHUNK].to_numpy()[:n], "actual_kw": y[seq_len + steps - 1 :][:n], "baseline_kw": y[seq_len - 1 :][:n], "raw_kw": raw,
        })

    kind = f"{KEY} string, {TS} timestamp_ntz, sample_index long, {TOTAL} long, {CHUNK} long, actual_kw double, baseline_kw double, raw_kw double"
    found = chunked(rows, 0, seq_len + steps - 1, chunk_rows).groupBy(KEY, CHUNK).applyInPandas(scored, kind)
    split = named_split(F.col("sample_index") + (seq_len + steps - 1), train_end, val_end)
    # a chunk scores the windows that start in it
    home = found.where(F.col(CHUNK) == chunk_of(F.col("sample_index"), chunk_rows))
    return home.select(KEY, TS, "sample_index", "actual_kw", "baseline_kw", "raw_kw", split.alias("split"))
