"""Lag, rolling, calendar and physics features along each asset's timeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetcast.functions.columns import calendar_columns, direction_columns, physics_columns
from fleetcast.operators.timeline import (
    CHUNK,
    CHUNK_ROWS,
    ROW,
    TOTAL,
    along_timeline,
    attach,
    chunk_of,
    chunk_window,
    chunked,
    stored_reach,
    with_row_index,
)
from fleetcast.schemas import KEY, POWER, TS, WIND
from fleetcast.session import written, written_once

# Lag and window sets, power in kW above which a turbine counts as active.
LAGS = (1, 3, 6, 12, 24)
WINDOWS = (3, 6, 12)
TRAINING_LAGS = (1, 3, 6, 12, 24, 36, 48)
TRAINING_WINDOWS = (3, 6, 12, 24, 48)
FALLBACK_SETS = (
    ((1, 3, 6, 12, 24, 36, 48), (3, 6, 12, 24, 48)),
    ((1, 3, 6, 12, 24), (3, 6, 12)),
    ((1, 3, 6), (3, 6)),
    ((1,), (2,)),
)
ACTIVE_KW = 100.0
TARGET = "target_active_power_kw"


def rolling(f, column: str, n: int, w: WindowSpec, until: int = 0) -> Column:
    """``f`` over the ``n`` rows ending ``-until`` rows ago; null unless all ``n`` values are there."""
    frame = w.rowsBetween(until - n + 1, until)
    return F.when(F.count(column).over(frame) == n, f(column).over(frame))


def window_columns(lags: Sequence[int], windows: Sequence[int]) -> dict[str, object]:
    """W1-W4 as builders for ``along_timeline``; all share one window, hence one sort."""
    out: dict[str, object] = {}
    series = {"active_power": POWER, "wind_speed": WIND}
    for k in lags:
        for name, c in series.items():
            out[f"{name}_lag_{k}"] = lambda w, c=c, k=k: F.lag(c, k).over(w)
    for n in windows:
        for name, c in series.items():
            out[f"{name}_roll_mean_{n}"] = lambda w, c=c, n=n: rolling(F.avg, c, n, w)
        out[f"active_power_roll_std_{n}"] = lambda w, n=n: rolling(F.stddev_samp, POWER, n, w)
    out["power_rate_of_change"] = lambda w: F.col(POWER) - F.lag(POWER).over(w)
    out["wind_speed_rate_of_change"] = lambda w: F.col(WIND) - F.lag(WIND).over(w)
    out["_mean_3"] = lambda w: rolling(F.avg, POWER, 3, w)
    out["_std_3"] = lambda w: rolling(F.stddev_samp, POWER, 3, w)
    return out


def complete_rows_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P10 for wide frames: one IS NOT NULL per column.

    ``dropna`` puts all columns into one predicate, for which the optimizer works out a variant per
    subset of the computed columns: minutes of planning at this width. Missing values are nulls here,
    never NaN (F1).
    """
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull()
    return rows.where(keep)


def _derived() -> dict[str, Column]:
    physics = physics_columns(F.col("_mean_3"), F.col("_std_3"))
    return {**direction_columns(), **calendar_columns(), **physics, "persistence_kw": F.col(POWER)}


def _finish(rows: DataFrame) -> DataFrame:
    kept = complete_rows_of(rows, rows.columns)  # the physics columns need the last three rows, whatever the windows
    return kept.withColumns(_derived()).drop("_mean_3", "_std_3")


def _reach(lags: Sequence[int], windows: Sequence[int]) -> int:
    return max(*lags, *[n - 1 for n in windows], 2)


def tabular_features(
    indexed: DataFrame,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """F2 over indexed rows; rows with any missing value are dropped (P10)."""
    return _finish(along_timeline(indexed, window_columns(lags, windows), _reach(lags, windows), 0, chunk_rows))


def supervised_features(
    indexed: DataFrame,
    horizon_steps: int,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    complete_rows: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """features plus the power ``horizon_steps`` surviving rows later.

    The target is shifted after incomplete rows are dropped, which needs a second numbering of the
    surviving rows. Where the input has no missing values only the warm-up rows drop out, both
    orders agree, and ``complete_rows=True`` takes the target in the same pass.
    """
    if horizon_steps < 1:
        raise ValueError(f"a target {horizon_steps} steps ahead is no forecast: at least 1 is needed")

    def target(w: WindowSpec) -> Column:
        return F.lead(POWER, horizon_steps).over(w)

    if complete_rows:
        columns = {**window_columns(lags, windows), TARGET: target}
        return _finish(along_timeline(indexed, columns, _reach(lags, windows), horizon_steps, chunk_rows))
    survivors = with_row_index(tabular_features(indexed, lags, windows, chunk_rows).drop(ROW, TOTAL))
    return along_timeline(survivors, {TARGET: target}, 0, horizon_steps, chunk_rows).where(F.col(TARGET).isNotNull())


def _survivors(base: DataFrame, lags: Sequence[int], windows: Sequence[int], chunk_rows: int) -> DataFrame:
    """The complete rows (P10) numbered anew: asset, power, ``_at`` (the row's number so far), row number and total.

    Whether the window columns are there follows from counts: the longest window's, and the lags beyond it. The numbers come from
    the place within the chunk and the counts of the chunks before, so the rows are exchanged once.
    """
    own = F.lit(min(windows, default=2) > 1)  # the deviation of one row is missing
    for c in base.columns:
        own = own & F.col(c).isNotNull()
    slim = base.select(KEY, ROW, TOTAL, POWER, F.when(F.col(WIND).isNotNull(), F.lit(1)).alias(WIND), own.alias("_own"))
    w, complete = chunk_window(), F.col("_own")
    checks = {}
    for c, least in ((POWER, 3), (WIND, 1)):
        n = max([*windows, least])
        checks[f"_all_{c}"] = F.count(c).over(w.rowsBetween(1 - n, 0)) == n
        for k in sorted({k for k in (1, *lags) if k >= n}):
            checks[f"_lag_{c}_{k}"] = F.lag(c, k).over(w).isNotNull()
    for name in checks:
        complete = complete & F.col(name)
    reach = chunked(slim, _reach(lags, windows), 0, chunk_rows).select("*", *[c.alias(name) for name, c in checks.items()])
    home = reach.where(complete & (F.col(CHUNK) == chunk_of(F.col(ROW), chunk_rows)))
    placed = written(home.select(KEY, CHUNK, F.col(ROW).alias("_at"), POWER, F.row_number().over(w).alias("_place")), "complete-rows")
    counts = placed.groupBy(KEY, CHUNK).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(KEY, CHUNK, (F.sum("_n").over(upto) - F.col("_n")).alias("_offset"), F.sum("_n").over(Window.partitionBy(KEY)).alias(TOTAL))
    rows = placed.join(written(offsets, "chunk-offsets"), [KEY, CHUNK])
    return rows.select(KEY, POWER, "_at", (F.col("_offset") + F.col("_place") - 1).alias(ROW), TOTAL)


def supervised_for_horizons(
    indexed: DataFrame,
    steps: Sequence[int],
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    chunk_rows: int = CHUNK_ROWS,
    table: str | None = None,
) -> DataFrame:
    """F3 for several horizons at once: the features, which don't depend on the horizon, and a target column for each.

    Rows are numbered anew (complete ones only); the last rows of an asset lack the targets that lie beyond its end. ``table`` names
    a written table for them, which holds only what other columns of its rows don't give; the rest is derived where it is read.

    Only the measures are exchanged: the complete rows are numbered by their keys and power, and their targets go with the measures into
    the chunks in which the features are derived, so that the wide rows are never moved.
    """
    if stored := stored_reach(indexed):
        indexed = indexed.where(F.col(CHUNK) == chunk_of(F.col(ROW), stored["chunk_rows"])).drop(CHUNK)
    base = written_once(indexed, "numbered-rows")  # rows of one time are numbered in one order for both passes
    leads = {target_of(n): lambda w, n=n: F.lead(POWER, n).over(w) for n in steps}
    targets = along_timeline(_survivors(base, lags, windows, chunk_rows), leads, 0, max(steps), chunk_rows)
    known = F.struct(F.col(ROW), F.col(TOTAL), *leads)
    known = targets.select(KEY, F.col("_at").alias(ROW), chunk_of(F.col("_at"), chunk_rows).alias(CHUNK), known.alias("_known"), F.lit(0).alias("_measured"))
    reach = chunked(base, _reach(lags, windows), 0, chunk_rows).withColumn("_measured", F.lit(1))
    both = Window.partitionBy(KEY, CHUNK).orderBy(ROW, "_measured")
    before = F.when(F.lag(ROW).over(both) == F.col(ROW), F.lag("_known").over(both))  # what is known of a row comes just before it
    rows = reach.unionByName(known, allowMissingColumns=True).withColumn("_of", before).where(F.col("_measured") == 1)
    made = window_columns(lags, windows)
    given = {"_mean_3": "active_power_roll_mean_3", "_std_3": "active_power_roll_std_3"} if 3 in windows else {}
    again = {name: F.col(c) for name, c in given.items()}
    if 1 in lags:
        again["power_rate_of_change"] = F.col(POWER) - F.col("active_power_lag_1")
        again["wind_speed_rate_of_change"] = F.col(WIND) - F.col("wind_speed_lag_1")
    w = chunk_window()
    rows = rows.select(*base.columns, CHUNK, "_of", *[make(w).alias(name) for name, make in made.items() if name not in again])
    rows = rows.where(F.col("_of").isNotNull() & (F.col(CHUNK) == chunk_of(F.col(ROW), chunk_rows)))
    measures = [c for c in base.columns if c not in (ROW, TOTAL)]
    rows = rows.select(*measures, *[name for name in made if name not in again], "_of.*")
    if table:
        rows = written(rows, table)
    shown = [name for name in made if name not in ("_mean_3", "_std_3")]
    return rows.withColumns(again).withColumns(_derived()).select(*measures, *shown, *_derived(), ROW, TOTAL, *leads)


def target_of(steps: int) -> str:
    return f"{TARGET}_{steps}"


def supervised_rows(frame: DataFrame, steps: int) -> DataFrame:
    """The rows of one horizon of ``supervised_for_horizons``, as ``supervised_features`` gives them."""
    others = [c for c in frame.columns if c.startswith(f"{TARGET}_") and c != target_of(steps)]
    return frame.drop(*others).withColumnRenamed(target_of(steps), TARGET).where(F.col(TARGET).isNotNull())


def active_rows(rows: DataFrame, least: Mapping[str, int] | None = None) -> DataFrame:
    """Rows above 100 kW; all rows of an asset's split that has fewer active ones than ``least``.

    A split not named in ``least`` keeps all its rows.
    """
    least = {"train": 100, "val": 50} if least is None else least
    enough = F.lit(False)
    for split, n in least.items():
        enough = enough | ((F.col("split") == split) & (F.col("_active") >= n))
    active = F.col(POWER) > ACTIVE_KW
    # written, so that its size is known to be small and the rows stay where they are
    counts = written(rows.groupBy(KEY, "split").agg(F.count_if(active).alias("_active")), "active-rows")
    return attach(rows, counts, [KEY, "split"]).where(active | ~enough).drop("_active")


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns a model may see: no keys, no current power, no target, no bookkeeping."""
    hidden = {KEY, TS, POWER, TARGET, ROW, TOTAL, "ingest_seq", "forecast_ts", "split", "delta_kw", "weight"}
    numeric = {"double", "float", "int", "bigint"}
    return [name for name, kind in df.dtypes if name not in hidden and kind in numeric]


def usable_rows(n_rows: Column, lags: Sequence[int], windows: Sequence[int], horizon_steps: int) -> Column:
    lost = max(max(lags), max(windows) - 1, 2) + horizon_steps
    return F.greatest(n_rows - lost, F.lit(0))


def feature_set_choice(indexed: DataFrame, horizon_steps: int, min_rows: int = 10) -> DataFrame:
    """per asset the first lag/window set that leaves at least ``min_rows`` rows.

    Taken from the row count alone: a set loses its longest look-back and the horizon.
    """
    counts = indexed.groupBy(KEY).agg(F.max(TOTAL).alias(TOTAL))
    choice = F.lit(len(FALLBACK_SETS) - 1)
    for i in reversed(range(len(FALLBACK_SETS) - 1)):
        lags, windows = FALLBACK_SETS[i]
        choice = F.when(usable_rows(F.col(TOTAL), lags, windows, horizon_steps) >= min_rows, F.lit(i)).otherwise(choice)
    sets = F.array(
        *[
            F.struct(F.array(*map(F.lit, lags)).alias("lags"), F.array(*map(F.lit, windows)).alias("windows"))
            for lags, windows in FALLBACK_SETS
        ]
    )
    return counts.withColumn("feature_set", choice).select(
        KEY,
        TOTAL,
        "feature_set",
        sets[F.col("feature_set")]["lags"].alias("lags"),
        sets[F.col("feature_set")]["windows"].alias("windows"),
    )
