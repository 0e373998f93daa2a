"""Ramps and shortfall risk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetcast.functions.columns import minutes_between
from fleetcast.operators.timeline import CHUNK_ROWS, ROW, TOTAL, along_timeline, kept_columns, with_row_index
from fleetcast.schemas import KEY, POWER, TS

# Thresholds in kW and percent, capacity in kW.
RAMP_KW = 500.0
RAMP_PCT = 30.0
CAPACITY_KW = 2000.0
SHORTFALL_PCT = 70.0

EDGE_SLOT = 65_536


def adjacent_ramps(
    indexed: DataFrame, min_change_kw: float = RAMP_KW, max_minutes: float = 60.0, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Neighbouring rows at most an hour apart whose power differs by the threshold or more."""
    pairs = along_timeline(
        kept_columns(indexed, KEY, TS, POWER, ROW, TOTAL),
        {
            "start_time": lambda w: F.lag(TS).over(w),
            "change_kw": lambda w: F.col(POWER) - F.lag(POWER).over(w),
        },
        back=1,
        chunk_rows=chunk_rows,
    )
    minutes = minutes_between(F.col(TS), F.col("start_time"))
    return pairs.where(
        (minutes > 0) & (minutes <= F.lit(float(max_minutes))) & (F.abs("change_kw") >= F.lit(float(min_change_kw)))
    ).select(KEY, "start_time", F.col(TS).alias("end_time"), "change_kw")


def is_ramp_step(before: Column, after: Column, ramp_kw: float = RAMP_KW, ramp_pct: float = RAMP_PCT) -> Column:
    change = after - before
    pct = F.when(before > 0, change / before * 100).otherwise(F.lit(0.0))
    return F.coalesce((F.abs(change) >= ramp_kw) | (F.abs(pct) >= ramp_pct), F.lit(False))


def risk_level_of_change(change_kw: Column, capacity_kw: float = CAPACITY_KW) -> Column:
    """R3."""
    ratio = change_kw / F.lit(float(capacity_kw)) if capacity_kw > 0 else F.lit(0.0)
    return (
        F.when(ratio > 0.5, F.lit("critical"))
        .when(ratio > 0.3, F.lit("high"))
        .when(ratio > 0.15, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def ramp_events(
    indexed: DataFrame,
    power: str = POWER,
    interval_minutes: int = 10,
    ramp_kw: float = RAMP_KW,
    ramp_pct: float = RAMP_PCT,
    min_duration_minutes: int = 10,
    capacity_kw: float = CAPACITY_KW,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """R2: runs of consecutive ramp steps, from the row before the run to its last row.

    A run's ends can be told from the three neighbouring rows alone, so no running state crosses a
    chunk. Only the ends are kept; along a timeline they alternate start, end, start, end, so numbering
    them pairs each start with its end, however long the run.
    """

    def ramp(before: Column, after: Column) -> Column:
        return is_ramp_step(before, after, ramp_kw, ramp_pct)

    steps = along_timeline(
        kept_columns(indexed, KEY, TS, power, ROW, TOTAL).withColumnRenamed(power, "_p"),
        {
            "_p1": lambda w: F.lag("_p", 1).over(w),
            "_p2": lambda w: F.lag("_p", 2).over(w),
            "_next": lambda w: F.lead("_p", 1).over(w),
            "_ts1": lambda w: F.lag(TS, 1).over(w),
        },
        back=2,
        ahead=1,
        chunk_rows=chunk_rows,
    )
    now = ramp(F.col("_p1"), F.col("_p"))
    starts = now & ~ramp(F.col("_p2"), F.col("_p1"))
    ends = now & ~ramp(F.col("_p"), F.col("_next"))

    def edge(first: bool, row: Column, ts: str, p: str) -> Column:
        return F.struct(
            F.lit(first).alias("is_start"), row.alias("row"), F.col(ts).alias("ts"), F.col(p).alias("power")
        )

    both = F.array(
        F.when(starts, edge(True, F.col(ROW) - 1, "_ts1", "_p1")), F.when(ends, edge(False, F.col(ROW), TS, "_p"))
    )
    edges = steps.where(starts | ends).select(KEY, F.inline(F.filter(both, lambda x: x.isNotNull())))
    numbered = with_row_index(
        edges, order=F.col("row"), slot=F.floor(F.col("row") / EDGE_SLOT), index="edge", total=None
    )

    def end_of(first: bool, c: str) -> Column:
        return F.max(F.when(F.col("is_start") == first, F.col(c)))

    change = F.col("power_after_kw") - F.col("power_before_kw")
    size = F.abs(change)
    return (
        numbered.groupBy(KEY, F.floor(F.col("edge") / 2).alias("event_no"))
        .agg(
            end_of(True, "ts").alias("start_time"),
            end_of(False, "ts").alias("end_time"),
            end_of(True, "power").alias("power_before_kw"),
            end_of(False, "power").alias("power_after_kw"),
            ((end_of(False, "row") - end_of(True, "row") + 1) * interval_minutes).alias("duration_minutes"),
        )
        .where(F.col("duration_minutes") >= min_duration_minutes)
        .select(
            KEY,
            "start_time",
            "end_time",
            "power_before_kw",
            "power_after_kw",
            size.alias("power_change_kw"),
            F.when(F.col("power_before_kw") > 0, F.abs(change / F.col("power_before_kw") * 100))
            .otherwise(F.lit(0.0))
            .alias("power_change_pct"),
            "duration_minutes",
            minutes_between(F.col("end_time"), F.col("start_time")).alias("elapsed_minutes"),
            F.when(change > 0, F.lit("up")).otherwise(F.lit("down")).alias("direction"),
            risk_level_of_change(size, capacity_kw).alias("risk_level"),
        )
        .withColumn("ramp_rate_kw_per_min", F.col("power_change_kw") / F.col("elapsed_minutes"))
    )


def in_ramp(ramp_kw: float = RAMP_KW, ramp_pct: float = RAMP_PCT) -> Callable[[WindowSpec], Column]:
    """Whether a row is part of a run of ramp steps, or the row before it, for a window along the timeline."""
    return lambda w: is_ramp_step(F.lag(POWER).over(w), F.col(POWER), ramp_kw, ramp_pct) | is_ramp_step(
        F.col(POWER), F.lead(POWER).over(w), ramp_kw, ramp_pct
    )


def rows_in_ramps(
    indexed: DataFrame, ramp_kw: float = RAMP_KW, ramp_pct: float = RAMP_PCT, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Rows with ``in_ramp``: part of a run, or the row before it. No range join: a row's neighbours decide."""
    flagged = along_timeline(
        kept_columns(indexed, KEY, TS, POWER, ROW, TOTAL),
        {"in_ramp": in_ramp(ramp_kw, ramp_pct)},
        back=1,
        ahead=1,
        chunk_rows=chunk_rows,
    )
    return flagged.select(KEY, TS, "in_ramp")


def sample_target_ramps(
    indexed: DataFrame, seq_len: int = 144, pred_len: int = 6, chunk_rows: int = CHUNK_ROWS, **options
) -> DataFrame:
    """Ramps over the first target of each sequence sample.

    Those targets are the rows from ``seq_len`` on that have ``pred_len - 1`` rows after them.
    """
    last = F.col(TOTAL) - pred_len
    targets = indexed.where((F.col(ROW) >= seq_len) & (F.col(ROW) <= last))
    shifted = targets.withColumn(TOTAL, last - seq_len + 1).withColumn(ROW, F.col(ROW) - seq_len)
    return ramp_events(shifted, chunk_rows=chunk_rows, **options)


def shortfall_level(probability: Column, magnitude_kw: Column, capacity_kw: float = CAPACITY_KW) -> Column:
    """R5."""
    ratio = magnitude_kw / F.lit(float(capacity_kw)) if capacity_kw > 0 else F.lit(0.0)
    return (
        F.when((probability > 0.7) & (ratio > 0.2), F.lit("critical"))
        .when((probability > 0.5) & (ratio > 0.15), F.lit("high"))
        .when(probability > 0.3, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def shortfall_risk(
    forecast: DataFrame, capacity_kw: float = CAPACITY_KW, threshold_pct: float = SHORTFALL_PCT
) -> DataFrame:
    """R4 on rows with ``p10`` and ``p50``: one row per point that may fall short of the threshold."""
    threshold = F.lit(capacity_kw * (threshold_pct / 100))
    likely = F.col("p50") < threshold
    probability = F.when(likely, F.lit(0.8)).otherwise(F.lit(0.5))
    shortfall = F.when(likely, threshold - F.col("p50")).otherwise(threshold - F.col("p10"))
    return (
        forecast.where(F.col("p10") < threshold)
        .withColumns({"shortfall_probability": probability, "expected_shortfall_kw": shortfall})
        .select(
            KEY,
            TS,
            F.col("p50").alias("expected_power_kw"),
            threshold.alias("shortfall_threshold_kw"),
            "shortfall_probability",
            "expected_shortfall_kw",
            shortfall_level(F.col("shortfall_probability"), F.col("expected_shortfall_kw"), capacity_kw).alias(
                "risk_level"
            ),
        )
    )


def assess_forecast(indexed_forecast: DataFrame, capacity_kw: float = CAPACITY_KW, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Ramps on p50 and shortfall on p10/p50 in one table, told apart by ``kind``."""
    ramps = ramp_events(indexed_forecast, power="p50", capacity_kw=capacity_kw, chunk_rows=chunk_rows).select(
        KEY,
        F.lit("ramp").alias("kind"),
        F.col("start_time").alias(TS),
        "end_time",
        F.col("power_change_kw").alias("magnitude_kw"),
        F.lit(None).cast("double").alias("shortfall_probability"),
        "risk_level",
    )
    risks = shortfall_risk(indexed_forecast, capacity_kw).select(
        KEY,
        F.lit("shortfall").alias("kind"),
        TS,
        F.col(TS).alias("end_time"),
        F.col("expected_shortfall_kw").alias("magnitude_kw"),
        "shortfall_probability",
        "risk_level",
    )
    return ramps.unionByName(risks)
