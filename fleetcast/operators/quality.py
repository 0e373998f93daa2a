"""Quality reports, validation issues and data summaries per asset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.columns import minutes_between
from fleetcast.operators.cleaning import drop_repeats
from fleetcast.operators.timeline import CHUNK_ROWS, along_timeline, with_row_index
from fleetcast.schemas import DIRECTION, KEY, MEASURES, POWER, REQUIRED, SEQ, SOURCE_FILE, TS, WIND

ARRIVAL_SLOT = 65_536

# Ranges checked when none are given.
DEFAULT_RANGES: dict[str, tuple[float | None, float | None]] = {
    POWER: (0.0, None),
    WIND: (0.0, None),
    DIRECTION: (0.0, 360.0),
}


def arrival_order(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per asset, how often a timestamp repeats or steps back in order of arrival.

    Rows that come from files arrive file by file, in the order of the paths; line numbers start anew in each.
    """
    files = [SOURCE_FILE] if SOURCE_FILE in df.columns else []
    rows = with_row_index(
        df.select(KEY, TS, *files, SEQ),
        order=F.struct(*files, SEQ),
        slot=F.struct(*files, F.floor(F.col(SEQ) / ARRIVAL_SLOT).cast("long").alias("block")),
    )
    rows = along_timeline(rows, {"previous_ts": lambda w: F.lag(TS).over(w)}, back=1, chunk_rows=chunk_rows)
    return rows.groupBy(KEY).agg(
        F.count_if(F.col(TS) == F.col("previous_ts")).alias("repeats_in_arrival"),
        F.count_if(F.col(TS) < F.col("previous_ts")).alias("steps_back"),
    )


def _violations() -> dict[str, Column]:
    direction = F.col(DIRECTION)
    return {
        "wind_speed_mps_negative": F.count_if(F.col(WIND) < 0),
        "wind_direction_out_of_range": F.count_if((direction < 0) | (direction >= 360)),
        "active_power_negative": F.count_if(F.col(POWER) < 0),
    }


def _as_map(entries: Mapping[str, Column]) -> Column:
    return F.create_map(*[part for name, c in entries.items() for part in (F.lit(name), c)])


def quality_report(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A1 on rows as they arrived: measured before deduplication, so repeats are seen.

    ``monotonic`` is strict order of arrival.
    """
    missing = {c: F.count_if(F.col(c).isNull()) for c in REQUIRED}
    report = df.groupBy(KEY).agg(
        F.count("*").alias("total_records"),
        _as_map(missing).alias("missing_counts"),
        _as_map(_violations()).alias("range_violations"),
        (F.count("*") - F.count_distinct(TS)).alias("duplicate_timestamps"),
        F.min(TS).alias("start_time"),
        F.max(TS).alias("end_time"),
    )
    order = arrival_order(df, chunk_rows)
    return (
        report.join(order, KEY)
        .withColumn("monotonic", (F.col("repeats_in_arrival") + F.col("steps_back")) == 0)
        .drop("repeats_in_arrival", "steps_back")
    )


def _issue(field: str, check: str, message: Column, count: Column, severity: str) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(check).alias("check"),
        message.alias("message"),
        count.cast("long").alias("count"),
        F.lit(severity).alias("severity"),
    )


# The fields, checks and message texts below are values of the output.
def _issues_per_asset(
    df: DataFrame,
    required: Sequence[str],
    ranges: Mapping[str, tuple[float | None, float | None]],
    strict: bool,
    chunk_rows: int,
) -> DataFrame:
    """Per asset two arrays: structural errors, and warnings (marked as errors when strict)."""
    soft = "error" if strict else "warning"
    missing = sorted(set(required) - set(df.columns))
    errors = []
    if missing:
        errors.append(
            _issue("columns", "required", F.lit(f"Missing required columns: {missing}"), F.lit(len(missing)), "error")
        )
    if TS not in df.columns:
        errors.append(_issue(TS, "exists", F.lit(f"Timestamp column '{TS}' not found"), F.lit(1), "error"))
    ranged = {c: bounds for c, bounds in ranges.items() if c in df.columns}
    figures = []
    for c, (low, high) in ranged.items():
        outside = F.lit(0)
        if low is not None:
            outside = outside + F.count_if(F.col(c) < low)
        if high is not None:
            outside = outside + F.count_if(F.col(c) > high)
        figures.append(outside.alias(f"outside_{c}"))
    if TS in df.columns:
        figures += [
            F.count(TS).alias("stamped"),
            F.count_distinct(TS).alias("distinct_stamps"),
            F.count_if(F.col(TS).isNull()).alias("unparsed"),
        ]
    wide = df.groupBy(KEY).agg(F.count("*").alias("rows"), *figures)
    warnings = []
    if TS in df.columns:
        wide = wide.join(arrival_order(df, chunk_rows).select(KEY, "steps_back"), KEY)
        repeats = F.col("stamped") - F.col("distinct_stamps")
        errors.append(
            F.when(
                F.col("unparsed") > 0,
                _issue(TS, "parseable", F.lit("Failed to parse timestamps"), F.lit(1), "error"),
            )
        )
        warnings += [
            F.when(
                F.col("steps_back") > 0,
                _issue(TS, "monotonic", F.lit("Timestamps are not strictly monotonic"), repeats + 1, soft),
            ),
            F.when(
                repeats > 0,
                _issue(
                    TS,
                    "duplicates",
                    F.concat(F.lit("Found "), repeats.cast("string"), F.lit(" duplicate timestamps")),
                    repeats,
                    soft,
                ),
            ),
        ]
    for c, (low, high) in ranged.items():
        outside = F.col(f"outside_{c}")
        text = F.lit(f"Values outside valid range [{low}, {high}]")
        warnings.append(F.when(outside > 0, _issue(c, "range", text, outside, soft)))
    kind = "array<struct<field:string,check:string,message:string,count:bigint,severity:string>>"
    return wide.select(
        KEY,
        F.filter(F.array(*errors).cast(kind), lambda x: x.isNotNull()).alias("errors"),
        F.filter(F.array(*warnings).cast(kind), lambda x: x.isNotNull()).alias("warnings"),
    )


def validation_issues(
    df: DataFrame,
    required: Sequence[str] = tuple(REQUIRED),
    ranges: Mapping[str, tuple[float | None, float | None]] = DEFAULT_RANGES,
    strict: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A2: one row per issue (asset, field, check, message, count, severity)."""
    both = _issues_per_asset(df, required, ranges, strict, chunk_rows)
    return both.select(KEY, F.inline(F.concat("errors", "warnings")))


def validation_summary(
    df: DataFrame,
    required: Sequence[str] = tuple(REQUIRED),
    ranges: Mapping[str, tuple[float | None, float | None]] = DEFAULT_RANGES,
    strict: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """A2: per asset the number of errors and warnings, and whether validation passed."""
    both = _issues_per_asset(df, required, ranges, strict, chunk_rows)
    clean = F.size("errors") == 0
    if strict:
        clean = clean & (F.size("warnings") == 0)
    return both.select(
        KEY,
        F.size("errors").cast("long").alias("n_errors"),
        F.size("warnings").cast("long").alias("n_warnings"),
        clean.alias("passed"),
    )


def data_summary(df: DataFrame) -> DataFrame:
    """A3."""
    return df.groupBy(KEY).agg(
        F.count("*").alias("total_records"),
        F.min(TS).alias("start_time"),
        F.max(TS).alias("end_time"),
        *[
            f(c).alias(f"{label}_{name}")
            for c, label in ((POWER, "power"), (WIND, "wind"))
            for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))
        ],
    )


def record_summary(df: DataFrame) -> DataFrame:
    """A4: records, first and last timestamp, missing values per column."""
    return df.groupBy(KEY).agg(
        F.count("*").alias("records"),
        F.min(TS).alias("start_time"),
        F.max(TS).alias("end_time"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in REQUIRED],
    )


def missingness(df: DataFrame, step_minutes: float = 10.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """K4: per asset and day, missing values per column and time steps absent before a row, one row per timestamp counted.

    Absent steps are read off the gap to the previous row, so no expected timeline is generated. Repeats
    go first, so a day in which one timestamp was sent a billion times has no more rows than any other.
    """
    rows = along_timeline(
        with_row_index(drop_repeats(df)), {"previous_ts": lambda w: F.lag(TS).over(w)}, back=1, chunk_rows=chunk_rows
    )
    gap = F.rint(minutes_between(F.col(TS), F.col("previous_ts")) / F.lit(float(step_minutes))) - 1
    return rows.groupBy(KEY, F.to_date(TS).alias("day")).agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in MEASURES],
        F.coalesce(F.sum(F.greatest(gap, F.lit(0.0)).cast("long")), F.lit(0)).alias("missing_steps"),
    )
