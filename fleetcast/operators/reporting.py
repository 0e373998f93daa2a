"""Report tables over observations and backtest outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.columns import coverage, mae, rmse
from fleetcast.operators.quantiles import group_quantiles
from fleetcast.operators.timeline import ROW, attach
from fleetcast.schemas import KEY, MEASURES, POWER, RATED_KW, TS, WIND


def forecast_against_actual(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecast rows with the power observed at their time, and the residual."""
    observed = actual.select(KEY, TS, F.col(POWER).alias("actual_kw"))
    return forecast.join(observed, [KEY, TS]).withColumn("residual_kw", F.col("actual_kw") - F.col("p50"))


def alignment_scores(aligned: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    a, p = F.col("actual_kw"), F.col("p50")
    return aligned.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        mae(a, p).alias("mae"),
        rmse(a, p).alias("rmse"),
        coverage(a, F.col("p10"), F.col("p90")).alias("coverage"),
    )


def with_weather(observations: DataFrame, weather: DataFrame) -> DataFrame:
    """The weather row of the hour an observation falls in, the latest if several landed; nulls where there is none."""
    others = [c for c in weather.columns if c not in (KEY, TS)]
    hourly = (
        weather.groupBy(KEY, F.date_trunc("hour", TS).cast("timestamp_ntz").alias("_hour"))
        .agg(F.max(F.struct(TS, *others)).alias("_latest"))
        .select(KEY, "_hour", *[F.col(f"_latest.{c}").alias(f"weather_{c}") for c in others])
    )
    return (
        observations.withColumn("_hour", F.date_trunc("hour", TS).cast("timestamp_ntz"))
        .join(hourly, [KEY, "_hour"], "left")
        .drop("_hour")
    )


def long_series(
    history: DataFrame, actual: DataFrame, points: DataFrame, series: str | Column, value: str = "p50"
) -> DataFrame:
    """History, actuals and all models' points below each other; rows without a value are dropped.

    ``points`` holds every model's rows, which ``series`` names, so the models are planned and read once.
    """

    def part(df: DataFrame, column: str, series: Column, kind: str) -> DataFrame:
        number = F.col(column).try_cast("double")
        return df.select(KEY, TS, number.alias("value"), series.alias("series"), F.lit(kind).alias("kind"))

    named = F.col(series) if isinstance(series, str) else series
    out = part(history, POWER, F.lit("Observed history"), "history")
    out = out.unionByName(part(actual, POWER, F.lit("Gold data"), "actual")).unionByName(part(points, value, named, "model"))
    return out.dropna(subset=[TS, "value", "series"])


def error_series(outputs: DataFrame, series: str | Column = "model_type") -> DataFrame:
    """Actual minus predicted of all models below each other, in one pass."""
    named = F.col(series) if isinstance(series, str) else series
    return outputs.select(KEY, TS, (F.col("actual_kw") - F.col("predicted_kw")).alias("error_kw"), named.alias("series"))


def pivot_series(
    long: DataFrame, series: Sequence[str], value: str = "value", how: str = "last", order: str | Column = TS
) -> DataFrame:
    """One column per series. Of several values in a cell ``last`` keeps the one that is last by ``order``, ``mean`` averages."""
    if how not in ("last", "mean"):
        raise ValueError("how must be 'last' or 'mean'")
    agg = F.avg(value) if how == "mean" else F.max_by(value, order)
    return long.groupBy(KEY, TS).pivot("series", list(series)).agg(agg)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "series", value: str = "power") -> DataFrame:
    """U3."""
    return df.unpivot(list(ids), list(values), name, value)


def describe(df: DataFrame, columns: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per asset and column, two decimals."""
    long = df.unpivot([KEY], list(columns), "column", "value")
    keys = [KEY, "column"]
    quartiles = group_quantiles(long, keys, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return (
        long.groupBy(*keys)
        .agg(
            F.count("value").alias("count"),
            F.round(F.avg("value"), 2).alias("mean"),
            F.round(F.stddev_samp("value"), 2).alias("std"),
            F.round(F.min("value"), 2).alias("min"),
            F.round(F.max("value"), 2).alias("max"),
        )
        .join(quartiles, keys)
        .withColumns({c: F.round(c, 2) for c in ("p25", "p50", "p75")})
    )


def wind_histogram(df: DataFrame, bins: int = 20, column: str = WIND) -> DataFrame:
    """Rows per equal-width bin of an asset's range, closed on the right; the lowest value is in bin 0.

    Where all values are equal they fill bin 0.
    """
    span = df.groupBy(KEY).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    width = F.col("_high") - F.col("_low")
    place = F.when(width > 0, F.ceil((F.col(column) - F.col("_low")) / width * bins) - 1).otherwise(F.lit(0))
    number = F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0))
    return (
        attach(df.select(KEY, TS, column).where(F.col(column).isNotNull()), span)
        .groupBy(KEY, number.alias("bin"))
        .agg(F.count("*").alias("rows"), F.min(column).alias("lowest"), F.max(column).alias("highest"))
    )


def situation(df: DataFrame, capacity_kw: float = RATED_KW) -> DataFrame:
    """Records, whole days spanned, capacity factor."""
    days = F.floor((F.unix_micros(F.max(TS).cast("timestamp")) - F.unix_micros(F.min(TS).cast("timestamp"))) / 86400e6)
    return df.groupBy(KEY).agg(
        F.count("*").alias("records"),
        days.alias("days"),
        (F.avg(POWER) / F.lit(float(capacity_kw)) * 100).alias("capacity_factor_pct"),
    )


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """O2: the first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def row_slice(indexed: DataFrame, start: int, length: int) -> DataFrame:
    """O3: rows ``start`` to ``start + length`` of each asset's timeline."""
    return indexed.where((F.col(ROW) >= start) & (F.col(ROW) < start + length))


def comparison_table(metrics: DataFrame) -> DataFrame:
    """The artifact-based comparison, rounded as shown."""
    return metrics.select(
        KEY,
        "model_type",
        "horizon_hours",
        F.round("mae", 2).alias("mae_kw"),
        F.round("rmse", 2).alias("rmse_kw"),
        F.round("mape", 2).alias("smape_pct"),
        F.round("skill_score", 3).alias("skill_vs_persistence"),
        F.round(F.col("coverage_p90") * 100, 1).alias("coverage_pct"),
        "test_rows",
    )


def registry_table(registry: DataFrame) -> DataFrame:
    """The registry-based comparison and metadata summary."""
    return registry.select(
        "model_type",
        F.col("model_id").alias("version"),
        "horizon_hours",
        F.size("feature_schema").alias("feature_count"),
        F.round("mae", 1).alias("mae_kw"),
        F.round("rmse", 1).alias("rmse_kw"),
        F.round("skill_score", 3).alias("skill_score"),
        F.round(F.col("coverage_p90") * 100, 1).alias("coverage_pct"),
    )
