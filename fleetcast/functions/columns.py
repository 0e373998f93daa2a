"""Projection and aggregate expressions over SCADA columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetcast.schemas import DIRECTION, POWER, THEORETICAL, TS, WIND

# Fixed value: air density in kg/m3.
AIR_DENSITY = 1.225


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def wrapped_direction(c: Column) -> Column:
    """Degrees brought into [0, 360)."""
    return F.pmod(c, F.lit(360.0))


def parsed_timestamp(c: Column) -> Column:
    """S3: ``DD MM YYYY HH:MM`` or ISO text, per row; anything else is null. Needs a UTC session."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("dd MM yyyy HH:mm")), F.try_to_timestamp(c)).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(60e6)


def plus_minutes(ts: Column, minutes: Column) -> Column:
    """``ts`` moved by a (fractional) number of minutes, to the microsecond."""
    moved = micros(ts) + F.rint(minutes * F.lit(60e6)).cast("long")
    return F.timestamp_micros(moved).cast("timestamp_ntz")


def direction_columns() -> dict[str, Column]:
    """P3."""
    angle = F.radians(F.col(DIRECTION))
    return {"wind_direction_sin": F.sin(angle), "wind_direction_cos": F.cos(angle)}


def calendar_columns() -> dict[str, Column]:
    """P4."""
    hour = F.hour(TS) + F.minute(TS) / F.lit(60.0)
    by_hour = F.lit(2 * math.pi) * hour / F.lit(24.0)
    by_day = F.lit(2 * math.pi) * F.dayofyear(TS).cast("double") / F.lit(366.0)
    return {
        "hour_sin": F.sin(by_hour),
        "hour_cos": F.cos(by_hour),
        "day_sin": F.sin(by_day),
        "day_cos": F.cos(by_day),
    }


def _ratio_where(top: Column, bottom: Column, condition: Column, otherwise: float) -> Column:
    return F.when(condition, top / bottom).otherwise(F.lit(otherwise))


def physics_columns(mean_3: Column, std_3: Column) -> dict[str, Column]:
    """P5 and P6; the 3-row mean and deviation are those of active power."""
    power, wind, theoretical = F.col(POWER), F.col(WIND), F.col(THEORETICAL)
    squared, cubed = wind * wind, wind * wind * wind
    return {
        "wind_speed_sq": squared,
        "wind_speed_cb": cubed,
        "power_curve_deviation": power - theoretical,
        "power_efficiency": _ratio_where(power, theoretical, theoretical > 50, 1.0),
        "turbulence_intensity": _ratio_where(std_3, mean_3, mean_3 > 50, 0.0),
        "wind_power_density": F.lit(0.5 * AIR_DENSITY) * cubed,
        "capacity_factor": _ratio_where(power, theoretical, theoretical > 100, 0.0),
        "wind_shear_indicator": _ratio_where(power, squared + 1, wind > 3, 0.0),
    }


def clipped_power(c: Column, rated_kw: float | None = None) -> Column:
    """Within [0, rated], three decimals."""
    low = F.greatest(c, F.lit(0.0))
    return F.round(low if rated_kw is None else F.least(low, F.lit(float(rated_kw))), 3)


def floored_power(c: Column) -> Column:
    return F.round(F.greatest(c, F.lit(0.0)), 3)


def sample_weight(power: Column) -> Column:
    """P9."""
    return F.when(power > 500, F.lit(2.0)).otherwise(F.lit(1.0))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def smape(actual: Column, predicted: Column) -> Column:
    size = F.abs(actual) + F.abs(predicted)
    return F.coalesce(F.avg(F.when(size > 0, F.lit(2.0) * F.abs(predicted - actual) / size)) * 100, F.lit(0.0))


def skill(model_mae: Column, baseline_mae: Column) -> Column:
    return F.when(baseline_mae > 0, F.lit(1.0) - model_mae / baseline_mae)


def inside(actual: Column, lower: Column, upper: Column) -> Column:
    return ((actual >= lower) & (actual <= upper)).cast("double")


def coverage(actual: Column, lower: Column, upper: Column) -> Column:
    return F.avg(inside(actual, lower, upper))
