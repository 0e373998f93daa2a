"""Registration of queries, and the SQL common to their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.catalog.testview import SQL_DIRTY, SQL_SCADA

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# The tables of testview.py in SQL, numbered (idx) and split by row (sp).
TABLES = f"""
WITH scada AS ({SQL_SCADA}),
dirty AS ({SQL_DIRTY}),
idx AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp") - 1 AS row_index,
               count(*) OVER (PARTITION BY asset_id) AS n_rows FROM scada),
bnd AS (SELECT *, least(greatest(train_end + 1, CAST(floor(n_rows*(7e-1+15e-2)) AS BIGINT)), n_rows - 1) AS val_end
        FROM (SELECT *, greatest(1, CAST(floor(n_rows*7e-1) AS BIGINT)) AS train_end FROM idx)),
sp AS (SELECT *, CASE WHEN row_index < train_end THEN 'train' WHEN row_index < val_end THEN 'val' ELSE 'test' END
              AS split FROM bnd)
"""

# Baseline predictions of the val and test rows (1, 6 and 24 h), and their outputs with intervals.
BACKTEST = (
    TABLES
    + """,
hor AS (SELECT * FROM (VALUES (1, 6), (6, 36), (24, 144)) AS v(horizon_hours, h)),
anc AS (
  SELECT s.asset_id, s."timestamp", s.row_index, s.split, s.active_power_kw AS actual_kw, s.theoretical_power_kwh,
         hor.horizon_hours, hor.h, b.active_power_kw AS baseline_kw, r.roll AS rolled
  FROM sp s CROSS JOIN hor
  JOIN sp b ON b.asset_id = s.asset_id AND b.row_index = s.row_index - hor.h
  JOIN (SELECT asset_id, row_index,
               CASE WHEN count(*) OVER w = 6 THEN avg(active_power_kw) OVER w END AS roll
        FROM sp WINDOW w AS (PARTITION BY asset_id ORDER BY row_index ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) r
    ON r.asset_id = s.asset_id AND r.row_index = s.row_index - hor.h
  WHERE s.split <> 'train'),
pred AS (
  SELECT asset_id, "timestamp", split, actual_kw, horizon_hours, baseline_kw, model_type, predicted_kw,
         concat(replace(model_type, '_', '-'), '-', asset_id, '-', CAST(horizon_hours AS VARCHAR), 'h') AS model_id
  FROM (SELECT *, 'persistence' AS model_type, baseline_kw AS predicted_kw FROM anc
        UNION ALL SELECT *, 'power_curve', theoretical_power_kwh FROM anc
        UNION ALL SELECT *, 'rolling_mean', rolled FROM anc WHERE rolled IS NOT NULL)),
band AS (SELECT model_id, greatest(5e1, quantile_cont(abs(actual_kw - predicted_kw), 9e-1)) AS residual_p90
         FROM pred WHERE split = 'val' GROUP BY model_id),
outp AS (SELECT p.asset_id, p."timestamp", p.actual_kw, p.predicted_kw,
                greatest(0e0, p.predicted_kw - b.residual_p90) AS p10, p.predicted_kw + b.residual_p90 AS p90,
                p.baseline_kw, p.actual_kw - p.predicted_kw AS residual_kw, p.model_id, p.model_type,
                CAST(p.horizon_hours AS INTEGER) AS horizon_hours
         FROM pred p JOIN band b USING (model_id) WHERE p.split = 'test')
"""
)


COARSE, FINE = 3, 8


def _digits(name: str, digits: int) -> int:
    """Fewer for deviations, whose last digits depend on the order of summation; more for means of wind
    speeds, which are short decimals and often end in an exact half."""
    if "wind_speed_roll_mean" in name:
        return FINE
    return COARSE if "_std" in name or name == "turbulence_intensity" else digits


def rounded_sql(sql: str, doubles: str, digits: int = 6) -> str:
    """The named columns rounded, without negative zeros."""
    if not doubles.split():
        return sql
    parts = []
    for c in doubles.split():
        d = _digits(c, digits)
        parts.append(f"CASE WHEN abs({c}) < 5e-{d + 1} THEN 0e0 ELSE round({c}, {d}) END AS {c}")
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql}) AS shown"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that the two engines' last bits do not matter."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, _digits(c, digits)) for c in doubles}) if doubles else df


def query(
    name: str, sql: str | None = None, doubles: str = "", tables: str = TABLES, digits: int = 6
) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the SELECT its result must equal, on top of ``tables``."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            CHECKS[name] = tables + rounded_sql(sql, doubles, digits)
        return f

    return register
