"""Queries that train on a fleet of assets of very different length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.catalog.base import TABLES, query
from fleetcast.catalog.forecast_queries import COMPARED_ROWS, kept_fit
from fleetcast.catalog.testview import scada
from fleetcast.operators.metrics import model_metrics
from fleetcast.operators.timeline import ROW, TOTAL, with_row_index
from fleetcast.plans.fleet_training import train_fleet
from fleetcast.schemas import KEY, TS
from fleetcast.session import written

# Beside the four whole assets, short ones: the first rows of the others under a name of their own.
SHORT = {"S12": ("T1", 12), "S20": ("T2", 20), "S60": ("T3", 60), "S200": ("T4", 200)}
TREES = {"max_iter": 20, "max_depth": 4}

_SHORT_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS asset_id, \"timestamp\", active_power_kw, row_index, least(n_rows, {n}) AS n_rows FROM idx WHERE asset_id = '{of}' AND row_index < {n}"
    for name, (of, n) in SHORT.items()
)
# Lag sets by their reach; the rows of a part; active rows if there are enough (train 100, val and test 50).
FLEET = (
    TABLES
    + f""",
fleet AS (SELECT asset_id, "timestamp", active_power_kw, row_index, n_rows FROM idx UNION ALL {_SHORT_SQL}),
hors AS (SELECT * FROM (VALUES (1, 6), (6, 36), (24, 144)) AS v(horizon_hours, h)),
sets AS (SELECT * FROM (VALUES (0, 48), (1, 24), (2, 6), (3, 2)) AS v(feature_set, reach)),
room AS (SELECT asset_id, horizon_hours, h, feature_set, reach, greatest(n_rows - reach - h, 0) AS feature_rows
         FROM (SELECT DISTINCT asset_id, n_rows FROM fleet) CROSS JOIN hors CROSS JOIN sets),
choice AS (SELECT * FROM room WHERE (feature_rows >= 10 OR feature_set = 3) QUALIFY row_number() OVER (PARTITION BY asset_id, horizon_hours ORDER BY feature_set) = 1),
ends AS (SELECT *, least(greatest(train_end + 1, CAST(floor(feature_rows*(7e-1+15e-2)) AS BIGINT)), feature_rows - 1) AS val_end
         FROM (SELECT *, greatest(1, CAST(floor(feature_rows*7e-1) AS BIGINT)) AS train_end FROM choice)),
frame AS (SELECT f.asset_id, f."timestamp", f.active_power_kw AS baseline_kw, g.active_power_kw AS actual_kw, e.horizon_hours, e.feature_set,
                 CASE WHEN f.row_index - e.reach < e.train_end THEN 'train' WHEN f.row_index - e.reach < e.val_end THEN 'val' ELSE 'test' END AS split
          FROM ends e JOIN fleet f ON f.asset_id = e.asset_id AND f.row_index >= e.reach AND f.row_index < e.reach + e.feature_rows
          JOIN fleet g ON g.asset_id = f.asset_id AND g.row_index = f.row_index + e.h
          WHERE e.feature_rows >= 10),
tested AS (SELECT * FROM (SELECT *, count(CASE WHEN baseline_kw > 100 THEN 1 END) OVER (PARTITION BY asset_id, horizon_hours) AS active
                          FROM frame WHERE split = 'test') WHERE active < 50 OR baseline_kw > 100)
"""
)
_ID = "concat('gradient-boosting-', asset_id, '-', CAST(horizon_hours AS VARCHAR), 'h') AS model_id"


def fleet(spark, sf_dir) -> DataFrame:
    rows = with_row_index(scada(spark, sf_dir))
    out = rows
    for name, (of, n) in SHORT.items():
        part = rows.where((F.col(KEY) == of) & (F.col(ROW) < n))
        out = out.unionByName(part.withColumns({KEY: F.lit(name), TOTAL: F.least(F.col(TOTAL), F.lit(n))}))
    return out


def _trained(spark, sf_dir):
    return kept_fit(spark, sf_dir, "fleet", lambda: train_fleet(written(fleet(spark, sf_dir), "fleet"), **TREES))


@query(
    "b4_fleet_status",
    """
    SELECT e.asset_id, 'gradient_boosting' AS model_type, CAST(e.horizon_hours AS INTEGER) AS horizon_hours,
           CAST(e.feature_set AS INTEGER) AS feature_set, e.feature_rows, coalesce(c.train_rows, 0) AS train_rows,
           coalesce(c.val_rows, 0) AS val_rows, coalesce(c.test_rows, 0) AS test_rows,
           CASE WHEN e.feature_rows < 10 THEN concat('too few feature rows: ', CAST(e.feature_rows AS VARCHAR), ' of 10') ELSE 'trained' END AS reason
    FROM ends e LEFT JOIN (SELECT asset_id, horizon_hours, count(CASE WHEN split = 'train' THEN 1 END) AS train_rows,
                                  count(CASE WHEN split = 'val' THEN 1 END) AS val_rows, count(CASE WHEN split = 'test' THEN 1 END) AS test_rows
                           FROM frame GROUP BY asset_id, horizon_hours) c ON c.asset_id = e.asset_id AND c.horizon_hours = e.horizon_hours
    """,
    tables=FLEET,
)
def fleet_status(spark, sf_dir):
    """Each asset and horizon with the rows of its parts or the reason it has no model."""
    known = _trained(spark, sf_dir).status
    return known.select(
        KEY, "model_type", "horizon_hours", "feature_set", *[F.col(f"{c}_rows").cast("long").alias(f"{c}_rows") for c in ("feature", "train", "val", "test")],
        "reason",
    )


@query(
    "b4_fleet_outputs",
    f"""
    SELECT asset_id, "timestamp", actual_kw, baseline_kw, {_ID}, 'gradient_boosting' AS model_type,
           CAST(horizon_hours AS INTEGER) AS horizon_hours, true AS one_band
    FROM tested
    """,
    "actual_kw baseline_kw",
    FLEET,
)
def fleet_outputs(spark, sf_dir):
    """The test rows of all assets that have a model. ``one_band``: bounds lie one width of 50 kW or more from the prediction, per model,
    the lower one not below 0."""
    out = _trained(spark, sf_dir).outputs
    own = Window.partitionBy("model_id")
    width = F.col("p90") - F.col("predicted_kw")
    even = (F.max(width).over(own) - F.min(width).over(own) < 1e-6) & (width > 50 - 1e-6)
    lower = F.abs(F.col("p10") - F.greatest(F.lit(0.0), F.col("predicted_kw") - width)) < 1e-6
    return out.select(KEY, TS, "actual_kw", "baseline_kw", "model_id", "model_type", "horizon_hours", (even & lower).alias("one_band"))


@query(
    "b4_fleet_scores",
    f"""
    SELECT asset_id, {_ID}, CAST(horizon_hours AS INTEGER) AS horizon_hours, count(*) AS test_rows,
           avg(abs(actual_kw - baseline_kw)) AS persistence_mae,
           CASE WHEN count(*) >= {COMPARED_ROWS} THEN true END AS better
    FROM tested WHERE asset_id LIKE 'T%' GROUP BY asset_id, horizon_hours
    """,
    "persistence_mae",
    FLEET,
)
def fleet_scores(spark, sf_dir):
    """``better``: the trees' mean error is below that of persistence on the same rows, where there are enough."""
    out = _trained(spark, sf_dir).outputs.where(F.col(KEY).startswith("T"))
    mae = F.avg(F.abs(F.col("actual_kw") - F.col("baseline_kw"))).alias("persistence_mae")
    base = out.groupBy("model_id").agg(mae)
    return model_metrics(out).join(base, "model_id").select(
        KEY, "model_id", "horizon_hours", "test_rows", "persistence_mae", F.when(F.col("test_rows") >= COMPARED_ROWS, F.col("mae") < F.col("persistence_mae")).alias("better"),
    )
