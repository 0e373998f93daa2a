"""Fitted models on disk with a metadata table beside them."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

REGISTRY_DDL = (
    "model_id string, model_type string, feature_schema map<string,string>, target string, horizon_hours int, "
    "training_timestamp timestamp_ntz, mae double, rmse double, mape double, skill_score double, "
    "coverage_p90 double, config map<string,string>"
)


def _folders(root: str) -> tuple[str, str]:
    return f"{root.rstrip('/')}/models", f"{root.rstrip('/')}/registry"


def save_model(
    spark: SparkSession,
    root: str,
    model_id: str,
    model: PipelineModel | DataFrame,
    model_type: str,
    horizon_hours: int,
    feature_schema: dict[str, str],
    metrics: dict[str, float] | None = None,
    config: dict[str, str] | None = None,
    target: str = "active_power_kw",
    trained_at: datetime | None = None,
) -> str:
    """The model, a pipeline or a table of weights, under its id, and one row appended to the registry, stamped with UTC wall time."""
    models, registry = _folders(root)
    path = f"{models}/{model_id}"
    if isinstance(model, DataFrame):
        model.write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)
    scores = metrics or {}
    row = (
        model_id,
        model_type,
        feature_schema,
        target,
        horizon_hours,
        trained_at or datetime.now(UTC).replace(tzinfo=None),
        *[scores.get(m) for m in ("mae", "rmse", "mape", "skill_score", "coverage_p90")],
        config or {},
    )
    spark.createDataFrame([row], REGISTRY_DDL).coalesce(1).write.mode("append").parquet(registry)
    return path


def registry(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of each model id: saving a model again replaces its metadata."""
    return newest_per_id(spark.read.schema(REGISTRY_DDL).parquet(_folders(root)[1]))


def newest_per_id(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "model_id"]
    newest = F.max_by(F.struct(*others), "training_timestamp").alias("m")
    return rows.groupBy("model_id").agg(newest).select("model_id", "m.*")


def list_models(rows: DataFrame) -> DataFrame:
    """S9b."""
    return rows.select("model_id").distinct()


def latest_models(rows: DataFrame) -> DataFrame:
    """Per model type the model trained last."""
    return rows.groupBy("model_type").agg(
        F.max_by("model_id", "training_timestamp").alias("model_id"),
        F.max("training_timestamp").alias("training_timestamp"),
    )


def latest_model(rows: DataFrame, model_type: str | None = None) -> Row | None:
    """The metadata of the newest model, optionally of one type. One row of metadata reaches the driver."""
    chosen = rows if model_type is None else rows.where(F.col("model_type") == model_type)
    return chosen.orderBy(F.col("training_timestamp").desc(), "model_id").first()


def metadata(spark: SparkSession, root: str, model_id: str) -> Row:
    """The newest row of one model."""
    found = registry(spark, root).where(F.col("model_id") == model_id).first()
    if found is None:
        raise FileNotFoundError(f"Model {model_id} not found")
    return found


def load_model(spark: SparkSession, root: str, model_id: str) -> tuple[PipelineModel, Row]:
    """S9a."""
    known = metadata(spark, root, model_id)
    return PipelineModel.load(f"{_folders(root)[0]}/{model_id}"), known
