"""Backtest outputs, metrics and split summaries on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.schemas import KEY, TEST_OUTPUT_COLUMNS, TEST_OUTPUT_SCHEMA, TS

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def save_test_outputs(outputs: DataFrame, path: str) -> None:
    """CSV with ISO ``...Z`` stamps, a folder per model; files are sorted by time within a task."""
    stamped = outputs.select(KEY, F.date_format(TS, ISO_Z).alias(TS), *TEST_OUTPUT_COLUMNS[1:])
    stamped.sortWithinPartitions("model_id", TS).write.mode("overwrite").partitionBy("model_id").option(
        "header", True
    ).csv(path)


def load_test_outputs(spark: SparkSession, path: str, model_id: str | None = None) -> DataFrame:
    """Back into the output schema; one model reads only its folder."""
    kinds = {TS: T.StringType()}
    fields = [T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in TEST_OUTPUT_SCHEMA.fields]
    rows = spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
    if model_id is not None:
        rows = rows.where(F.col("model_id") == model_id)
    stamp = F.to_timestamp(TS, ISO_Z).cast("timestamp_ntz")
    return rows.withColumn(TS, stamp).select(KEY, *TEST_OUTPUT_COLUMNS)


def save_json(table: DataFrame, path: str) -> None:
    """Metrics, split summaries or the comparison, one JSON record per row."""
    table.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S8."""
    return spark.read.schema(schema).json(path)


def comparison_record(metrics: DataFrame, splits: DataFrame) -> DataFrame:
    """Per asset one nested record: its split summary and the results of all models."""
    result = F.struct(*[c for c in metrics.columns if c != KEY])
    results = metrics.groupBy(KEY).agg(F.sort_array(F.collect_set(result)).alias("results"))
    split = F.struct(*[c for c in splits.columns if c != KEY]).alias("split")
    return splits.select(KEY, split).join(results, KEY)
