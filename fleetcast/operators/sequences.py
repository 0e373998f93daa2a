"""Sliding windows of rows as arrays, and target scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.operators.splits import sample_split
from fleetcast.operators.timeline import CHUNK_ROWS, ROW, TOTAL, along_timeline, attach, last_rows
from fleetcast.schemas import DIRECTION, KEY, POWER, THEORETICAL, TS, WIND

SEQ_LEN = 144
PRED_LEN = 6
SEQUENCE_FEATURES = (POWER, WIND, THEORETICAL, DIRECTION)


def sequence_samples(
    indexed: DataFrame,
    features: Sequence[str] = SEQUENCE_FEATURES,
    target: str = POWER,
    seq_len: int = SEQ_LEN,
    pred_len: int = PRED_LEN,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per start row ``seq_len`` rows of features and the next ``pred_len`` targets.

    Stamped with the first predicted step. Only the named columns are carried into the windows.
    """
    rows = indexed.select(
        KEY, ROW, TOTAL, TS, F.array(*features).alias("_x"), F.array(target).alias("_y"), F.col(target).alias("_last")
    )
    built = along_timeline(
        rows,
        {
            "input_sequence": lambda w: F.collect_list("_x").over(w.rowsBetween(1 - seq_len, 0)),
            "target": lambda w: F.flatten(F.collect_list("_y").over(w.rowsBetween(1, pred_len))),
            "stamp": lambda w: F.lead(TS).over(w),
        },
        back=seq_len - 1,
        ahead=pred_len,
        chunk_rows=chunk_rows,
    )
    whole = (F.col(ROW) >= seq_len - 1) & (F.col(ROW) < F.col(TOTAL) - pred_len)
    return built.where(whole).select(
        KEY,
        (F.col(ROW) - (seq_len - 1)).alias("sample_index"),
        F.col(TOTAL).alias("n_rows"),
        F.col("stamp").alias(TS),
        "input_sequence",
        "target",
        F.col("_last").alias("last_target"),
    )


def split_samples(samples: DataFrame, seq_len: int = SEQ_LEN, pred_len: int = PRED_LEN) -> DataFrame:
    """T5."""
    return sample_split(samples, "sample_index", F.col("n_rows") - (seq_len + pred_len) + 1)


def target_stats(df: DataFrame, target: str = POWER) -> DataFrame:
    """Mean and population deviation (1 where it is 0)."""
    deviation = F.col("target_std")
    return (
        df.groupBy(KEY)
        .agg(F.avg(target).alias("target_mean"), F.stddev_pop(target).alias("target_std"))
        .withColumn("target_std", F.when(deviation == 0, F.lit(1.0)).otherwise(deviation))
    )


def normalise_target(df: DataFrame, stats: DataFrame, target: str = POWER, out: str = "normalised") -> DataFrame:
    """P15."""
    scaled = (F.col(target) - F.col("target_mean")) / F.col("target_std")
    return attach(df, stats).withColumn(out, scaled).drop("target_mean", "target_std")


def denormalise_target(df: DataFrame, stats: DataFrame, scaled: str = "normalised", out: str = POWER) -> DataFrame:
    value = F.col(scaled) * F.col("target_std") + F.col("target_mean")
    return attach(df, stats).withColumn(out, value).drop("target_mean", "target_std")


def latest_sequence(df: DataFrame, features: Sequence[str] = SEQUENCE_FEATURES, seq_len: int = SEQ_LEN) -> DataFrame:
    """The last ``seq_len`` rows per asset as one sequence; assets with fewer rows have none."""
    entry = F.struct(F.col(TS), F.array(*features).alias("x"))
    grouped = last_rows(df.select(KEY, TS, *features), seq_len).groupBy(KEY)
    return (
        grouped.agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
        .where(F.size("_rows") == seq_len)
        .select(
            KEY,
            F.element_at("_rows", -1)[TS].alias("last_ts"),
            F.element_at("_rows", -2)[TS].alias("before_last_ts"),
            F.transform("_rows", lambda r: r["x"]).alias("input_sequence"),
        )
    )
