"""Landed hourly weather files (S10), read at once or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.schemas import KEY, TS, WEATHER_SCHEMA
from fleetcast.sources.folders import NO_VALUE, mounted, write_lines

# The arrays of an hourly weather response and their internal names.
HOURLY_TO_INTERNAL = {
    "wind_speed_10m": "wind_speed_10m_mps",
    "wind_speed_100m": "wind_speed_100m_mps",
    "wind_direction_10m": "wind_direction_deg",
    "temperature_2m": "temperature_c",
    "pressure_msl": "pressure_hpa",
}

_HOURLY = ", ".join(f"{name}: array<string>" for name in ("time", *HOURLY_TO_INTERNAL))
RESPONSE_DDL = f"hourly struct<{_HOURLY}>"


CORRUPT = "corrupt_response"


def read_responses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """asset_id, hourly, corrupt_response: landed responses, the asset in the folder name (``asset_id=T1/``).

    One response per line, or with ``multi_line`` one per file, however it is laid out. What is no JSON is kept as
    ``corrupt_response``, not lost.
    """
    schema = f"{RESPONSE_DDL}, {CORRUPT} string, {KEY} string"
    return spark.read.schema(schema).option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_weather_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Weather rows of all responses that can be read; ``unreadable_responses`` counts the rest."""
    return _rows(read_responses(spark, path, multi_line).select(KEY, F.col("hourly").alias("h")))


def unreadable_responses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Per asset the responses that are no JSON or have no ``hourly`` object."""
    found = read_responses(spark, path, multi_line)
    return found.groupBy(KEY).agg(F.count("*").alias("responses"), F.count_if(F.col("hourly").isNull()).alias("unreadable"))


FILE = "response_file"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def land_responses(responses: DataFrame, path: str, *folders: str) -> None:
    """Writes each response (column ``value``) as a file of its own, in nested folders named by its values of ``folders``.

    The folders are dealt to tasks by hash, a few tasks a core: opening a file takes far longer than writing a response to it. Responses
    of the same folders share a file. On a ``file:`` path the tasks write the files themselves: without its native library Hadoop starts
    several processes for each file there.
    """
    tasks = 4 * responses.sparkSession.sparkContext.defaultParallelism
    dealt = responses.repartition(tasks, *folders)
    top = mounted(responses.sparkSession, path)
    if top is None:
        dealt.write.mode("append").partitionBy(*folders).text(path)
    else:
        write_lines(dealt, top, folders)


def stream_responses(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """asset_id, hourly, corrupt_response, response_file of landed responses, a file each, however it is laid out.

    The file source remembers in its checkpoint which files it has taken, so each is taken once. Folders hold a file each, so they are
    listed by a task a core, not by one task a folder: sets the session's number of listing tasks. The asset is read from the file's
    path: Spark's own discovery of folders takes time that grows with the square of their number. Responses are small, so a batch is
    read by a task a core, and what is made of it has no more files than that.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set(LISTING_TASKS, min(int(spark.conf.get(LISTING_TASKS)), cores))
    schema = f"{RESPONSE_DDL}, {CORRUPT} string, {KEY} string"
    reader = spark.readStream.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).json(path)
    return rows.withColumn(FILE, F.col("_metadata.file_path")).withColumn(KEY, _in_folder(KEY)).coalesce(cores)


def _in_folder(name: str) -> Column:
    """The value in a file's path of the folder ``<name>=<value>``, as Spark writes it; without such a folder the column itself."""

    def decoded(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)

    folder = rf"/{name}=([^/]*)/(?!.*/{name}=)"
    value = decoded(decoded(F.regexp_extract(FILE, folder, 1)))  # the path is a URL of escaped names
    found = F.nullif(F.nullif(value, F.lit(NO_VALUE)), F.lit(""))
    return F.when(F.col(FILE).rlike(folder), found).otherwise(F.col(name))


def weather_rows(responses: DataFrame) -> DataFrame:
    """The weather rows of read responses, with the file each came from."""
    return _rows(responses.selectExpr(KEY, FILE, "hourly AS h"), FILE)


def file_accounts(responses: DataFrame) -> DataFrame:
    """Per file: its asset, whether it could be read, and the hours it reports."""
    hours = "CASE WHEN hourly IS NOT NULL THEN coalesce(size(hourly.time), 0) ELSE 0 END"
    return responses.selectExpr(KEY, FILE, "hourly IS NOT NULL AS readable", f"CAST({hours} AS BIGINT) AS hours")


def flatten_hourly(responses: DataFrame, column: str = "response") -> DataFrame:
    """One row per time stamp of the parallel arrays.

    A short or missing array, and a value that is no number, give null; a bad time gives no row.
    """
    return _rows(responses.select(KEY, F.from_json(column, RESPONSE_DDL)["hourly"].alias("h")))


def _rows(parsed: DataFrame, *more: str) -> DataFrame:
    """As SQL text: a stream asks for these rows once a batch, and each function call would be several to the JVM."""
    names = ("time", *HOURLY_TO_INTERNAL)
    arrays = [f"coalesce(h.{name}, CAST(array() AS array<string>)) AS {name}" for name in names]
    rows = parsed.selectExpr(KEY, *more, *arrays).selectExpr(KEY, *more, f"inline(arrays_zip({', '.join(names)}))")
    values = [f"try_cast({raw} AS double) AS {name}" for raw, name in HOURLY_TO_INTERNAL.items()]
    shown = rows.selectExpr(KEY, *more, f"CAST(try_to_timestamp(time) AS timestamp_ntz) AS {TS}", *values)
    return shown.where(f"{TS} IS NOT NULL").select(*WEATHER_SCHEMA.names, *more)
