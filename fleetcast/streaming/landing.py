"""Sinks that count each micro-batch once: versions of a keyed table, and appended tables with a folder per batch.

Both write a batch's folder over again when the batch is replayed after a failure, and read only folders that were finished.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

_DONE = "_SUCCESS"

Sink = Callable[[DataFrame, int], None]


def _finished(spark: SparkSession, path: str, label: str) -> dict[int, str]:
    """Numbers and paths of the finished folders ``<label>=<number>`` under a path."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return {}
    found = {}
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        number = name.removeprefix(f"{label}=")
        if number != name and number.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), _DONE)):
            found[int(number)] = status.getPath().toString()
    return found


def _remove(spark: SparkSession, path: str) -> None:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def upserting(path: str, keys: Sequence[str], keep: int = 2) -> Sink:
    """X4's sink: each batch of changed rows (update mode) makes a new version of the table of the last row per key.

    The base is the newest version before the batch, so a replayed batch gives the same version again. Versions
    older than the last ``keep`` are removed; a reader has that long to finish.
    """

    def write(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        versions = {v: p for v, p in _finished(spark, path, "version").items() if v < batch}
        table = changed
        if versions:
            before = spark.read.schema(changed.schema).parquet(versions[max(versions)])
            table = changed.unionByName(before.join(changed.select(*keys), list(keys), "left_anti"))
        table.write.mode("overwrite").parquet(f"{path}/version={batch}")
        for old in sorted(versions)[: max(len(versions) + 1 - keep, 0)]:
            _remove(spark, versions[old])

    return write


def newest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The last finished version; empty before the first."""
    versions = _finished(spark, path, "version")
    return spark.read.schema(schema).parquet(versions[max(versions)]) if versions else spark.createDataFrame([], schema)


def appending(paths: Mapping[str, Callable[[DataFrame], DataFrame]]) -> Sink:
    """Several tables of one stream: each path gets what its function makes of the batch, in a folder of the batch's number.

    The tables of a batch are written at the same time: of a small batch most of the time is Spark's preparation and commit of a write.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()  # read once, however many tables are made of it; lost parts are read again
        try:
            _at_once([partial(_overwritten, rows, made, f"{path}/batch={batch}") for path, made in paths.items()])
        finally:
            rows.unpersist()

    return write


def _overwritten(rows: DataFrame, made: Callable[[DataFrame], DataFrame], path: str) -> None:
    made(rows).write.mode("overwrite").parquet(path)


def _at_once(calls: Sequence[Callable[[], None]]) -> None:
    """Runs the calls in threads that inherit this one's Spark properties. When all have ended, raises the first error there was."""
    failed: list[Exception] = []

    def run(call: Callable[[], None]) -> None:
        try:
            call()
        except Exception as problem:
            failed.append(problem)

    others = [InheritableThread(target=run, args=(call,)) for call in calls[1:]]
    for thread in others:
        thread.start()
    for call in calls[:1]:
        run(call)
    for thread in others:
        thread.join()
    if failed:
        raise failed[0]


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all finished batches."""
    found = list(_finished(spark, path, "batch").values())
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
