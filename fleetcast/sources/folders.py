"""Many small text files in nested folders of a mounted file system, written by the tasks themselves."""

from __future__ import annotations

import os
import re
import shutil
import sys
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

# Fixed by Spark: the folder of a missing value, and the characters that are escaped in a folder's name.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path in the file system that the driver and the tasks have mounted, if it lies there (``file:``)."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _escaped(text: str) -> str:
    return _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", text)


def _folder(names: Sequence[str], values: Sequence[str | None]) -> str:
    return "/".join(f"{_escaped(n)}={NO_VALUE if v is None else _escaped(v)}" for n, v in zip(names, values, strict=True))


def write_lines(rows: DataFrame, top: str, folders: Sequence[str], column: str = "value") -> None:
    """Appends what ``rows.write.partitionBy(*folders).text(top)`` would write, with a file per task and folder.

    Each attempt of a task writes into a folder of its own that readers pass over. When all tasks have ended, the driver moves the files of
    those that did to their places: a run that fails before leaves none.
    """
    run = uuid.uuid4().hex
    aside = f"{top}/_landing-{run}"
    names = list(folders)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, own = f"part-{task.partitionId():05d}-{run}.txt", str(task.taskAttemptId())
        at, out = None, None
        try:
            for batch in batches:
                *keys, lines = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
                for *values, line in zip(*keys, lines, strict=True):
                    if values != at:
                        if out is not None:
                            out.close()
                        folder = f"{aside}/{own}/{_folder(names, values)}"
                        os.makedirs(folder, exist_ok=True)
                        at, out = values, open(f"{folder}/{name}", "wb")
                    out.write((line or b"") + b"\n")
        finally:
            if out is not None:
                out.close()
        if at is not None:
            yield pa.RecordBatch.from_pydict({"attempt": [own]})

    keys = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate(names)]
    sorted_rows = rows.select(*keys, F.col(column).cast("binary")).sortWithinPartitions(*[f"_{i}" for i in range(len(names))])
    try:
        for ended in sorted_rows.mapInArrow(write, "attempt string").collect():
            _moved(Path(aside, ended["attempt"]), Path(top), len(names))
        Path(top).mkdir(parents=True, exist_ok=True)
        Path(top, "_SUCCESS").touch()
    finally:
        shutil.rmtree(aside, ignore_errors=True)


def _moved(source: Path, target: Path, depth: int) -> None:
    """Moves files ``depth`` folders below the source to the same folders of the target, whole folders where the target has none."""
    if not target.exists():
        try:
            source.rename(target)
            return
        except OSError:  # another writer has made the folder and put a file into it
            pass
    with os.scandir(source) as entries:
        for entry in entries:
            if depth:
                _moved(Path(entry.path), target / entry.name, depth - 1)
            else:
                os.replace(entry.path, target / entry.name)
