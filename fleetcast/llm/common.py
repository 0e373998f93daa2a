"""What the operators share: named inputs, learnable rows, blocks of text bytes, small tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID, TEXT = "doc_id", "text"
#: Python's bytes.split() and the pattern of the words agree: space and 0x09 to 0x0D part words, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """`base`, lengthened until no column of df has that name in either case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def set_aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame], *read: str) -> DataFrame:
    """What `work` makes of docs, with docs' columns; those whose names begin with "__" get others meanwhile (but for the ones `read`),
    as `work` uses such names."""
    own = {}
    for c in docs.columns:
        if c.startswith("__") and c not in read:
            own[c] = free_name(docs, f"aside_{len(own)}")
    if not own:
        return work(docs)
    back = {v: k for k, v in own.items()}
    done = work(docs.select(*[column(c).alias(own.get(c, c)) for c in docs.columns]))
    return done.select(*[column(c).alias(back.get(c, c)) for c in done.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, *more: str) -> DataFrame:
    """Only the named columns, under fixed names: other columns of any name can't clash with an operator's own."""
    return docs.select(
        column(id_col).cast("long").alias(ID), column(text_col).cast("string").alias(TEXT), *[column(c) for c in more]
    )


def held_out(id_: Column) -> Column:
    """Rows no model may learn from: crc32 of the id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def ascii_lower_head(text: Column, n: int) -> Column:
    """The first n code points with A-Z lower-cased, other letters untouched."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.substring(text, 1, n), upper, upper.lower())


def with_columns_from_text(
    df: DataFrame, text_col: str, added: dict[str, str], work: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """All columns of df but those of `drop`, and the `added` ones (name to type) that `work` makes of a batch's texts.

    `work` is called once a task and returns the function for its batches; that gets the texts as binary.
    """
    as_bytes = free_name(df, "text_bytes")
    frame = df.withColumn(as_bytes, column(text_col).cast("binary")).drop(*drop)
    kept = [c for c in frame.columns if c != as_bytes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work()
        for batch in batches:
            for part in pieces(batch, as_bytes):
                columns = [part.column(c) for c in kept] + made(part.column(as_bytes))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])
        give_back()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != as_bytes] + [f"`{k}` {v}" for k, v in added.items()])
    return frame.mapInArrow(run, schema)


def give_back() -> None:
    """Return what a task has freed to the system: Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `limit` bytes of text, or of one row: long texts don't add up in memory."""
    _, offsets = text_bytes(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array's texts, one after another, and the n + 1 offsets of the texts; nulls have no bytes."""
    wide = pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def as_list(values: pa.Array) -> list[bytes]:
    """Texts as bytes, null as empty."""
    return [b"" if v is None else v for v in values.to_pylist()]
