"""Packing by concatenate and cut: the documents' tokens form one stream, which is cut into windows of a fixed length.

Two passes: the first tokenises, writes the tokens with their position inside their partition and so gives each partition's total;
prefix sums of the totals give every partition's place in the stream, and the second pass cuts at multiples of the length.
Tokens aren't shuffled. Only the windows that two partitions share, the boundary records, meet in an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, documents, give_back, id_and_text, pieces, text_bytes
from fleetcast.llm.tokens import of_worker, shared
from fleetcast.session import written

LENGTH, END_ID, PAD_ID = 2048, 1, 0
TOKENIZER = "word_bpe_49k.json"
#: Bytes of tokens put into one record batch.
BATCH = 2 << 20


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = ID, text_col: str = TEXT, end_id: int = END_ID) -> DataFrame:
    """A written table: doc_id, part, at (tokens of the partition before this document), ids (32-bit, little-endian, binary).

    Every document ends with `end_id`; a null text has that id alone. Rows keep the order of their partition.
    """
    frame = id_and_text(docs, id_col, text_col)
    definition = shared(docs.sparkSession.sparkContext, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, known = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            known = known or of_worker(definition)
            as_binary = batch.set_column(1, TEXT, batch.column(TEXT).cast(pa.binary()))
            for rows in pieces(as_binary, TEXT):
                flat, lengths = known.of_texts(rows.column(TEXT))
                flat = np.insert(flat, np.cumsum(lengths), end_id).astype("<u4")
                lengths = lengths + 1
                ends = np.concatenate([[0], np.cumsum(lengths)])
                ids = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(ID), pa.array(np.full(rows.num_rows, part, np.int32)), pa.array(at + ends[:-1]), ids],
                    names=[ID, "part", "at", "ids"],
                )
                at += int(ends[-1])
        give_back()

    return written(frame.mapInArrow(run, f"{ID} long, part int, at long, ids binary"), "pack-tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """tokens with `place`, the document's position in the whole stream."""
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.octet_length("ids") / 4).cast("long").alias("total"))
    # a row per partition of the first pass
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "pack-bases")
    return tokens.join(bases, "part").select(ID, (F.col("base") + F.col("at")).alias("place"), "ids")


def cut(stream: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset (place in that sequence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces(batch, "ids", BATCH):
                data, bounds = text_bytes(rows.column("ids"))
                place, n = rows.column("place").to_numpy(), np.diff(bounds) // 4
                first = place // length
                # windows that each document has a part of
                count = np.where(n > 0, (place + n - 1) // length - first + 1, 0)
                own = np.repeat(np.arange(len(n)), count)
                sequence = first[own] + np.arange(len(own)) - (np.cumsum(count) - count)[own]
                start = np.maximum(sequence * length - place[own], 0)
                take = np.minimum((sequence + 1) * length - place[own], n[own]) - start
                # the documents' ids lie one after another, and so do their pieces'
                ends = np.concatenate([[0], 4 * np.cumsum(take)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                doc = rows.column(ID).take(pa.array(own))
                offset = place[own] + start - sequence * length
                columns = [doc, start, take, ids, n[own], sequence, offset]
                made = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
                yield from pieces(made, "ids", BATCH)
        give_back()

    names = [ID, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = f"{ID} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return stream.mapInArrow(run, kind)


def sequences(parts: DataFrame, length: int = LENGTH, pad_id: int = PAD_ID) -> DataFrame:
    """sequence_id, ids (binary of `length` ids, the last sequence padded with `pad_id`), tokens (without padding).

    Pieces that follow one another in a task are joined there; only windows begun or ended elsewhere are exchanged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, begin, held, done, size = -1, 0, [], [], 0

        def closed() -> list[tuple[int, int, bytes]]:
            return [(sequence, begin, b"".join(held))] if held else []

        def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["sequence_id", "offset", "ids"])

        filled = 0
        for batch in batches:
            for s, o, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "ids")), strict=True):
                if s != sequence or o != begin + filled:
                    done += closed()
                    sequence, begin, held, filled = s, o, [], 0
                held.append(ids)
                filled += len(ids) // 4
                size += len(ids)
                if size >= BATCH and done:
                    yield batch_of(done)
                    done, size = [], 0
        if rows := done + closed():
            yield batch_of(rows)

    runs = parts.select("sequence_id", "offset", "ids").mapInArrow(run, "sequence_id long, offset long, ids binary")
    whole = F.octet_length("ids") == 4 * length
    boundary = (
        runs.filter(~whole)
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
    )
    joined = runs.filter(whole).select("sequence_id", "ids").unionByName(boundary)
    pad = F.lit(int(pad_id).to_bytes(4, "little") * length)
    tokens = (F.octet_length("ids") / 4).cast("long")
    return joined.select("sequence_id", F.substring(F.concat("ids", pad), 1, 4 * length).alias("ids"), tokens.alias("tokens"))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = ID, text_col: str = TEXT, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents in the stream: no token is lost, only the last sequence has padding.

    Repeated rows are packed each; null ids stay null; an empty table has no pieces. Other columns are not read.
    """
    return cut(placed(tokenised(docs, tokenizer_path, id_col, text_col, end_id)), length)


def digested(parts: DataFrame) -> DataFrame:
    return parts.select(ID, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op2(spark, sf_dir: str) -> DataFrame:
    return digested(pack(documents(spark, sf_dir), default_tokenizer()))
