"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Texts are equal when they are identical after lower-casing A-Z only; a null text counts as empty.
Groups of one are settled by their length and prefix alone; only the texts of groups that survive both are
read whole and hashed. The groups of the first two rounds come from one aggregate, as (length, prefix) refines length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, as_list, ascii_lower_head, column, documents, id_and_text, with_columns_from_text, set_aside
from fleetcast.session import written

#: Code points of the prefix that is hashed in the second round.
PREFIX = 128


def _sha256() -> Callable[[pa.Array], list[pa.Array]]:
    def made(texts: pa.Array) -> list[pa.Array]:
        # bytes.lower() lower-cases A-Z and nothing else
        return [pa.array([hashlib.sha256(t.lower()).digest() for t in as_list(texts)], pa.binary())]

    return made


def refined(
    docs: DataFrame, text_col: str = TEXT, hash_settled: bool = False, keep_text: bool = True, prefix: int = PREFIX
) -> DataFrame:
    """docs with __settled (no other text has this length and prefix) and __hash, the SHA-256 of the normalised text.

    __hash is null for settled rows unless `hash_settled`; the text itself goes unless `keep_text`. The table of surviving groups is written; Spark
    broadcasts it if its measured size allows, or else moves texts by (length, prefix) once.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    length, head = F.octet_length(text), F.xxhash64(ascii_lower_head(text, prefix))
    groups = docs.select(length.alias("__length"), head.alias("__head")).groupBy("__length", "__head").count()
    surviving = written(groups.filter("count > 1").select("__length", "__head", F.lit(True).alias("__survives")), "dedup-groups")
    rows = (
        docs.withColumns({"__length": length, "__head": head})
        .join(surviving, ["__length", "__head"], "left")
        .withColumn("__settled", F.col("__survives").isNull())
        .withColumn("__whole", F.when(~F.col("__settled") | F.lit(hash_settled), text))
        .drop("__length", "__head", "__survives")
    )
    hashed = with_columns_from_text(rows, "__whole", {"__hash": "binary"}, _sha256, drop=("__whole",) if keep_text else ("__whole", text_col))
    unread = F.lit(False) if hash_settled else F.col("__settled")
    return hashed.withColumn("__hash", F.when(~unread, F.col("__hash")))


def exact_groups(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, hash_settled: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_hash (null for settled rows unless asked for).

    Of equal texts the row of the largest doc_id stays; null ids come last. Of rows that repeat text and doc_id
    one stays. Columns besides id and text are not read. An empty table gives an empty result.
    """
    # the hashes are written once: the position in that table tells repeated rows apart from then on
    rows = written(
        refined(id_and_text(docs, id_col, text_col), TEXT, hash_settled, keep_text=False)
        .select(ID, "__settled", "__hash", F.monotonically_increasing_id().alias("__row")),
        "dedup-hashes",
    )
    open_ = rows.filter("not __settled")
    # A third of all rows may share one hash: they are combined before the shuffle here, and the join
    # that gives each row its group's figures is one that adaptive execution splits.
    best = open_.groupBy("__hash").agg(F.max(F.struct(ID, "__row")).alias("best"), F.count("*").alias("group_size"))
    best = written(best, "dedup-best")  # else the join would reuse the aggregate's partitioning, which can't be split
    grouped = open_.join(best, "__hash").select(
        ID, F.col(f"best.{ID}").alias("keep_id"), "group_size", (F.col("best.__row") == F.col("__row")).alias("kept"),
        F.col("__hash").alias("text_hash"),
    )
    alone = rows.filter("__settled").select(
        ID, F.col(ID).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("__hash").alias("text_hash"),
    )
    return grouped.unionByName(alone)


def deduplicate(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """docs with one row per text, that of the largest id, all columns as they were, of whatever names.

    Of rows that repeat id and text the one with the greatest hash of all columns (maps left out) stays. Settled rows pass; of the others
    each task first keeps its own best row per hash, and those meet in a shuffle.
    """

    def work(docs: DataFrame) -> DataFrame:
        names = docs.columns
        rows = refined(docs, text_col)
        whole = F.struct(*[column(c) for c in names])
        hashed = F.xxhash64(*[column(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
        best = (
            rows.filter("not __settled")
            .groupBy("__hash")
            .agg(F.max_by(whole, F.struct(column(id_col).cast("long"), hashed)).alias("row"))
            .select(*[F.col("row")[c].alias(c) for c in names])
        )
        return rows.filter("__settled").select(*[column(c) for c in names]).unionByName(best)

    return set_aside(docs, work, id_col, text_col)


def op4(spark, sf_dir: str) -> DataFrame:
    found = exact_groups(documents(spark, sf_dir), hash_settled=True)
    return found.select(
        ID, "keep_id", "group_size", "kept", F.lower(F.hex("text_hash")).alias("text_sha256")
    )


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(low) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
      FROM documents) d
WINDOW g AS (PARTITION BY low)
"""
