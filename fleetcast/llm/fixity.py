"""Fixity audit of WARC replicas with Merkle trees.

The records of an archive are the leaves, in the order of their offsets; a node is the hash of the nodes below it that lie in
one range of offsets, ranges growing by a fixed factor up to the root. Replicas are compared at the roots, and only
branches that differ are followed down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.session import written

#: Offsets per lowest range, as a power of two, and the power of two by which ranges grow from level to level.
LOWEST, GROWTH = 16, 4
#: Pages of one archive.
PAGES = 500
NODE = ["archive", "range"]


def rendered(pages: DataFrame, pages_per_archive: int = PAGES) -> DataFrame:
    """pages (page_id, url, html) as response records: archive, page_id, record (binary), length, record_sha256.

    A null url or html is empty; pages without id go to archive -1.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, html, F.lit("\r\n\r\n"))
    archive = F.coalesce(F.floor(F.col("page_id") / pages_per_archive), F.lit(-1)).cast("long")
    rows = pages.select(archive.alias("archive"), F.col("page_id").cast("long").alias("page_id"), record.cast("binary").alias("record"))
    return rows.withColumns({"length": F.octet_length("record").cast("long"), "record_sha256": F.sha2("record", 256)})


def with_offsets(rows: DataFrame) -> DataFrame:
    """The records' offsets: those of an archive lie in the order of page_id, then of their hashes.

    Hashes and lengths are known before the exchange, so the records themselves move only if they are asked for.
    """
    before = Window.partitionBy("archive").orderBy("page_id", "record_sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def warc_records(pages: DataFrame, pages_per_archive: int = PAGES) -> DataFrame:
    """archive, offset, length, page_id, record, record_sha256 of all pages."""
    return with_offsets(rendered(pages, pages_per_archive))


def leaves(records: DataFrame) -> DataFrame:
    """archive, offset, hash per record. Records that claim the same offset are hashed together, in the order of their own hashes."""
    own = records.select("archive", "offset", F.col("record_sha256").alias("own"))
    per_offset = own.groupBy("archive", "offset").agg(F.array_sort(F.collect_list("own")).alias("all"))
    return per_offset.select("archive", "offset", F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise(F.sha2(F.array_join("all", ""), 256)).alias("hash"))


def _up(nodes: DataFrame, below: str, bits: int) -> DataFrame:
    """The nodes one level up: hashes of the ranges and hashes under each, in order. A range holds a bounded number of those."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(below, "hash"))), lambda x: F.concat_ws(":", x[below], x["hash"])), ",")
    return nodes.groupBy("archive", F.shiftright(below, bits).alias("up")).agg(F.sha2(joined, 256).alias("hash")).select(
        "archive", F.col("up").alias("range"), "hash"
    )


def tree(records: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The written levels of a replica's trees, records first; the last has a single range, 0, per archive."""
    rows = [written(leaves(records), f"{name}-0")]
    rows.append(written(_up(rows[0], "offset", LOWEST), f"{name}-1"))
    for k in range(2, levels + 1):
        rows.append(written(_up(rows[-1], "range", GROWTH), f"{name}-{k}"))
    return rows


def levels_for(*replicas: DataFrame) -> int:
    """Levels above the records until one range spans the highest offset of all replicas."""
    top = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas) >> LOWEST
    levels = 1
    while top:
        top >>= GROWTH
        levels += 1
    return levels


def _matching(key: list[str]) -> Column:
    """Equal keys of two sides, the second's with "_b" behind their names; a null key matches a null key."""
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    return same


def _other(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}_b" for k in key})


def _differing(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    a, b = one.withColumnRenamed("hash", "hash_a"), _other(two.withColumnRenamed("hash", "hash_b"), key)
    both = a.join(b, _matching(key), "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    return both.select(*[F.coalesce(k, f"{k}_b").alias(k) for k in key], "hash_a", "hash_b")


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Where two replicas (archive, offset, record_sha256) differ: archive, offset, hash_a, hash_b (null: no record there), status.

    status: changed, missing (only in the first), added (only in the second). Empty replicas differ by the other's records. Records
    without an archive are an archive of their own; those of an archive without an offset are hashed together. Offsets are those of a
    shared index: a replica whose records were moved has to be given the original's.
    """
    levels = levels_for(one, two)
    a, b = tree(one, levels, "fixity-a"), tree(two, levels, "fixity-b")
    open_ = written(_differing(a[levels], b[levels], NODE).select(*NODE), "fixity-open")
    for k in range(levels - 1, 0, -1):

        def under(level: DataFrame, above: DataFrame = open_) -> DataFrame:
            up = above.select("archive", F.col("range").alias("up"))
            key = ["archive", "up"]
            return level.withColumn("up", F.shiftright("range", GROWTH)).join(_other(up, key), _matching(key), "left_semi").drop("up")

        open_ = written(_differing(under(a[k]), under(b[k]), NODE).select(*NODE), "fixity-open")

    def records(level: DataFrame) -> DataFrame:
        ranged = level.withColumn("range", F.shiftright("offset", LOWEST))
        return ranged.join(_other(open_, NODE), _matching(NODE), "left_semi").drop("range")

    found = _differing(records(a[0]), records(b[0]), ["archive", "offset"])
    status = F.when(F.col("hash_b").isNull(), F.lit("missing")).when(F.col("hash_a").isNull(), F.lit("added")).otherwise(F.lit("changed"))
    return found.select("archive", "offset", "hash_a", "hash_b", status.alias("status"))


def damaged_record() -> Column:
    """A record of a replica with faults at known places: a byte turned in every 97th page, every 389th page lost (null),
    a record cut short in every 577th."""
    at = (F.octet_length("record") / 2).cast("int")
    turned = F.concat(F.substring(F.col("record"), F.lit(1), at), F.lit(b"~"), F.substring(F.col("record"), at + 2, F.octet_length("record")))
    cut = F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 7)
    page = F.col("page_id")
    whole = F.when(page % 97 == 5, turned).when(page % 577 == 11, cut).otherwise(F.col("record"))
    return F.when(F.coalesce(page % 389 != 7, F.lit(True)), whole)


def op7(spark, sf_dir: str) -> DataFrame:
    """All pages as archives, audited against a replica with faults."""
    rows = rendered(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("replica_sha256", F.sha2(damaged_record(), 256))
    both = written(with_offsets(rows).select("archive", "offset", "record_sha256", "replica_sha256"), "fixity-records")
    replica = both.filter("replica_sha256 is not null").select("archive", "offset", F.col("replica_sha256").alias("record_sha256"))
    return audit(both.select("archive", "offset", "record_sha256"), replica)


OP7_SQL = r"""
WITH r AS (
  SELECT page_id, CAST(floor(page_id/500) AS BIGINT) AS archive,
         concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
                'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10),
                coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages),
o AS (SELECT *, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
             hex(encode(record)) AS h, strlen(record) AS n FROM r)
SELECT archive, "offset", sha256(record) AS hash_a,
       CASE WHEN page_id % 389 = 7 THEN NULL
            WHEN page_id % 97 = 5 THEN sha256(unhex(concat(substr(h, 1, 2*(n // 2)), '7E', substr(h, 2*(n // 2) + 3))))
            ELSE sha256(unhex(substr(h, 1, 2*(n - 7)))) END AS hash_b,
       CASE WHEN page_id % 389 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM o WHERE page_id % 97 = 5 OR page_id % 389 = 7 OR page_id % 577 = 11
"""
