"""Mixing sources to target weights by hash-threshold histograms.

A document's hash is a fixed point in [0, 2^60); a source takes the documents whose hash lies below its threshold.
Thresholds are found from sums of words by (source, hash bucket): running sums over the buckets show the one in
which the budget ends, and only that bucket is split into finer ones. Nothing is sorted by document, and a larger
budget always takes what a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, WORD, column, documents, set_aside
from fleetcast.session import written

#: Hexadecimal digits of a hash, and of one step of refinement (256 buckets a source).
DIGITS, STEP = 15, 3
WEIGHTS, MOST = (1.0, 2.0, 3.0), 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target per source of `sizes` (source, size).

    Sources in order of their code points, null last, weigh as `weights` say, repeating. Together they get all
    words; no target exceeds `most` times the source's size, and what is cut off goes to the others by weight. Each round fixes the
    sources that are over their limit; only two sums a round reach the driver.
    """
    spark = sizes.sparkSession
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source, not per document
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    table = written(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("limit")), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0  # words per unit of weight
    while True:
        full = F.col("limit") <= F.col("weight") * share
        fixed, rest = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        now = (total - fixed) / rest if rest > 0 else share
        if now <= share:
            break
        share = now
    target = F.least(F.col("limit"), F.col("weight") * F.lit(share))
    return table.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole (times every document is taken), below (hashes under it are taken once more).

    `sized` has source, size, point (hexadecimal hash). `below` is a hexadecimal string as well; '' takes none.
    """
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("whole", ratio).withColumns(
        {"left": F.col("target") - F.col("whole") * F.col("source_size"), "below": F.lit("")}
    )
    state = written(state, "mix-state")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for digits in range(STEP, DIGITS + 1, STEP):
        # only the bucket in which each source's budget ends is looked into
        inside = sized.join(state.select(F.col("source").alias("s"), "below", "left"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter((F.col("left") > 0) & F.col("point").startswith(F.col("below")))
        bucket = F.substring("point", 1, digits)
        sums = inside.groupBy("source", bucket.alias("bucket"), "left").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(running)).withColumn("before", F.col("upto") - F.col("words"))
        # the bucket that holds the end of the budget; at the last digit the nearer side of it
        ends = sums.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("upto")))
        if digits == DIGITS:
            over = (F.col("upto") - F.col("left")) < (F.col("left") - F.col("before"))
            ends = ends.withColumn("bucket", F.when(over, F.concat("bucket", F.lit("g"))).otherwise(F.col("bucket")))
        ends = ends.select(F.col("source").alias("s"), "bucket", "before")
        state = written(
            state.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "whole",
                (F.col("left") - F.coalesce(F.col("before"), F.lit(0))).alias("left"),
                F.coalesce("bucket", "below").alias("below"),
            ),
            "mix-state",
        )
    return state.drop("left")


def mix(
    docs: DataFrame, id_col: str = ID, text_col: str = TEXT, source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """docs with __size, __source_size, __target, __repeats (times the mix takes the document, 0 to `most`).

    A null text has no words; a null source is a source of its own. Rows that repeat doc_id have one hash and
    are taken together. A source without words has target 0, and its documents are not taken. Reruns agree: the hash is that of the id.
    """
    point = F.substring(F.md5(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")), 1, DIGITS)
    slim = docs.select(column(source_col).alias("source"), size_of(column(text_col)).alias("size"), point.alias("point"))
    sized = written(slim, "mix-sizes")
    state = thresholds(sized, source_targets(sized, weights, most)).select(
        F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("below").alias("__below")
    )
    once_more = (point < F.col("__below")).cast("long")
    return (
        docs.join(state, column(source_col).eqNullSafe(F.col("__s")))
        .withColumns({"__size": size_of(column(text_col)), "__repeats": F.col("__whole") + once_more})
        .drop("__s", "__whole", "__below")
    )


def mixed(docs: DataFrame, **columns: str) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as they were, of whatever names."""

    def work(rows: DataFrame) -> DataFrame:
        taken = mix(rows, **columns).filter("__repeats > 0")
        copies = taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__repeats").cast("int"))))
        return copies.select(*[column(c) for c in rows.columns])

    return set_aside(docs, work, *columns.values())


def op8(spark, sf_dir: str) -> DataFrame:
    taken = mix(documents(spark, sf_dir).select(ID, TEXT, "source"))
    return taken.select(
        ID, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__repeats")).alias("taken"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS point,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, source_size, 3e0*source_size AS lim,
             CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
o AS (SELECT *, lim/w AS cap, coalesce(sum(lim) OVER (ORDER BY lim/w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
             sum(w) OVER (ORDER BY lim/w DESC, w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rest,
             sum(source_size) OVER () AS total FROM s),
share AS (SELECT coalesce(max((total - fixed)/rest) FILTER (WHERE (total - fixed)/rest < cap), 0) AS share FROM o),
t AS (SELECT source, source_size, least(lim, w*share) AS target FROM s, share),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target/source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT source, point, sum(words) OVER r AS upto, sum(words) OVER r - words AS before
      FROM (SELECT source, point, sum(size) AS words FROM d GROUP BY source, point) WINDOW r AS (PARTITION BY source ORDER BY point))
SELECT d.doc_id, d.size, u.source_size, u.target,
       CAST(d.size*(u.whole + CASE WHEN target - whole*source_size > 0 AND (upto <= target - whole*source_size OR before <= target - whole*source_size
         AND upto - (target - whole*source_size) < (target - whole*source_size) - before) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
       JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.point = p.point
"""
