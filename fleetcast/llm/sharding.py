"""Sharding by histogram sort: near-equal bytes per shard in the order of a key, with one exchange of the rows.

The key of a row is the hash of its text, then the hash of its id, so equal texts lie side by side and a text that
fills a large part of the table can still be cut. Rows that repeat both, where they are many, get a third part of their own. Splitters are found by counting the exact bytes below
candidate boundaries (probes) in all partitions at once, and laying new probes only into the intervals in which a
target still lies, until every splitter is within the tolerance or its interval holds one row's key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, column, documents, free_name
from fleetcast.session import written

#: Probes laid into an interval each round.
PROBES = 256
#: A splitter may miss its target by this share of a shard's bytes.
TOLERANCE = 0.002
#: Rows that are numbered together in one window.
PIECE_ROWS = 50_000
PARTS = ("__first", "__second", "__third")


@dataclass(frozen=True)
class Splitter:
    """Rows with a key of at least `key` lie at or above it; `below` is the exact number of bytes under it, `missed` whether
    that is beyond the tolerance."""

    key: tuple[int, int, int]
    below: int
    missed: bool


@dataclass
class _Open:
    """A target that lies in an interval: values low to high of one part of the key, `prefix` being the parts before."""

    target: float
    prefix: tuple[int, ...]
    low: int
    high: int
    below: int


def _key(text: Column, id_: Column) -> tuple[Column, Column]:
    """Two hashes of 62 bits: differences of such values fit a long."""
    own = F.coalesce(id_.cast("string"), F.lit(""))
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2), F.shiftrightunsigned(F.xxhash64(own), 2)


def _counts(rows: DataFrame, spans: list[_Open]) -> list[list[tuple[int, int, int, int]]]:
    """For each span the filled probe intervals in order: (number, bytes, smallest key part, largest key part)."""
    known = {}
    branches = []
    for i, s in enumerate(spans):
        same = (s.prefix, s.low, s.high)
        if same in known:
            continue
        known[same] = i
        at = F.col(PARTS[len(s.prefix)])
        inside = (at >= s.low) & (at <= s.high)
        for part, v in zip(PARTS, s.prefix, strict=False):
            inside = inside & (F.col(part) == v)
        width = max(1, -(-(s.high - s.low + 1) // PROBES))
        number = F.floor(F.expr(f"({PARTS[len(s.prefix)]} - {s.low}L) div {width}L"))
        branches.append(F.when(inside, F.struct(F.lit(i).alias("span"), number.cast("int").alias("number"), at.alias("at"))))
    # the spans exclude one another, so a row lies in one at most
    sums = (
        rows.select("__bytes", F.coalesce(*branches).alias("hit"))
        .filter("hit is not null")
        .groupBy("hit.span", "hit.number")
        .agg(F.sum("__bytes"), F.min("hit.at"), F.max("hit.at"))
        .collect()  # at most PROBES rows a span
    )
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    for span, *row in sorted(tuple(r) for r in sums):
        by.setdefault(span, []).append(tuple(row))
    return [by.get(known[(s.prefix, s.low, s.high)], []) for s in spans]


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Splitter]:
    """The shards - 1 splitters of rows (__first, __second, __third, __bytes), in order.

    A boundary between texts is taken where one is within the tolerance; only else is a group of equal texts cut. Where neither is,
    the nearest boundary between two rows' keys is.
    """
    total, low, high = rows.agg(F.coalesce(F.sum("__bytes"), F.lit(0)), F.min("__first"), F.max("__first")).first()
    if not total:
        return []
    allowed = tolerance * total / shards
    found: dict[int, Splitter] = {}
    spans = {k: _Open(total * k / shards, (), low, high, 0) for k in range(1, shards)}
    while spans:
        for (k, s), filled in zip(list(spans.items()), _counts(rows, list(spans.values())), strict=True):
            below = s.below
            for i, (_, size, at, last) in enumerate(filled):
                if below + size < s.target and i + 1 < len(filled):
                    below += size
                    continue
                # the target lies in this interval: its lower end, the lower end of the next one, or deeper
                ends = [(below, at)] + [(below + size, x[2]) for x in filled[i + 1 : i + 2]]
                miss, under, value = min((abs(b - s.target), b, v) for b, v in ends)
                key = (*s.prefix, value, *([-1] * (2 - len(s.prefix))))
                single = at == last and len(s.prefix) == 2
                if miss <= allowed or single:
                    found[k] = Splitter(key, under, miss > allowed)
                    del spans[k]
                elif at == last:  # one text, or id of it, fills the interval: its rows are told apart by the next part
                    spans[k] = _Open(s.target, (*s.prefix, at), 0, (1 << 62) - 1, below)
                else:
                    spans[k] = _Open(s.target, s.prefix, at, last, below)
                break
    return [found[k] for k in sorted(found)]


def _at_or_above(s: Splitter) -> Column:
    above = F.lit(True)
    for part, v in reversed(list(zip(PARTS, s.key, strict=True))):
        above = (F.col(part) > v) | ((F.col(part) == v) & above)
    return above.cast("int")


def _repeated(slim: DataFrame, heavy: DataFrame, cuts: list[Splitter], piece: Column, piece_rows: int) -> DataFrame | None:
    """The keys (__first, __second) of rows that repeat id and text so often that a splitter or a window's size calls for parting them."""
    counted = slim.withColumn("__piece", piece).join(heavy, "__piece", "left_semi").groupBy(*PARTS[:2]).count()
    keys = written(counted.filter(F.col("count") > piece_rows).select(*PARTS[:2]), "shard-repeated")
    at = {s.key[:2] for s in cuts if s.missed}  # a splitter misses its target only inside a group of one key
    if at:
        inside = F.lit(False)
        for first, second in at:
            inside = inside | ((F.col(PARTS[0]) == first) & (F.col(PARTS[1]) == second))
        sizes = slim.filter(inside).groupBy(*PARTS[:2]).count().filter("count > 1").select(*PARTS[:2])
        keys = written(keys.unionByName(sizes).distinct(), "shard-repeated")
    return None if keys.isEmpty() else keys


def shard_by_bytes(
    docs: DataFrame, id_col: str = ID, text_col: str = TEXT, shards: int = 16, tolerance: float = TOLERANCE,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """docs with __shard (0 to shards - 1), __slot (gapless from 0) and __bytes; a name that docs has is lengthened by "_".

    A row's bytes are those of its text in UTF-8, plus 1; a null text has none. Rows of equal texts, also with one id, lie in one
    shard unless their group is cut by a splitter. An empty table gives no rows.
    """
    first, second = _key(column(text_col), column(id_col))
    size = (F.coalesce(F.octet_length(column(text_col)), F.lit(0)) + 1).cast("long")
    row = F.struct(*[column(c) for c in docs.columns]).alias("row")
    keyed = docs.select(row, first.alias("__first"), second.alias("__second"), F.lit(0).cast("long").alias("__third"), size.alias("__bytes"))
    slim = written(keyed.select(*PARTS, "__bytes"), "shard-keys")
    cuts = splitters(slim, shards, tolerance)

    # Hashes are even, so equal ranges of them hold about equally many rows. A text that fills far more than a range's share is
    # dealt on by the second hash, and its repeated rows by the third. The exact counts of the ranges give their first slots.
    n = slim.count()
    bits = max(0, (max(1, n // piece_rows) - 1).bit_length())
    piece = F.shiftright("__first", 62 - bits)
    heavy = slim.groupBy(piece.alias("__piece")).count().filter(F.col("count") > 2 * piece_rows)
    heavy = written(heavy.select("__piece", F.ceil(F.log2(F.col("count") / piece_rows)).cast("int").alias("__more")), "shard-heavy")
    if (again := _repeated(slim, heavy, cuts, piece, piece_rows)) is not None:
        # written, so that a row keeps its number; rows that repeat id and text may take each other's
        number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2)
        apart = written(keyed.join(again, list(PARTS[:2]), "left_semi").withColumn("__third", number), "shard-apart")
        keyed = keyed.join(again, list(PARTS[:2]), "left_anti").unionByName(apart)
        others = slim.join(again, list(PARTS[:2]), "left_anti")
        slim = written(others.unionByName(apart.select(*PARTS, "__bytes")), "shard-keys")
        cuts = splitters(slim, shards, tolerance)
    shard = sum((_at_or_above(s) for s in cuts), F.lit(0))
    fine = F.expr("shiftright(if(__third = 0, __second, __third), cast(62 - __more as int))")

    def pieces(df: DataFrame) -> DataFrame:
        # most ranges are not heavy: the table has a row for each that is
        return (
            df.withColumns({"__piece": piece, "__shard": shard})
            .join(heavy, "__piece", "left")
            .withColumn("__fine", F.when(F.col("__more").isNotNull(), fine).otherwise(F.lit(0)))
            .drop("__more")
        )

    where = ["__shard", "__piece", "__fine"]
    counts = pieces(slim).groupBy(*where).count()
    before = Window.partitionBy("__shard").orderBy("__piece", "__fine").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        counts.select(*where, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")), "shard-starts"
    )
    # the one exchange of the rows: each goes to its piece of its shard and is sorted there
    order = Window.partitionBy(*where).orderBy(*PARTS)
    numbered = pieces(keyed).withColumn("__number", F.row_number().over(order) - 1)
    slot = (F.col("__start") + F.col("__number")).cast("long")
    names = [free_name(docs, c) for c in ("__shard", "__slot", "__bytes")]
    values = [F.col("__shard"), slot, F.col("__bytes")]
    return numbered.join(starts, where).select("row.*", *[v.alias(c) for v, c in zip(values, names, strict=True)])


def op1(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(ID, TEXT)
    digests = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col(TEXT), F.lit("")).cast("binary")))
    return shard_by_bytes(digests).select(
        ID, F.col("__bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
