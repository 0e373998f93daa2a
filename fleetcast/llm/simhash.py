"""SimHash near-duplicates: all pairs of fingerprints within a Hamming distance, by the general pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits. If the thresholds of m partitions sum to distance - m + 1
(-1: the partition isn't probed), two fingerprints within the distance agree to within its threshold in some
partition. The thresholds, unequal ones allowed, come from dynamic programming over estimated candidate counts. Candidates are verified on
all bits. Fingerprints of overfull buckets are linked through the points of the ball around each, exactly and without pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, as_list, column, documents, set_aside, with_columns_from_text
from fleetcast.llm.components import components
from fleetcast.session import written

BITS, SHINGLE, SEED, DISTANCE = 64, 3, 42, 2
#: Numbers of partitions among which the cheapest is taken.
PARTITIONS = (2, 3, 4)
#: A bucket of more distinct fingerprints than this is not paired up but linked through balls.
BUCKET = 64
SPACES = b" \t\n\x0b\x0c\r"


def _word_runs(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The lower-cased words of a text; a very long text in runs, cut at white space."""
    at = 0
    while at < len(text):
        end = min(at + step, len(text))
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[at:end].lower().split()
        at = end


def _shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash as an unsigned number: words of ASCII white space, A-Z lower-cased, shingles with repeats."""
    counts, total, carry = np.zeros(BITS, np.int64), 0, []
    for words in _word_runs(text):
        words = carry + words
        if len(words) >= width:
            hashes = _shingle_hashes(words, width, seed)
            counts += _bit_counts(hashes)
            total += len(hashes)
        carry = words[-(width - 1) :] if width > 1 else []
    if not total and carry:
        counts, total = _bit_counts(_shingle_hashes([b" ".join(carry)], 1, seed)), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int, seed: int) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    def work() -> Callable[[pa.Array], list[pa.Array]]:
        def made(texts: pa.Array) -> list[pa.Array]:
            prints = np.array([fingerprint(t, width, seed) for t in as_list(texts)], np.uint64)
            return [pa.array(prints.view(np.int64))]

        return made

    return work


def with_fingerprint(docs: DataFrame, text_col: str = TEXT, width: int = SHINGLE, seed: int = SEED, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with __print, the fingerprint as a signed long."""
    return with_columns_from_text(docs, text_col, {"__print": "long"}, _fingerprints(width, seed), drop)


# Candidates ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits the number that have both: 64 by 64 sums of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            for at in range(0, len(values), 1 << 14):
                part = values[at : at + (1 << 14)]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                joint += (bits.T @ bits).astype(np.int64)
                n += len(part)
        if n:
            first, second = np.indices((BITS, BITS))
            cells = [pa.array(x.ravel().astype(np.int64)) for x in (first, second, joint)]
            count = pa.array([-1], pa.int64()), pa.array([-1], pa.int64()), pa.array([n], pa.int64())
            for arrays in (cells, count):
                yield pa.RecordBatch.from_arrays(list(arrays), names=["i", "j", "n"])

    rows = prints.mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect()  # 4,097 rows at most
    joint, total = np.zeros((BITS, BITS)), 0
    for i, j, n in rows:
        if i < 0:
            total = n
        else:
            joint[i, j] = n
    return total, joint


def correlated_groups(n: int, joint: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """The bits in m groups of nearly equal width, each grown from the most correlated bit by the bits most correlated to it."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (related[b, sorted(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: (related[b, group].sum(), -b)))
            free.discard(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def allocation(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one per partition, that sum to `total` at the least cost; costs[i][t + 1] is that of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        then: dict[int, tuple[float, list[int]]] = {}
        for at, (cost, chosen) in best.items():
            for t, more in enumerate(row, start=-1):
                option = (cost + more, [*chosen, t])
                if at + t not in then or option < then[at + t]:
                    then[at + t] = option
        best = then
    return best[total]


def partitions(prints: DataFrame, distance: int = DISTANCE) -> list[Part]:
    """The partitioning and thresholds of least estimated cost: probes to look up and candidates to verify."""
    n, joint = bit_statistics(prints)
    if n < 2:
        return [Part(tuple(range(BITS)), distance)]
    layouts = {m: correlated_groups(n, joint, m) for m in PARTITIONS if m <= distance + 2}
    groups = [(m, k, g) for m, gs in layouts.items() for k, g in enumerate(gs)]
    values = F.array(*[
        F.struct(F.lit(i).alias("group"), F.col("print").bitwiseAND(F.lit(Part(g, 0).mask)).alias("value"))
        for i, (_, _, g) in enumerate(groups)
    ])
    agreeing = dict(
        prints.select(F.explode(values).alias("v"))
        .groupBy("v.group", "v.value").count()
        .groupBy("group").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2))
        .collect()  # a row per group
    )
    p = np.diag(joint) / n
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    best: tuple[float, list[Part]] | None = None
    for m, own in layouts.items():
        costs = []
        for k, bits in enumerate(own):
            same = agreeing[groups.index((m, k, bits))]
            row, ways, probes = [0.0], np.zeros(distance + 1), 0
            ways[0] = 1
            for b in bits:  # sums of products of t bits' odds: pairs that differ in t bits of the group, to those that agree
                ways[1:] += ways[:-1] * odds[b]
            for t in range(distance + 1):
                probes += len(list(combinations(bits, t))) if t <= 1 else len(bits) * (len(bits) - 1) // 2
                row.append(float(probes * n + same * ways[: t + 1].sum()))
            costs.append(row)
        cost, chosen = allocation(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = cost, [Part(b, t) for b, t in zip(own, chosen, strict=True) if t >= 0]
    return best[1]


def _lookups(print_: Column, parts: list[Part], probing: bool) -> Column:
    """The buckets of a fingerprint: its own of each partition, and when probing those within the threshold too."""
    found = []
    for i, part in enumerate(parts):
        own = print_.bitwiseAND(F.lit(part.mask))
        for t in range(part.threshold + 1 if probing else 1):
            for bits in combinations(part.bits, t):
                value = own.bitwiseXOR(F.lit(_signed(sum(1 << b for b in bits)))) if bits else own
                found.append(F.struct(F.lit(i).alias("part"), value.alias("value")))
    return F.array(*found)


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (left, right) between the distinct values of `prints` (print) whose connected components are those of all
    pairs within `distance`, an even number."""
    if distance % 2:
        raise ValueError("distance must be even: balls of half the distance link overfull buckets")
    parts = partitions(prints, distance)

    def looked_up(name: str, probing: bool) -> DataFrame:
        return prints.select(F.col("print").alias(name), F.explode(_lookups(F.col("print"), parts, probing)).alias("b")).select(
            name, "b.part", "b.value"
        )

    index, probes = looked_up("left", False), looked_up("right", True)
    full = written(index.groupBy("part", "value").count().filter(F.col("count") > bucket).select("part", "value"), "full-buckets")
    pairs = (
        index.join(full, ["part", "value"], "left_anti")
        .join(probes, ["part", "value"])
        .filter((F.col("left") != F.col("right")) & (F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= distance))
        .select("left", "right")
    )
    # Two fingerprints within the distance have a point within half of it from both, and all that lie
    # so near to one point are within the distance of each other: they are linked to the least of them. A point
    # has a bounded number of such neighbours, however many fingerprints its bucket had.
    crowded = probes.join(full, ["part", "value"], "left_semi").select("right").distinct()
    shifts = [_signed(sum(1 << b for b in bits)) for t in range(distance // 2 + 1) for bits in combinations(range(BITS), t)]
    points = crowded.select("right", F.explode(F.array(*[F.col("right").bitwiseXOR(F.lit(s)) for s in shifts])).alias("point"))
    least = F.min("right").over(Window.partitionBy("point"))
    stars = points.withColumn("left", least).filter("left < right").select("left", "right").distinct()
    return pairs.unionByName(stars)


# Documents -------------------------------------------------------------------------------------------


def _classes(rows: DataFrame, distance: int) -> DataFrame:
    """(print, root) for the distinct fingerprints of rows (__print, ...); root is the least fingerprint reachable."""
    prints = written(rows.select(F.col("__print").alias("print")).distinct(), "prints")
    linked = components(links(prints, distance), "left", "right")
    return prints.join(linked, prints["print"] == linked["node"], "left").select("print", F.coalesce("root", "print").alias("root"))


def near_duplicate_classes(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, distance: int = DISTANCE) -> DataFrame:
    """doc_id, print (signed long), component_id: the smallest doc_id reachable over links, null if no row there has an id.

    A null or empty text has fingerprint 0 and links like any other. Repeated rows each give a row.
    """
    slim = docs.select(column(id_col).cast("long").alias(ID), column(text_col).cast("string").alias(TEXT))
    rows = written(with_fingerprint(slim, drop=(TEXT,)), "simhash-rows")
    least = rows.groupBy("__print").agg(F.min(ID).alias("least"))
    classes = _classes(rows, distance)
    named = written(least.join(classes, least["__print"] == classes["print"]).select("print", "root", "least"), "simhash-classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "root").select("print", "component_id")
    # a third of all rows may share a fingerprint; adaptive execution splits such a partition of this join
    return rows.join(by_print, rows["__print"] == by_print["print"]).select(ID, "print", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, distance: int = DISTANCE) -> DataFrame:
    """docs with one document of each class, that of the smallest id (null ids last, then by the text's hash), columns of whatever names
    as they were.

    Rows that repeat id and text count as one document and stay together.
    """
    return set_aside(docs, lambda rows: _apart(rows, id_col, text_col, distance), id_col, text_col)


def _apart(docs: DataFrame, id_col: str, text_col: str, distance: int) -> DataFrame:
    who = {"__id": column(id_col).cast("long"), "__hash": F.xxhash64(F.coalesce(column(text_col), F.lit("")))}
    slim = docs.select(*[c.alias(k) for k, c in who.items()], column(text_col).cast("string").alias(TEXT))
    rows = written(with_fingerprint(slim, drop=(TEXT,)), "simhash-rows")
    classes = _classes(rows, distance)
    placed = rows.join(classes, rows["__print"] == classes["print"]).select("root", F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash").alias("row"))
    placed = written(placed, "simhash-placed")
    first = placed.groupBy("root").agg(F.min("row").alias("first"))
    gone = written(placed.join(first, "root").filter("row != first").select("row.__id", "row.__hash").distinct(), "simhash-gone")
    g = gone.select(F.col("__id").alias("__gone_id"), F.col("__hash").alias("__gone_hash"))
    return docs.join(g, who["__id"].eqNullSafe(g["__gone_id"]) & (who["__hash"] == g["__gone_hash"]), "left_anti")


def op10(spark, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(documents(spark, sf_dir))
    return found.select(ID, F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
