"""Exact group quantiles that never hold a group in one task.

``percentile`` keeps all distinct values of a group in one buffer. Here a first pass makes a mergeable sketch per group, which
brackets each wanted rank. The second counts what lies between the brackets, without its values, and keeps
only the values inside them: a small share of the rows crosses an exchange, whatever the scale of the values. The counts are exact, so a rank that lies outside
its bracket (the sketch's bound holds for nearly all) is noticed, and looked for again where it was counted. Linear interpolation between the two neighbouring
ranks, as NumPy's default and SQL ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.session import written

#: Size of a sketch, and the share of a group's rows by which a bracket reaches beyond its rank on either side: three
#: times the sketch's error in rank. A sketch is asked for GRID + 1 even ranks. A bracket is sorted in cells.
SKETCH, SLACK, GRID, CELLS = 512, 0.016, 250, 64
#: Tasks over which a group's rows are spread where their brackets are too many to broadcast.
SALTS = 16


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


Wanted = float | Callable[[Column], Column]


def upper_median(total: Column) -> Column:
    return F.floor(total / 2)


def _position(p: Wanted, total: Column) -> Column:
    return p(total).cast("double") if callable(p) else F.lit(float(p)) * (total - 1)


def _brackets(rows: DataFrame, keys: list[str], wanted: list[Wanted], sketch: int, slack: float) -> DataFrame:
    """Per group its row count and, per wanted rank, the ends of the bracket: all values in a group no larger than a sketch."""
    total = F.col("_total")
    sketched = rows.groupBy(*keys).agg(F.count("*").alias("_total"), F.kll_sketch_agg_double("_v", F.lit(sketch)).alias("_sketch"))
    even = F.array(*[F.lit(g / GRID) for g in range(GRID + 1)])
    asked = sketched.select(*keys, "_total", F.kll_sketch_get_quantile_double("_sketch", even).alias("_grid"))
    ends = []
    for i, p in enumerate(wanted):
        pos = _position(p, total)
        low = F.floor((F.floor(pos) / total - slack) * GRID)
        high = F.ceil(((F.ceil(pos) + 1) / total + slack) * GRID)
        for name, at, end in ((f"_low{i}", low, 0), (f"_high{i}", high, GRID)):
            near = F.greatest(F.least(at, F.lit(GRID)), F.lit(0)).cast("int")
            ends.append(F.get("_grid", F.when(total <= sketch, F.lit(end)).otherwise(near)).alias(name))
    return asked.select(*keys, "_total", *ends)


def _counted(rows: DataFrame, keys: list[str], brackets: DataFrame, n: int) -> DataFrame:
    """Rows per (group, cell, value): cells grow with the values; the value is null outside all brackets."""
    v, lows, highs = F.col("_v"), [F.col(f"_low{i}") for i in range(n)], [F.col(f"_high{i}") for i in range(n)]
    place, inside, part = F.lit(0), F.lit(False), F.lit(0)
    for low, high in zip(lows, highs, strict=True):
        place = place + (v >= low).cast("int") + (v > high).cast("int")
        inside = inside | ((v >= low) & (v <= high))
    for low, high in reversed(list(zip(lows, highs, strict=True))):
        width = high - low
        cell = F.when(width > 0, F.least(F.floor((v - low) / width * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0))
        part = F.when((v >= low) & (v <= high), cell).otherwise(part)
    # the brackets are a written table: Spark broadcasts it if its size allows, else the salt spreads a hot group
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    copies = brackets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        spread.join(copies, [*keys, "_salt"])
        .select(*keys, "_v", (place * CELLS + F.when(inside, part).otherwise(0)).cast("long").alias("_cell"), F.when(inside, v).alias("_value"))
        .groupBy(*keys, "_cell", "_value")
        .agg(F.count("*").alias("_m"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    )


def _picked(rows: DataFrame, keys: list[str], brackets: DataFrame, wanted: list[Wanted]) -> DataFrame:
    """Per group: the values at the floor and the ceiling of each wanted position, null where the rank is outside its bracket;
    and the least and greatest value of the cells that hold them."""
    counted = _counted(rows, keys, brackets, len(wanted))
    along = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = (
        counted.groupBy(*keys, "_cell")
        .agg(F.sum("_m").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
        .withColumn("_upto", F.sum("_n").over(along))  # a bounded number of cells a group
        .withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )
    total = F.col("_all")
    ranks = [[F.floor(_position(p, total)), F.ceil(_position(p, total))] for p in wanted]

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_before")) & (rank < F.col("_upto"))

    hit = F.lit(False)
    for rank in (r for pair in ranks for r in pair):
        hit = hit | holds(rank)
    hits = cells.where(hit).select(*keys, "_cell", "_before", "_upto", "_all", F.col("_first").alias("_from_value"), F.col("_last").alias("_to_value"))
    in_cell = Window.partitionBy(*keys, "_cell").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counted.join(hits, [*keys, "_cell"])
        .withColumn("_to", F.col("_before") + F.sum("_m").over(in_cell))
        .withColumn("_from", F.col("_to") - F.col("_m"))
    )
    picks = []
    for i, pair in enumerate(ranks):
        for name, rank in zip((f"_lo{i}", f"_hi{i}"), pair, strict=True):
            picks.append(F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_value"))).alias(name))
        here = holds(pair[0]) | holds(pair[1])
        picks += [F.min(F.when(here, F.col("_from_value"))).alias(f"_low{i}"), F.max(F.when(here, F.col("_to_value"))).alias(f"_high{i}")]
    return ranked.groupBy(*keys).agg(F.max("_all").alias("_total"), *picks)


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    wanted: Mapping[str, Wanted],
    count: str | None = None,
    sketch: int = SKETCH,
    slack: float = SLACK,
) -> DataFrame:
    """One row per key group with a column per entry of ``wanted`` (name -> probability,
    or a function from the row count to the 0-based position).

    Non-finite values and rows with a null key are left out. ``sketch`` and ``slack`` set only the cost. The work is done at once: the
    values, the brackets and the picked values are written tables, the last two with a row per group.
    """
    ranks = list(wanted.values())
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(is_finite(F.col("_v")))
    rows = written(rows, "quantile-values")  # read twice: what made the values may be dear
    brackets = written(_brackets(rows, keys, ranks, sketch, slack), "quantile-brackets")
    picked = written(_picked(rows, keys, brackets, ranks), "quantile-picks")
    outside = F.lit(False)
    for i in range(len(ranks)):
        outside = outside | F.col(f"_lo{i}").isNull() | F.col(f"_hi{i}").isNull()
    missed = picked.where(outside)
    if not missed.isEmpty():
        closer = written(missed.drop(*[f"_{side}{i}" for i in range(len(ranks)) for side in ("lo", "hi")]), "quantile-brackets")
        again = _picked(rows, keys, closer, ranks)
        picked = picked.where(~outside).unionByName(written(again, "quantile-picks"))
    total, out = F.col("_total"), []
    for i, (name, p) in enumerate(wanted.items()):
        pos, lo, hi = _position(p, total), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    if count:
        out.append(total.alias(count))
    return picked.select(*keys, *out)
