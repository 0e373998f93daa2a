"""Row order along each asset's timeline, without one task ever holding a whole asset.

Lags, rolling windows and row-based splits are defined on the row order of one asset. A window
``partitionBy(asset_id)`` would put a whole asset into one task, and one asset may hold a third of
the table. Two steps avoid that:

* ``with_row_index`` numbers the rows. Rows are counted per (asset, time slot), the counts are
  summed along the slots, and each row's number is its slot's offset plus its place in the slot.
  A slot is bounded by its width (timestamps are unique after cleaning), the table of slot counts by
  the length of the record.
* ``chunked`` cuts the numbered rows into chunks of equal row count and copies the few rows before
  and after a chunk that its windows reach. ``chunk_window`` is then an ordinary window, and
  ``home_rows`` drops the copies. Chunks are even whatever the skew between assets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetcast.schemas import KEY, TS

ROW = "row_index"
TOTAL = "n_rows"
CHUNK = "chunk"
CHUNK_ROWS = 8192


def day_slot(ts: str = TS) -> Column:
    return F.unix_date(F.to_date(F.col(ts))).cast("long")


def with_row_index(
    df: DataFrame,
    keys: list[str] | None = None,
    order: Column | None = None,
    slot: Column | None = None,
    index: str = ROW,
    total: str | None = TOTAL,
) -> DataFrame:
    """Add the 0-based row number per key group in ``order``, and the group's row count.

    ``slot`` must be a non-decreasing function of ``order``; the default is the calendar day.
    """
    keys = keys or [KEY]
    order = F.col(TS) if order is None else order
    rows = df.withColumn("_slot", day_slot() if slot is None else slot)
    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    running = F.sum("_n").over(by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = (
        rows.groupBy(*keys, "_slot")
        .agg(F.count("*").alias("_n"))
        .select(
            *keys,
            "_slot",
            (running - F.col("_n")).alias("_offset"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
        )
    )
    place = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(order))
    out = rows.join(offsets, [*keys, "_slot"]).withColumn(index, F.col("_offset") + place - 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_slot", "_offset", "_total")


def chunk_of(row: Column, chunk_rows: int) -> Column:
    return F.floor(row / F.lit(chunk_rows))


def chunked(
    df: DataFrame, back: int, ahead: int = 0, chunk_rows: int = CHUNK_ROWS, index: str = ROW, total: str = TOTAL
) -> DataFrame:
    """One copy of each row per chunk whose windows reach it (one copy for almost all rows)."""
    first = chunk_of(F.greatest(F.col(index) - ahead, F.lit(0)), chunk_rows)
    last = chunk_of(F.least(F.col(index) + back, F.col(total) - 1), chunk_rows)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last)))


def chunk_window(keys: list[str] | None = None, index: str = ROW) -> WindowSpec:
    return Window.partitionBy(*(keys or [KEY]), CHUNK).orderBy(index)


def home_rows(df: DataFrame, chunk_rows: int = CHUNK_ROWS, index: str = ROW) -> DataFrame:
    return df.where(F.col(CHUNK) == chunk_of(F.col(index), chunk_rows)).drop(CHUNK)


def along_timeline(
    df: DataFrame,
    columns: dict[str, object],
    back: int,
    ahead: int = 0,
    chunk_rows: int = CHUNK_ROWS,
    keys: list[str] | None = None,
) -> DataFrame:
    """Add window columns to indexed rows: ``columns`` maps a name to ``f(window) -> Column``.

    A stored timeline (see sources.timeline_store) has its chunks already, and is read without an exchange.
    """
    w = chunk_window(keys)
    if stored := stored_reach(df):
        if back > stored["back"] or ahead > stored["ahead"]:
            raise ValueError(f"the stored timeline reaches {stored['back']} rows back and {stored['ahead']} ahead; {back} and {ahead} are needed")
        reach, chunk_rows = df, stored["chunk_rows"]
    else:
        reach = chunked(df, back, ahead, chunk_rows)
    return home_rows(reach.select("*", *[make(w).alias(name) for name, make in columns.items()]), chunk_rows)


def stored_reach(df: DataFrame) -> dict | None:
    """How far the chunks of a stored timeline reach beyond their own rows, and their size; None for plain rows."""
    return df.schema[CHUNK].metadata or None if CHUNK in df.columns else None


def kept_columns(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and the chunk if the rows are those of a stored timeline."""
    return df.select(*columns, *([CHUNK] if stored_reach(df) else []))


def last_rows(df: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows per asset; Spark limits each map task's groups before the shuffle."""
    w = Window.partitionBy(*(keys or [KEY])).orderBy(F.col(TS).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def attach(facts: DataFrame, figures: DataFrame, keys: list[str] | None = None, salts: int = 16) -> DataFrame:
    """Left join per-asset figures (bounds, quantiles, biases) to the rows of a long table.

    Spark broadcasts the figures when their measured size allows it. Where it does not, the salt
    spreads a hot asset over ``salts`` tasks.
    """
    keys = keys or [KEY]
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(TS), F.lit(salts)).cast("int"))
    copies = figures.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], "left").drop("_salt")
