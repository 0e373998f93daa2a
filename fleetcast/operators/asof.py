"""As-of joins: each row takes the latest row of another table at or before its time.

Neither a range join nor a window over an asset: the rows of both tables are counted per (key, time slot), neighbouring slots become
chunks of about equal row count, and inside a chunk a running ``last`` carries the other table's row along. What the chunks before
have last is found from a table of one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.functions.columns import minutes_between
from fleetcast.operators.timeline import CHUNK, CHUNK_ROWS, chunk_of, day_slot
from fleetcast.schemas import KEY, TS

_SLOT, _SIDE, _LEFT, _RIGHT = "_slot", "_side", "_left", "_right"


def _chunks(events: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """The chunk of each (key, slot): whole slots, a new chunk after about ``chunk_rows`` rows."""
    before = Window.partitionBy(*keys).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    counts = events.groupBy(*keys, _SLOT).agg(F.count("*").alias("_n"))
    return counts.select(*keys, _SLOT, chunk_of(F.coalesce(F.sum("_n").over(before), F.lit(0)), chunk_rows).alias(CHUNK))


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = (KEY,),
    ts: str = TS,
    prefix: str = "right_",
    max_age_minutes: float | None = None,
    strict: bool = False,
    slot: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """All rows of ``left`` with the latest row of ``right`` of the same key at or before their time.

    The columns of ``right``, its time included, come with ``prefix``; they are null where there is none, where it is older than
    ``max_age_minutes``, and where the left row has no time or key. ``strict`` takes only earlier rows. Of several right rows of one
    time the greatest counts, compared column by column; right rows without a time are passed over. ``slot`` must be a
    non-decreasing function of ``ts`` (default: its day); a slot is never split.
    """
    keys = list(keys)
    others = [c for c in right.columns if c not in (*keys, ts)]
    added = [f"{prefix}{c}" for c in (ts, *others)]
    if clash := sorted({c.lower() for c in added} & {c.lower() for c in left.columns}):
        raise ValueError(f"the prefix gives names that the left table has: {clash}")
    at = day_slot(ts) if slot is None else slot
    whole = F.col(ts).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    newest = right.where(whole).groupBy(*keys, ts).agg(F.max(F.struct(ts, *others)).alias(_RIGHT)).withColumn(_SLOT, at)
    rows = left.where(whole).withColumn(_SLOT, at)
    chunks = _chunks(rows.select(*keys, _SLOT).unionByName(newest.select(*keys, _SLOT)), keys, chunk_rows)

    nothing = F.lit(None)
    events = rows.select(
        *keys, ts, _SLOT, F.lit(0 if strict else 2).alias(_SIDE), F.struct(*[F.col(c) for c in left.columns]).alias(_LEFT),
        nothing.cast(newest.schema[_RIGHT].dataType).alias(_RIGHT),
    ).unionByName(
        newest.select(*keys, ts, _SLOT, F.lit(1).alias(_SIDE), nothing.cast(rows.select(*left.columns).schema).alias(_LEFT), _RIGHT)
    )
    along = Window.partitionBy(*keys, CHUNK).orderBy(ts, _SIDE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = events.join(chunks, [*keys, _SLOT]).withColumn("_here", F.last(_RIGHT, ignorenulls=True).over(along))

    last = newest.join(chunks, [*keys, _SLOT]).groupBy(*keys, CHUNK).agg(F.max_by(_RIGHT, ts).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    seams = (
        chunks.select(*keys, CHUNK).distinct().join(last, [*keys, CHUNK], "left")
        .select(*keys, CHUNK, F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    )
    found = carried.where(F.col(_SIDE) != 1).join(seams, [*keys, CHUNK]).withColumn("_found", F.coalesce("_here", "_before"))
    taken = F.col("_found")
    if max_age_minutes is not None:
        recent = minutes_between(F.col(ts), F.col("_found")[ts]) <= F.lit(float(max_age_minutes))
        taken = F.when(recent, taken)
    out = found.withColumn("_found", taken).select(
        f"{_LEFT}.*", *[F.col("_found")[c].alias(name) for c, name in zip((ts, *others), added, strict=True)]
    )
    apart = left.where(~whole)
    kinds = {f.name: f.dataType for f in right.schema}
    return out.unionByName(apart.withColumns({n: nothing.cast(kinds[c]) for c, n in zip((ts, *others), added, strict=True)}))


def with_weather_as_of(
    observations: DataFrame, weather: DataFrame, max_age_minutes: float | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The last weather row at or before an observation, its time as ``weather_timestamp``."""
    return as_of(observations, weather, prefix="weather_", max_age_minutes=max_age_minutes, chunk_rows=chunk_rows)
