"""Whitening of embeddings by a covariance weighted with multiplicities.

Identical integer vectors are one group with a count. Sums are exact; the covariance is a centred product of matrices over the
distinct vectors, weighted with the counts (or one each); every distinct vector is whitened once and joined back to its rows.

A row is left out if its vector is null, holds null or an entry that isn't finite, or has not the length that most vectors have (of
equally frequent lengths the larger). An entry c becomes floor(64 c) + 1,000,000, within +-2^62. Rows with a null id stay; rows that
repeat stay. A component without variance has null in place of whitened values and doesn't count for identity_error. No rows give no rows.
The driver holds matrices of the vectors' length squared, nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import column
from fleetcast.session import written

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Matrix entries handled at once.
ENTRIES = 1 << 18
LARGEST = 2**62


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (little-endian longs, binary) of all rows with a usable vector."""
    slim = embeddings.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)  # null becomes NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            usable = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(SCALE * values)
            whole = np.where(np.abs(scaled) < float(1 << 61), scaled, 0).astype(np.int64) + SHIFT
            whole = np.where(scaled >= float(1 << 61), LARGEST, np.where(scaled <= -float(1 << 61), -LARGEST, whole)).astype("<i8")
            rows = np.flatnonzero(usable)
            x = [whole[offsets[i] : offsets[i + 1]].tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(x, pa.binary())], names=["vec_id", "x"])

    rows = written(slim.mapInArrow(run, "vec_id long, x binary"), "whitening-rows")
    size = F.octet_length("x")
    common = rows.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.filter(size == (common[0]["size"] if common else 0))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """x, weight (rows that have it): written."""
    return written(rows.groupBy("x").agg(F.count("*").alias("weight")), "whitening-distinct")


def _blocks(batches: Iterator[pa.RecordBatch], name: str, kind: str, weighted: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of the vectors in column `name` and their weights, of a bounded number of entries."""
    for batch in batches:
        size = len(batch.column(name)[0].as_buffer()) // 8 if batch.num_rows else 0
        step = max(1, ENTRIES // max(size, 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            matrix = np.frombuffer(b"".join(part.column(name).to_pylist()), kind).reshape(part.num_rows, size)
            weights = part.column("weight").to_numpy().astype(np.int64)
            yield matrix, weights if weighted else np.ones_like(weights)


@dataclass(frozen=True)
class Centre:
    """The mean of integer vectors, total / n, kept exact: the nearest whole number and what is left, as n-ths."""

    n: int
    total: tuple[int, ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean."""
        base = [(2 * s + self.n) // (2 * self.n) for s in self.total]
        rest = np.array([(s - self.n * b) / self.n for s, b in zip(self.total, base)], np.float64)
        return (x - np.array(base, np.int64)).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[str]:
        """The sum over dimensions of (n x - total)^2, exact, in digits."""
        base = [s // self.n for s in self.total]
        rest = [s - self.n * b for s, b in zip(self.total, base)]
        off = x - np.array(base, np.int64)
        largest = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if len(base) * largest * largest < LARGEST:
            return [str(v) for v in ((self.n * off - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()]
        return [str(sum((self.n * a - r) ** 2 for a, r in zip(row, rest))) for row in off.tolist()]


def centre(distinct: DataFrame, weighted: bool = True) -> Centre:
    """Exact sums of all dimensions over the fit list: every row, or with weighted=False every distinct vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for x, weight in _blocks(batches, "x", "<i8", weighted):
            n += int(weight.sum())
            small = int(np.abs(x).max(initial=0)) * int(weight.sum()) < LARGEST
            own = weight @ x if small else weight.astype(object) @ x.astype(object)
            own = own.astype(object)
            total = own if total is None else total + own
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()), pa.array([str(n), *map(str, total)])], names=["k", "s"]
            )

    parts = distinct.mapInArrow(run, "k int, s string")
    sums = dict(parts.groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())  # a row per dimension
    n = int(sums.pop(-1, 0))
    return Centre(n, tuple(int(sums[k]) for k in sorted(sums)))


def centred_product(table: DataFrame, name: str, kind: str, minus: Callable[[np.ndarray], np.ndarray], n: int, weighted: bool = True) -> np.ndarray:
    """The covariance, divisor n, of the vectors of column `name` after `minus` took off their mean: a matrix product a
    block, added up by rows of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, weight in _blocks(batches, name, kind, weighted):
            off = minus(x)
            own = (off * weight[:, None]).T @ off
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total])], names=["k", "row"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        """One row of the matrix, from one part per task."""
        total = sum(np.frombuffer(r, np.float64) for r in rows["row"])
        return pd.DataFrame({"k": rows["k"][:1], "row": [total.tobytes()]})

    rows = table.mapInArrow(run, "k int, row binary").groupBy("k").applyInPandas(add, "k int, row binary").collect()
    return np.stack([np.frombuffer(r, np.float64) for _, r in sorted(map(tuple, rows))]) / n if rows else np.zeros((0, 0))


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    #: Components that have variance.
    live: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of some vectors, NaN where a component has no variance."""
        out = np.full((len(x), len(self.values)), np.nan)
        out[:, self.live] = self.centre.of(x) @ self.vectors[:, self.live] / np.sqrt(self.values[self.live])
        return out


def fit(distinct: DataFrame, most: int = COMPONENTS, weighted: bool = True) -> Whitening:
    """The components of largest variance, at most `most`; the entry of largest size of each is positive."""
    mean = centre(distinct, weighted)
    if not mean.n or not mean.total:
        none = np.zeros(0)
        return Whitening(mean, none, np.zeros((0, 0)), none, none.astype(bool))
    v = centred_product(distinct, "x", "<i8", mean.of, mean.n, weighted)
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = float(np.trace(v))
    live = values > len(v) * np.finfo(float).eps * max(trace, 0.0)
    return Whitening(mean, values, vectors, values / trace if trace > 0 else np.full(len(values), np.nan), live)


def whitened_vectors(distinct: DataFrame, model: Whitening) -> DataFrame:
    """x, weight, z (whitened components, binary doubles), deviation (digits) of each distinct vector: written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, deviation = [], []
            for x, _ in _blocks(iter([batch]), "x", "<i8", False):
                z += [r.tobytes() for r in model.apply(x)]
                deviation += model.centre.deviations(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("weight"), pa.array(z, pa.binary()), pa.array(deviation, pa.string())],
                names=["x", "weight", "z", "deviation"],
            )

    return written(distinct.mapInArrow(run, "x binary, weight long, z binary, deviation string"), "whitening-whitened")


def identity_error(whitened: DataFrame, model: Whitening, weighted: bool = True) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity, over components with variance."""
    n, live = model.centre.n, model.live

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(live.sum()))
        for z, weight in _blocks(batches, "z", "<f8", weighted):
            total += weight @ z[:, live]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "s"])

    if not live.any():
        return None
    rows = whitened.mapInArrow(sums, "k int, s double").groupBy("k").agg(F.sum("s")).collect()  # a row per component
    mean = np.array([s for _, s in sorted(map(tuple, rows))]) / n
    cov = centred_product(whitened, "z", "<f8", lambda z: z[:, live] - mean, n, weighted)
    return float(np.abs(cov - np.eye(len(cov))).max())


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS, weighted: bool = True
) -> tuple[DataFrame, Whitening, float | None]:
    """(vec_id, x, z, deviation per row; the model; identity_error). z is an array of doubles, null without variance."""
    rows = integer_vectors(embeddings, id_col, vector_col)
    distinct = distinct_vectors(rows)
    model = fit(distinct, most, weighted)
    done = whitened_vectors(distinct, model)
    error = identity_error(done, model, weighted)
    # a third of all rows may share a vector; adaptive execution splits such a partition of this join
    joined = rows.join(done.drop("weight"), "x")
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("z").to_pylist()), np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * count, pa.int32()), pa.array(flat, from_pandas=True))
            yield batch.set_column(batch.schema.get_field_index("z"), "z", lists)

    return joined.select("vec_id", "x", "z", "deviation").mapInArrow(run, "vec_id long, x binary, z array<double>, deviation string"), model, error


def _number(value: float | None) -> Column:
    return F.lit(None if value is None or np.isnan(value) else float(value)).cast("double")


def op12(spark, sf_dir: str) -> DataFrame:
    """deviation is null where it is beyond a long."""
    rows, model, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    explained = F.array(*map(_number, model.explained)).cast("array<double>")
    return rows.select("vec_id", F.posexplode("z").alias("at", "whitened"), "deviation").select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.centre.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"),
        _number(error).alias("identity_error"),
    )
