"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every cell of a hashed vocabulary has a sparse random index vector; a word's vector is the sum of the index vectors of
its neighbours over the whole corpus. Words are read in two streams, letters in lower case and marks (case pattern and other
characters), each with vectors of its own. A document is the mean of its words' vectors, their lengths, and a few figures of
the text. The network is fitted with numpy on a bounded sample of labelled rows; one temperature sets its probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, as_list, column, documents, held_out, id_and_text, pieces, with_columns_from_text
from fleetcast.session import written

#: Cells of the vocabulary of words and of marks; their vectors are a table of fixed size.
WORDS, MARKS = 1 << 14, 1 << 12
DIMENSIONS, NONZERO, WINDOW = 32, 2, 2
#: Words of a document handled at a time.
RUN = 1 << 18
#: Labelled rows the network is fitted on at most, the first by the hash of their id.
MOST_LABELLED = 20_000
HIDDEN, ROUNDS, BATCH, RATE, DECAY, THRESHOLD = 32, 60, 256, 3e-3, 1e-4, 0.7
#: Entries of a task's memory for words; a full one is emptied. Only speed depends on it.
MEMORY = 300_000
#: Longer words aren't remembered, so the memory is bounded in bytes too.
LONGEST = 64


class Cells(dict):
    """Word to the number of its cell and that of its marks' cell: word * MARKS + mark."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        letters = "".join(filter(str.isalpha, word))
        rest = "".join("9" if c.isdigit() else c for c in word if not c.isalpha())[:6]
        case = "U" if letters.isupper() and len(letters) > 1 else "T" if letters[:1].isupper() else "l" if letters else ""
        low = letters.lower()
        found = zlib.crc32(low.encode()) % WORDS * MARKS + zlib.crc32(f"{case}{rest}".encode()) % MARKS
        if len(word) <= LONGEST:
            self[word] = found
        return found


def _runs(text: bytes, cells: Cells) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells of the words and of the marks of a text, RUN words at a time."""
    words = text.decode("utf-8", "replace").split()
    for at in range(0, len(words), RUN):
        part = words[at : at + RUN]
        both = np.fromiter(map(cells.__getitem__, part), np.int64, len(part))
        yield both // MARKS, both % MARKS


def index_vectors(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse random vectors: the places of the NONZERO entries of each cell, and their signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMENSIONS, (size, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (size, NONZERO))


def word_vectors(docs: DataFrame, text_col: str = TEXT) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all cells, words then marks, from the neighbours in all texts: WORDS + MARKS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells()
        drawn = index_vectors(WORDS, 1), index_vectors(MARKS, 2)
        sums = np.zeros(WORDS * DIMENSIONS), np.zeros(MARKS * DIMENSIONS)
        for batch in batches:
            for part in pieces(batch, "text"):
                held: list[tuple[np.ndarray, np.ndarray]] = []
                for text in as_list(part.column("text")):
                    held += _runs(text, cells)
                if not held:
                    continue
                for stream, (places, signs) in enumerate(drawn):
                    size = len(places)
                    gap = np.full(WINDOW, size)  # no window spans it, so texts can be counted together
                    joined = np.concatenate([x for h in held for x in (h[stream], gap)])
                    _add_contexts(sums[stream], joined, places, signs)
        for first, size, flat in ((0, WORDS, sums[0]), (WORDS, MARKS, sums[1])):
            rows = flat.reshape(size, DIMENSIONS)
            (used,) = np.nonzero(np.abs(rows).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used + first)] + [pa.array(rows[used, d]) for d in range(DIMENSIONS)], names=["cell", *names]
            )

    names = [f"v{d}" for d in range(DIMENSIONS)]
    texts = docs.select(column(text_col).cast("binary").alias("text"))
    kind = "cell long, " + ", ".join(f"{v} double" for v in names)
    # sums of whole numbers: the same in any order
    found = texts.mapInArrow(run, kind).groupBy("cell").agg(*[F.sum(v).alias(v) for v in names]).toArrow()
    table = np.zeros((WORDS + MARKS, DIMENSIONS))
    if found.num_rows:
        table[found.column("cell").to_numpy()] = np.column_stack([found.column(v).to_numpy() for v in names])
    return _unit(table[:WORDS]), _unit(table[WORDS:])


def _add_contexts(sums: np.ndarray, stream: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to each cell's sum the index vectors of its neighbours; the number after the last cell parts texts and adds nothing."""
    none = len(places)
    places = np.vstack([places, np.zeros((1, NONZERO), places.dtype)])
    signs = np.vstack([signs, np.zeros((1, NONZERO))])
    for at in range(0, len(stream), RUN):
        end = min(at + RUN, len(stream))
        for gap in range(1, WINDOW + 1):
            # pairs whose right word lies in this run
            right = stream[max(at, gap) : end]
            left = stream[max(at, gap) - gap : end - gap]
            for word, other in ((left, right), (right, left)):
                for k in range(NONZERO):
                    cells = word * DIMENSIONS + places[other, k]
                    sums += np.bincount(cells, signs[other, k], minlength=(none + 1) * DIMENSIONS)[: len(sums)]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors, after the direction that all words share is taken out."""
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)
    used = lengths[:, 0] > 0
    if used.any():
        rows[used] -= rows[used].mean(axis=0)
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)
    return rows.astype(np.float32)


#: Figures of a document besides the two pooled vectors: their lengths, log of words, share of a word that repeats the one before, of unlike words.
EXTRA = 5
FEATURES = 2 * DIMENSIONS + EXTRA


def pooled(text: bytes, cells: Cells, words: np.ndarray, marks: np.ndarray) -> np.ndarray:
    sums, n, repeats, seen = np.zeros((2, DIMENSIONS)), 0, 0, np.zeros(0, np.int64)
    for own, own_marks in _runs(text, cells):
        n += len(own)
        for at in range(0, len(own), 1 << 15):
            sums[0] += words[own[at : at + (1 << 15)]].sum(axis=0, dtype=np.float64)
            sums[1] += marks[own_marks[at : at + (1 << 15)]].sum(axis=0, dtype=np.float64)
        repeats += int((own[1:] == own[:-1]).sum())
        seen = np.union1d(seen, own)
    mean = sums / max(n, 1)
    extra = [*np.linalg.norm(mean, axis=1), np.log1p(n), repeats / max(n, 1), len(seen) / max(n, 1)]
    return np.concatenate([*mean, extra])


def with_features(docs: DataFrame, vectors: tuple[np.ndarray, np.ndarray], text_col: str = TEXT, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with __features, an array of FEATURES floats; a null or empty text pools to zeros. The vectors have a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def work() -> Callable[[pa.Array], list[pa.Array]]:
        cells = Cells()

        def made(texts: pa.Array) -> list[pa.Array]:
            rows = [pooled(t, cells, *shared.value).astype(np.float32) for t in as_list(texts)]
            return [pa.array(rows, pa.list_(pa.float32()))]

        return made

    return with_columns_from_text(docs, text_col, {"__features": "array<float>"}, work, drop)


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((rows - self.mean) / self.spread, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows) / self.temperature, -30, 30)))


def fit_network(rows: np.ndarray, labels: np.ndarray, held: np.ndarray) -> Network:
    """Adam on the log loss of the rows not `held`; the temperature is the one of least log loss on the held ones.

    Without rows of both labels the network says the share of label 1, or one half with no rows at all.
    """
    width = rows.shape[1] if rows.ndim == 2 and len(rows) else FEATURES
    if len(set(labels.tolist())) < 2:
        p = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        flat = (np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
        return Network(np.zeros(width), np.ones(width), flat, 1.0)
    if len(set(labels[~held].tolist())) < 2:
        held = np.zeros(len(labels), bool)
    mean, spread = rows[~held].mean(axis=0), rows[~held].std(axis=0) + 1e-6
    x, y = np.clip((rows[~held] - mean) / spread, -8, 8), labels[~held].astype(np.float64)
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(ROUNDS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            h = np.tanh(x[own] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[own]) / len(own)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[own].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    found = Network(mean, spread, (p[0], p[1], p[2], float(p[3][0])), 1.0)
    if not held.any():
        return found
    z, t = found.logits(rows[held]), labels[held]
    losses = {k: np.logaddexp(0, -np.where(t == 1, 1, -1) * z / k).mean() for k in np.geomspace(0.25, 8, 61)}
    return Network(mean, spread, found.layers, float(min(losses, key=losses.get)))


def fit(features: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Network:
    """From `features` (doc_id, __features) and `labels` (doc_id, quality), learnable rows only.

    A document with several labels is good if all say so. At most `most` of them are used, the first by the hash of their id,
    and a fifth of those sets the temperature.
    """
    known = labels.filter(~held_out(F.col(ID)) & F.col("quality").isNotNull())
    sample = known.groupBy(ID).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(ID), ID).limit(most)
    rows = features.join(sample, ID).dropDuplicates([ID])
    got = rows.select(ID, "__features", "quality", (F.pmod(F.xxhash64(ID, F.lit(5)), F.lit(5)) == 0).alias("held")).orderBy(ID).toArrow()
    if not got.num_rows:
        return fit_network(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, bool))
    x = np.asarray(got.column("__features").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
    return fit_network(x.reshape(got.num_rows, FEATURES), got.column("quality").to_numpy(), got.column("held").to_numpy(zero_copy_only=False).astype(bool))


def score(features: DataFrame, network: Network) -> DataFrame:
    """features with __score in place of __features."""
    kept = [f for f in features.schema if f.name != "__features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("__features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, FEATURES)
            columns = [batch.column(f.name) for f in kept] + [pa.array(network.score(flat.astype(np.float64)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "__score"])

    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["__score double"])
    return features.mapInArrow(run, kind)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Only whole texts are inputs of a score."""
    texts = id_and_text(docs, id_col, text_col)
    features = written(with_features(texts, word_vectors(texts), drop=(TEXT,)), "quality-features")
    scored = score(features, fit(features, labels))
    return scored.select(
        ID, held_out(F.col(ID)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
