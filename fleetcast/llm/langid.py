"""Language ID with error-correcting output codes.

Every language has a codeword; for each bit one binary classifier over hashed byte trigrams tells the languages with that
bit from the others. Decoding takes the codeword of least loss, bits weighing by how well their classifier separates
the learned languages, and flags a document as ambiguous where the runner-up is nearly as near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, column, documents, give_back, held_out, pieces, text_bytes, with_columns_from_text, set_aside

#: Trigrams are hashed to 2^TABLE cells.
TABLE = 14
SMOOTHING = 0.5
#: Bytes of text whose trigrams are held in memory at a time.
BLOCK = 1 << 20
#: A document is ambiguous if the runner-up's codeword has less than this much more loss, of 1 for a usual bit.
MARGIN = 0.05
#: Longest codewords, and the languages up to which all possible bits are used.
MOST_BITS, ALL_BITS_UP_TO = 31, 5
UNKNOWN = "und"


def _folded() -> np.ndarray:
    """ASCII letters in lower case, bytes of longer characters as they are, all else a space."""
    fold = np.full(256, 32, np.uint8)
    fold[128:] = np.arange(128, 256)
    for low in range(ord("a"), ord("z") + 1):
        fold[[low, low - 32]] = low
    return fold


def trigram_blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position of the first, cells) for the trigrams that begin at each byte, block by block.

    Cell 2^TABLE marks trigrams that are white space or run out of their text.
    """
    fold, none, n = _folded(), 1 << TABLE, len(data)
    ends = offsets[1:]
    for at in range(0, n, BLOCK):
        end = min(at + BLOCK, n)
        b = np.full(end - at + 2, 32, np.uint32)
        b[: min(n, end + 2) - at] = fold[data[at : end + 2]]
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        cells = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE)).astype(np.int32)
        cells[code == 0x202020] = none
        for back in (1, 2):
            over = ends[(ends - back >= at) & (ends - back < end) & (ends - back >= offsets[:-1])] - back - at
            cells[over] = none
        yield at, cells


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1 (a row each), in which no bit is constant, repeated or another's complement."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= ALL_BITS_UP_TO:
        bits = [[1, *(1 if v >> k & 1 else -1 for k in range(n - 1))] for v in range((1 << (n - 1)) - 1)]
        return np.array(bits, np.int8).T
    best, far = None, -1
    for seed in range(50):  # the best of fixed random codes by the least distance of two codewords
        rng = np.random.default_rng(seed)
        code = rng.choice(np.array([-1, 1], np.int8), (n, min(MOST_BITS, 3 * n)))
        code = code[:, (code.max(axis=0) != code.min(axis=0))]
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if least > far:
            best, far = code, least
    return best


@dataclass(frozen=True)
class LanguageModel:
    """languages in order; code (languages, bits); weights (2^TABLE + 1, bits); scale and importance per bit."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    importance: np.ndarray

    def decode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, probability and ambiguity of each text."""
        n, bits = len(offsets) - 1, self.code.shape[1]
        sums, counts = np.zeros((n, bits)), np.zeros(n)
        for at, cells in trigram_blocks(data, offsets):
            inside = np.clip(offsets - at, 0, len(cells))
            seen = np.concatenate([[0], np.cumsum(cells < 1 << TABLE)])
            counts += np.diff(seen[inside])
            for b in range(bits):
                running = np.concatenate([[0.0], np.cumsum(self.weights[:, b][cells], dtype=np.float64)])
                sums[:, b] += np.diff(running[inside])
        margins = sums / np.maximum(counts, 1)[:, None] / self.scale
        loss = np.zeros((n, len(self.languages)))
        for c, word in enumerate(self.code):
            loss[:, c] = (np.log1p(np.exp(np.clip(-4 * margins * word, -50, 50))) * self.importance).sum(axis=1)
        best = loss.argmin(axis=1)
        odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * max(1, bits))
        score = 1 / odds.sum(axis=1)
        ranked = np.sort(loss, axis=1)
        near = ranked[:, 1] - ranked[:, 0] < MARGIN if len(self.languages) > 1 else np.zeros(n, bool)
        return best, score, near


def fit_counts(languages: tuple[str, ...], counts: np.ndarray) -> LanguageModel:
    """Naive Bayes log odds per bit; every language counts alike, however many documents it has."""
    smooth = counts + SMOOTHING
    given = smooth / smooth.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros(((1 << TABLE) + 1, code.shape[1]), np.float32)
    scale = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        up, down = given[code[:, b] > 0].mean(axis=0), given[code[:, b] < 0].mean(axis=0)
        weights[:-1, b] = np.log(up / down)
        expected = (given @ weights[:-1, b].astype(np.float64)) * code[:, b]
        scale[b] = max(expected.mean(), 1e-6)
    importance = scale / scale.sum() if len(scale) else scale
    return LanguageModel(languages, code, weights, scale, importance)


def fit(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, lang_col: str = "lang") -> LanguageModel:
    """Trigram counts per language over all texts of learnable rows: a language that is not null, an id that is not held out."""
    rows = docs.select(column(text_col).cast("binary").alias("text"), column(lang_col).cast("string").alias("lang")).filter(
        ~held_out(column(id_col)) & column(lang_col).isNotNull() & column(text_col).isNotNull()
    )
    size = 1 << TABLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                own = np.array([names.index(x) for x in langs], np.int32)
                counts = np.zeros(len(names) * (size + 1), np.int64)
                for at, cells in trigram_blocks(data, offsets):
                    lengths = np.diff(np.clip(offsets - at, 0, len(cells)))
                    counts += np.bincount(np.repeat(own, lengths) * (size + 1) + cells, minlength=len(counts))
                for name, row in zip(names, counts.reshape(len(names), size + 1), strict=True):
                    sums[name] = sums.get(name, 0) + row[:size]
        for name, row in sums.items():
            (cells,) = np.nonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(row[cells])],
                names=["lang", "cell", "n"],
            )
        give_back()

    # at most 2^TABLE rows a language reach the driver
    found = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    # a language whose learnable texts have no trigram is still a value to predict
    named = {r[0] for r in docs.filter(~held_out(column(id_col)) & column(lang_col).isNotNull()).select(column(lang_col).cast("string")).distinct().collect()}
    languages = tuple(sorted(named))
    counts = np.zeros((len(languages), size))
    at = {x: i for i, x in enumerate(languages)}
    own = np.array([at[x] for x in found.column("lang").to_pylist()], np.int64)
    counts[own, found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return fit_counts(languages, counts)


def _predictions(model: LanguageModel) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    def work() -> Callable[[pa.Array], list[pa.Array]]:
        def lettered(text: bytes | None) -> bool:
            return text is not None and any(map(str.isalpha, text.decode("utf-8", "replace")))

        def made(texts: pa.Array) -> list[pa.Array]:
            known = np.array([lettered(t) for t in texts.to_pylist()], bool)
            if not model.languages:
                return [pa.array([UNKNOWN] * len(texts)), pa.array(np.zeros(len(texts))), pa.array(np.zeros(len(texts), bool))]
            best, score, near = model.decode(*text_bytes(texts))
            names = np.array(model.languages, object)[best]
            names[~known] = UNKNOWN
            return [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(near & known)]

        return made

    return work


def identify(docs: DataFrame, model: LanguageModel, text_col: str = TEXT, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with __lang (`und` for a null text or one without a letter), __score (0 for those) and __ambiguous.

    Whole texts count; ties between codewords go to the language first by name. With nothing learned all are `und`.
    """
    return with_columns_from_text(docs, text_col, {"__lang": "string", "__score": "double", "__ambiguous": "boolean"}, _predictions(model), drop)


def in_known_language(docs: DataFrame, model: LanguageModel, text_col: str = TEXT) -> DataFrame:
    """docs, columns of whatever names as they were, without those rejected: no language to be told, or one that is ambiguous.

    A model that learned no language rejects every document.
    """

    def work(rows: DataFrame) -> DataFrame:
        found = identify(rows, model, text_col)
        return found.filter((F.col("__lang") != UNKNOWN) & ~F.col("__ambiguous")).select(*[column(c) for c in rows.columns])

    return set_aside(docs, work, text_col)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(ID, TEXT, "lang")
    found = identify(docs.drop("lang"), fit(docs), drop=(TEXT,))
    return found.select(
        ID, held_out(F.col(ID)).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"),
        F.col("__ambiguous").alias("ambiguous"),
    )
