"""Benchmark decontamination: an FM-index per shard of the training texts, searched backwards for the windows of benchmark items.

A task cuts its documents into shards of a few megabytes, indexes each (see fmindex), searches all windows in it at once, locates
the occurrences, and merges them into the spans to remove. Words that no window has can't be in an occurrence; they part the runs
that are indexed. Documents are never exchanged. The windows are sent to the tasks in blocks of bounded size; with more than one
block the documents pass through once per block.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z were lower-cased. A window is `width` consecutive words of an item, or all of
an item of fewer. Null texts have no words, items without words no windows. A null item_id counts as the item ''; rows that repeat an
item_id are one item. Repeated documents each give a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, column, documents, free_name, id_and_text, text_bytes, with_columns_from_text
from fleetcast.llm.fmindex import Index
from fleetcast.session import written

WIDTH = 10
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Pairs of a window and an item that are sent to the tasks at once (about 100 bytes each), and bytes of a long text that are indexed at once.
BLOCK, SLICE = 1 << 17, 4 << 20
SPAN = "struct<start:bigint,end:bigint,from_byte:bigint,to_byte:bigint>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def windows(benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, words: the distinct windows of each item."""
    lowered = F.translate(column(text_col).cast("string"), UPPER, UPPER.lower())
    items = benchmark.select(
        F.coalesce(column(item_col).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lowered, F.lit(PATTERN), F.lit(0)).alias("all")
    ).filter("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - width + 1, F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, width))).alias("words")).distinct()


@dataclass(frozen=True)
class Phrases:
    """A block of windows for the tasks: vocabulary, windows as word numbers (aligned right), and their items."""

    vocabulary: list[bytes]
    phrases: np.ndarray
    lengths: np.ndarray
    first_item: np.ndarray
    items: np.ndarray
    names: list[str]

    @staticmethod
    def of(pairs: list[tuple[str, list[str]]], width: int) -> Phrases:
        vocabulary = sorted({w for _, words in pairs for w in words})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        names = sorted({item for item, _ in pairs})
        rank = {item: i for i, item in enumerate(names)}
        own: dict[tuple[str, ...], set[int]] = {}
        for item, words in pairs:
            own.setdefault(tuple(words), set()).add(rank[item])
        phrases = np.full((len(own), width), -1, np.int64)
        for row, words in zip(phrases, own):
            row[width - len(words) :] = [number[w] for w in words]
        counts = np.array([len(v) for v in own.values()], np.int64)
        return Phrases(
            [w.encode() for w in vocabulary], phrases, (phrases >= 0).sum(axis=1), np.concatenate([[0], np.cumsum(counts)]),
            np.array([i for v in own.values() for i in sorted(v)], np.int64), names,
        )


def _slices(data: np.ndarray, ends: np.ndarray, wordy: np.ndarray, overlap: int) -> Iterator[tuple[int, int, int]]:
    """Byte ranges (from, to, words of the overlap) of the texts: all at once, or a single long text in slices that share `overlap` words."""
    n = len(data)
    if n <= 2 * SLICE or len(ends) > 1:
        yield 0, n, 0
        return
    at, shared = 0, 0
    while True:
        to = min(at + SLICE, n)
        to += int(np.argmin(wordy[to:])) if to < n else 0  # the last byte is in no word
        yield at, to, shared
        if to >= n:
            return
        starts = np.flatnonzero(wordy[at:to] & ~np.concatenate([[False], wordy[at : to - 1]]))
        shared = min(overlap, len(starts) - 1) if len(starts) else 0
        at = at + int(starts[-shared]) if shared else to


def _marked(texts: pa.Array, known: Phrases) -> list[pa.Array]:
    """n_words, n_hit, spans and items of some texts."""
    raw, offsets = text_bytes(texts)
    n = len(texts)
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    is_word = np.zeros(256, bool)
    is_word[48:58] = is_word[97:123] = is_word[128:] = True
    # a byte that is in no word after every text
    data = table[np.insert(raw, offsets[1:], 0)] if len(raw) else np.zeros(n, np.uint8)
    bounds = offsets + np.arange(n + 1)
    wordy = is_word[data]
    longest, shortest = (int(known.lengths.max()), int(known.lengths.min())) if len(known.lengths) else (1, 1)
    vocabulary = pa.array(known.vocabulary, pa.binary())
    n_words, spans, hits, done = np.zeros(n, np.int64), [], [], 0
    for low, high, shared in _slices(data, bounds[1:], wordy, longest - 1):
        edges = np.flatnonzero(np.diff(wordy[low:high].view(np.int8), prepend=0, append=0))
        starts, ends = edges[::2] + low, edges[1::2] + low
        doc = np.searchsorted(bounds, starts, side="right") - 1
        n_words += np.bincount(doc, minlength=n)
        if shared:
            n_words[0] -= shared
        done -= shared
        if len(known.phrases) and len(starts):
            at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[low:high][wordy[low:high]])])
            numbers = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            phrase, first = _found(numbers, doc, known, longest, shortest)
            last = first + known.lengths[phrase]
            own = doc[first]
            spans.append(np.stack([own, first + done, last + done, starts[first] - bounds[own], ends[last - 1] - bounds[own]]))
            hits.append(np.unique(own * len(known.phrases) + phrase))
        done += len(starts)
    one = _merged(np.concatenate(spans, axis=1) if spans else np.zeros((5, 0), np.int64))
    # words are numbered inside their text
    before = np.cumsum(n_words) - n_words
    own, first, last, from_byte, to_byte = one
    fields = [pa.array(x) for x in (first - before[own], last - before[own], from_byte, to_byte)]
    span_list = pa.ListArray.from_arrays(_offsets(own, n), pa.StructArray.from_arrays(fields, ["start", "end", "from_byte", "to_byte"]))
    pair = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
    holder, phrase = np.divmod(pair, max(len(known.phrases), 1))
    times = (known.first_item[1:] - known.first_item[:-1])[phrase]
    item = known.items[np.repeat(known.first_item[phrase] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
    holder, item = np.divmod(np.unique(np.repeat(holder, times) * max(len(known.names), 1) + item), max(len(known.names), 1))
    item_list = pa.ListArray.from_arrays(_offsets(holder, n), pa.array(known.names, pa.string()).take(pa.array(item)))
    n_hit = np.bincount(own, weights=last - first, minlength=n).astype(np.int64)
    return [pa.array(n_words), pa.array(n_hit), span_list, item_list]


def _offsets(own: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32))


def _found(numbers: np.ndarray, doc: np.ndarray, known: Phrases, longest: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (phrase, first word) in the index of all runs of known words of one text that are as long as the shortest phrase."""
    has = np.concatenate([[False], numbers > 0, [False]])
    same = np.concatenate([[False], doc[1:] == doc[:-1], [False]])  # the word before is of this text
    starts = np.flatnonzero(has[1:-1] & ~(has[:-2] & same[:-1]))
    ends = np.flatnonzero(has[1:-1] & ~(has[2:] & same[1:])) + 1
    long_ = ends - starts >= shortest
    starts, ends = starts[long_], ends[long_]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the shard's own alphabet
    inside = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    present = np.zeros(len(known.vocabulary) + 1, bool)
    present[numbers[np.cumsum(inside[:-1]) > 0]] = True
    present[0] = False
    local = np.where(present, np.cumsum(present), 0)
    phrases = np.where(known.phrases < 0, -1, local[np.maximum(known.phrases, 0)])
    possible = np.flatnonzero((phrases != 0).all(axis=1))
    index = Index(local[numbers], starts, ends, int(present.sum()), longest)
    which, first = index.search(phrases[possible])
    return possible[which], first


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans (text, first, last, from, to) that overlap or touch inside a text as one."""
    if not spans.shape[1]:
        return spans
    spans = spans[:, np.lexsort((spans[2], spans[1], spans[0]))]
    reach = np.maximum.accumulate(spans[2])  # words are numbered on from text to text
    new = np.concatenate([[True], (spans[1, 1:] > reach[:-1]) | (spans[0, 1:] != spans[0, :-1])])
    at = np.flatnonzero(new)
    return np.stack([spans[0, at], spans[1, at], np.maximum.reduceat(spans[2], at), spans[3, at], np.maximum.reduceat(spans[4], at)])


def _blocks(benchmark: DataFrame, width: int, block: int) -> list[Broadcast]:
    """The windows in blocks of about `block` pairs, parted by a hash; one block, without pairs, of an empty benchmark."""
    pairs = written(windows(benchmark, width), "benchmark-windows")
    parts = max(1, -(-pairs.count() // block))
    sent = []
    for k in range(parts):
        rows = pairs.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k)
        known = Phrases.of([(item, words) for item, words in rows.collect()], width)  # about `block` rows
        sent.append(benchmark.sparkSession.sparkContext.broadcast(astuple(known)))
    return sent


def _searching(shared: Broadcast) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    def work() -> Callable[[pa.Array], list[pa.Array]]:
        known = Phrases(*shared.value)
        return lambda texts: _marked(texts, known)

    return work


def _joined(spans: Column) -> Column:
    """The sorted spans of several blocks, merged."""

    def add(done: Column, one: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], one["end"]).alias("end"),
            last["from_byte"].alias("from_byte"), F.greatest(last["to_byte"], one["to_byte"]).alias("to_byte"),
        )
        apart = (F.size(done) == 0) | (F.get(done, F.size(done) - 1)["end"] < one["start"])
        return F.when(apart, F.concat(done, F.array(one))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN}>"), add)


def with_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = TEXT, width: int = WIDTH, block: int = BLOCK, keep_text: bool = True
) -> tuple[DataFrame, dict[str, str]]:
    """docs with what was found, and the names of the added columns (such that they clash with none): n_words, n_hit (words inside
    an occurrence), spans (merged; words from `start` up to `end`, bytes of the UTF-8 text alike), items (ids, sorted)."""
    names = {c: free_name(docs, c) for c in ("n_words", "n_hit", "spans", "items")}
    found, spans, items = docs, [], []
    blocks = _blocks(benchmark, width, block)
    for k, shared in enumerate(blocks):
        last = k == len(blocks) - 1
        own = {c: free_name(found, f"{c}_{k}") for c in names}
        spans.append(own["spans"])
        items.append(own["items"])
        added = {own["n_words"]: "bigint", own["n_hit"]: "bigint", own["spans"]: f"array<{SPAN}>", own["items"]: "array<string>"}
        found = with_columns_from_text(found, text_col, added, _searching(shared), () if keep_text or not last else (text_col,))
        if not last:
            found = found.drop(own["n_words"])
        found = found.withColumnRenamed(own["n_words"], names["n_words"]) if last else found
        found = found.drop(own["n_hit"]) if len(blocks) > 1 else found.withColumnRenamed(own["n_hit"], names["n_hit"])
    kept = [column(c) for c in docs.columns if keep_text or c != text_col]
    if len(blocks) == 1:
        every, which, hit = column(spans[0]), column(items[0]), column(names["n_hit"])
    else:
        every = _joined(F.flatten(F.array(*map(column, spans))))
        which = F.array_sort(F.array_distinct(F.flatten(F.array(*map(column, items)))))
        found = found.withColumn(free_name(found, "joined"), every)
        every = column(found.columns[-1])
        hit = F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        *kept, column(names["n_words"]), hit.alias(names["n_hit"]), every.alias(names["spans"]), which.alias(names["items"])
    ), names


def removal_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = ID, text_col: str = TEXT, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items per document (see with_hits)."""
    return with_hits(id_and_text(docs, id_col, text_col), benchmark, TEXT, width, block, keep_text=False)[0]


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = TEXT, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """docs, columns as they were, with the spans cut out of the texts; texts without a hit, null ones too, stay as they are."""
    found, names = with_hits(docs, benchmark, text_col, width, block)
    data, spans = column(text_col).cast("binary"), column(names["spans"])
    size = F.octet_length(data).cast("long")
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["to_byte"]))
    tos = F.concat(F.transform(spans, lambda s: s["from_byte"]), F.array(size))
    parts = F.zip_with(froms, tos, lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    text = F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(column(text_col))
    return found.withColumn(text_col, text).select(*[column(c) for c in docs.columns])


def op13(spark, sf_dir: str) -> DataFrame:
    found = removal_spans(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        ID, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + PATTERN + "')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({WIDTH}, len(w)) AS n, array_to_string(w[i:i + least({WIDTH}, len(w)) - 1], ' ') AS phrase
       FROM b, unnest(range(1, greatest(len(w) - {WIDTH}, 0) + 2)) t(i) WHERE len(w) > 0),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
       FROM (SELECT r, w, n FROM d, (SELECT DISTINCT n FROM bw) l) x, unnest(range(1, len(w) - n + 2)) t(i)),
h AS (SELECT DISTINCT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM h) x, unnest(range(i, i + n)) t(p) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) x GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.r = hw.r LEFT JOIN hi ON d.r = hi.r
"""
