"""The conversation trie, the whitening and the decontamination against plain Python, on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry_module
from fleetcast.llm import decontaminate, trie, whitening
from fleetcast.llm.fmindex import Index

# Trie -------------------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, path string, n string"


def conversation_rows() -> list[tuple]:
    """Copies of one conversation over many ids, shared heads, null and repeated turns, ids that miss their family's first."""
    rng = random.Random(5)
    rows = []
    hot = [("user", "how are you today"), ("assistant", "well thank you"), ("user", "bye now")]
    for c in list(range(0, 140)) + [205, 206, 399, 10**12 + 3, -3, -21, -40]:
        if c % 3 == 0:
            own = hot[: rng.randint(1, 3)] if c % 2 else hot
        else:
            own = [(rng.choice(["user", None, ""]), rng.choice(["a", "a b", "", None, " x\ty "])) for _ in range(rng.randint(1, 6))]
        rows += [(c, t if rng.random() < 0.97 else None, r, x) for t, (r, x) in enumerate(own)]
    rows += [rows[5]] * 3 + [(None, 1, "user", "lost"), (40, 1, "tie", "one"), (40, 1, "tie", "two")]
    rows += [(77, t, "user", f"long {t}") for t in range(100, 400)]
    rng.shuffle(rows)
    return [(*r, "p", "n") for r in rows]


def plain_trie(rows: list[tuple]) -> set[tuple]:
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
            own[c].append(((t is not None, t or 0, key), (r, x)))
    own = {c: [turn for _, turn in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(math.fmod(c, 20))
        rebuilt[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(ms) - 1) * words
    return {
        (
            min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(ms) if rebuilt[c] == p).encode()).hexdigest(),
        )
        for p, ms in members.items()
    }


@pytest.mark.parametrize("shard_turns", [1, 40, 100_000])
def test_trie_equals_plain_python(spark, shard_turns):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(6)
    found = trie.prefix_trie(table, shard_turns=shard_turns)
    got = [tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    want = plain_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


# Whitening --------------------------------------------------------------------------------------------

EMBEDDINGS = "vec_id long, embedding array<float>, label int, x string, z string"


def plain_whitening(vectors: dict[int, list[list[float]]]) -> tuple[dict, np.ndarray, int]:
    x = {i: [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vs] for i, vs in vectors.items()}
    fit = [v for vs in x.values() for v in vs]
    n, total = len(fit), [sum(col) for col in zip(*fit)]
    deviation = {i: sorted(sum((n * a - s) ** 2 for a, s in zip(v, total)) for v in vs) for i, vs in x.items()}
    exact = np.array([[a - 1_000_000 for a in v] for v in fit], float)
    off = exact - exact.mean(axis=0)
    return deviation, off.T @ off / n, n


def test_whitening_equals_plain_python(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * 0.3
    hot = base[0]
    usable = [(i, [float(np.float32(c)) for c in (hot if i % 3 == 0 else base[i])]) for i in range(300)]
    usable += [usable[4]] * 2 + [(None, usable[5][1])]
    spoilt = [(900, None), (901, [None] * 40), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] * 40), (904, [1.0] * 39), (905, [])]
    table = spark.createDataFrame([(*r, 1, "x", "z") for r in usable + spoilt], EMBEDDINGS).repartition(4)
    table.write.mode("overwrite").parquet(path := _new_folder(spark) + "/embeddings.parquet")
    rows = entry_module.queries()["op12_multiplicity_whitening"](spark, path.rsplit("/", 1)[0]).collect()
    vectors = defaultdict(list)
    for i, v in usable:
        vectors[i].append(v)
    deviation, cov, n = plain_whitening(vectors)
    assert len(rows) == 32 * len(usable) and {r.n for r in rows} == {n}
    values = np.linalg.eigvalsh(cov)[::-1]
    for k in range(1, 33):
        own = [r for r in rows if r.component == k]
        assert Counter(r.vec_id for r in own) == Counter(i for i, _ in usable)
        assert own[0].explained == pytest.approx(values[k - 1] / np.trace(cov), rel=1e-6)
        assert {i: sorted(r.deviation for r in own if r.vec_id == i) for i in vectors} == deviation
        z = np.array([r.whitened for r in own])
        assert abs(z.mean()) < 1e-8 and z.var() == pytest.approx(1, abs=1e-8)
    error = {r.identity_error for r in rows}
    assert len(error) == 1 and 0 <= error.pop() < 1e-8
    # the whitened values are projections on eigenvectors, either sign
    x = np.floor(64 * np.array([usable[1][1]], np.float32).astype(float))[0]
    fit = np.floor(64 * np.array([v for _, v in usable], np.float32).astype(float))
    _, vectors_ = np.linalg.eigh(cov)
    for r in (r for r in rows if r.vec_id == 1):
        want = (x - fit.mean(axis=0)) @ vectors_[:, -r.component] / math.sqrt(values[r.component - 1])
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)


def test_whitening_weights_of_one(spark):
    """Every distinct vector counts once: copies don't change the fit."""
    vectors = [[0.0, 1.0], [1.0, 0.0], [3.0, 2.0]]
    copies = spark.createDataFrame([(i, v, 1, "x", "z") for i, v in enumerate(vectors + [vectors[0]] * 20)], EMBEDDINGS)
    once = spark.createDataFrame([(i, v, 1, "x", "z") for i, v in enumerate(vectors)], EMBEDDINGS)
    one, two = whitening.whiten(copies, weighted=False)[1], whitening.whiten(once)[1]
    assert one.centre == two.centre and np.allclose(one.values, two.values)


def test_whitening_without_variance_or_rows(spark):
    still = spark.createDataFrame([(i, [1.0, 3e38, float(i)], 1, "x", "z") for i in range(4)], EMBEDDINGS)
    rows, model, error = whitening.whiten(still)
    assert model.live.tolist() == [True, False, False] and error < 1e-9
    assert all(r.z[0] is not None and r.z[1] is None and r.z[2] is None for r in rows.collect())
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 1, "x", "z") for i in range(3)], EMBEDDINGS))
    assert same[2] is None and [r.deviation for r in same[0].collect()] == ["0"] * 3
    for rows in ([], [(1, None, 1, "x", "z"), (2, [], 1, "x", "z")]):
        found, _, error = whitening.whiten(spark.createDataFrame(rows, EMBEDDINGS))
        assert error is None and all(r.z == [] for r in found.collect())


def test_exact_deviations_beyond_a_long():
    x = np.array([[10**12, 5], [-(10**12), 6]], np.int64)
    centre = whitening.Centre(10**7, (17 * 10**7 + 3, -5))
    want = [str(sum((10**7 * a - s) ** 2 for a, s in zip(row, centre.total))) for row in x.tolist()]
    assert centre.deviations(x) == want


# Decontamination --------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCHMARK = "item_id long, text string, words string"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").encode().lower().decode())


def plain_hits(texts: list, items: list[tuple], width: int) -> list[tuple]:
    held = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            held[tuple(w[i : i + n])].add("" if item is None else str(item))
    found = []
    for text in texts:
        w, hit, names = words_of(text), set(), set()
        for n in {len(k) for k in held}:
            for i in range(len(w) - n + 1):
                if (own := held.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= own
        found.append((len(w), len(hit), sorted(names)))
    return found


def leak_rows(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    vocabulary = [f"{w}{i}" for w in ("aé", "B", "cc") for i in range(rng.choice([1, 2, 12]))]

    def prose(n: int) -> str:
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ". ", "-", "\n"]) for _ in range(n))

    items = [(i, prose(rng.choice([1, 3, 9, 10, 14, 40]))) for i in range(8)] + [(None, prose(11)), (3, prose(12)), (50, None), (51, " .,")]
    texts = [prose(rng.randint(0, 80)) for _ in range(30)] + [None, "", "..", "unseen words only"]
    texts += [prose(9) + items[k % 8][1].upper() + " " + prose(9) for k in range(24)] + [items[5][1] * 40] * 3 + [prose(4000)]
    return texts, items


@pytest.mark.parametrize(("seed", "width", "block"), [(1, 10, 1 << 17), (2, 4, 9), (3, 10, 25)])
def test_hits_equal_plain_python(spark, seed, width, block):
    texts, items = leak_rows(seed)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
    benchmark = spark.createDataFrame([(*i, "w") for i in items], BENCHMARK)
    rows = {r.doc_id: r for r in decontaminate.removal_spans(docs, benchmark, width=width, block=block).collect()}
    for i, want in enumerate(plain_hits(texts, items, width)):
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == want
        own, raw = words_of(texts[i]), (texts[i] or "").encode()
        assert sum(s.end - s.start for s in rows[i].spans) == want[1]
        for s in rows[i].spans:
            assert words_of(raw[s.from_byte : s.to_byte].decode()) == own[s.start : s.end]
        assert all(a.end < b.start for a, b in zip(rows[i].spans, rows[i].spans[1:]))


def test_spans_are_cut_out(spark):
    texts, items = leak_rows(4)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    benchmark = spark.createDataFrame([(*i, "w") for i in items], BENCHMARK)
    cut = decontaminate.without_spans(docs, benchmark)
    assert cut.columns == docs.columns
    after = {r.doc_id: r.text for r in cut.collect()}
    for i, (n, hit, _) in enumerate(plain_hits(texts, items, 10)):
        assert (after[i] == texts[i]) if not hit else len(words_of(after[i])) in (n - hit, n - hit + 1)
    assert all(r.spans == "s" for r in cut.collect())


def test_a_long_text_is_indexed_in_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "SLICE", 700)
    texts, items = leak_rows(6)
    pairs = [(str(i), words_of(t)[k : k + 6]) for i, t in items for k in range(max(len(words_of(t)) - 5, 1)) if words_of(t)]
    text = "".join(t or "" for t in texts) + "x" * 3000
    n_words, n_hit, _, names = decontaminate._marked(pa.array([text.encode()]), decontaminate.Phrases.of(pairs, 6))
    assert (n_words[0].as_py(), n_hit[0].as_py(), names[0].as_py()) == plain_hits([text], [(str(i), t) for i, t in items], 6)[0]


def test_index_finds_every_place():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 4, 5000)
    words[2000:2600] = words[1000:1600]  # a long repeat
    index = Index(words, np.array([0, 3000]), np.array([2900, 5000]), 3, 6)
    phrases = np.array([[-1, -1, 1, 2, 3, 1], [1, 1, 1, 1, 1, 1], [-1, -1, -1, -1, -1, 2], [3, 2, 1, 3, 2, 1]])
    which, first = index.search(phrases)
    for k, phrase in enumerate(phrases):
        own = phrase[phrase >= 0]
        want = {i for i in range(len(words) - len(own) + 1) if (words[i : i + len(own)] == own).all() and (i + len(own) <= 2900 or i >= 3000)}
        assert set(first[which == k].tolist()) == want


def test_nothing_to_search(spark, table):
    docs, none = spark.read.parquet(f"{table}/documents.parquet"), spark.createDataFrame([], BENCHMARK)
    rows = decontaminate.removal_spans(docs, none).collect()
    assert len(rows) == docs.count() and all(r.n_hit == 0 and r["items"] == [] and r.spans == [] for r in rows)
    benchmark = spark.createDataFrame([(1, "a b c", "w")], BENCHMARK)
    assert decontaminate.removal_spans(docs.limit(0), benchmark).count() == 0


def _new_folder(spark) -> str:
    from fleetcast.session import new_table_path

    return new_table_path(spark, "test")
