"""Every operator against plain Python on a small table with copies, nulls, empty and long texts, and repeated rows."""

from __future__ import annotations

import array
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from plain import SECRET, ascii_lower, classes, simhash, words
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from fleetcast.llm import components, exact, fixity, langid, mixing, packing, quality, secrets, sharding, simhash as sim, spotsigs
from fleetcast.session import new_table_path


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 1 ---------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_keep_equal_texts_together(docs, rows):
    got = collected(sharding.shard_by_bytes(docs, shards=4, piece_rows=10), "doc_id", "text", "__shard", "__slot", "__bytes", "size")
    assert Counter((d, t) for d, t, *_ in got) == Counter((r[0], r[1]) for r in rows)
    assert all(b == len((t or "").encode()) + 1 and size == 1 for _, t, _, _, b, size in got)
    slots = defaultdict(list)
    for _, _, shard, slot, _, _ in got:
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_many_rows_meet_the_tolerance(spark):
    many = spark.range(20_000).selectExpr("id doc_id", "if(id % 3 = 0, repeat('same ', 10), repeat(cast(id as string), 1 + id % 20)) text")
    got = sharding.shard_by_bytes(many, shards=16, tolerance=0.01, piece_rows=500)
    sums = [r[1] for r in got.groupBy("__shard").agg(F.sum("__bytes")).collect()]
    assert len(sums) == 16 and max(sums) < 1.03 * sum(sums) / 16 and min(sums) > 0.97 * sum(sums) / 16
    counts = got.groupBy("__shard").agg(F.count("*").alias("n"), F.max("__slot").alias("m"), F.countDistinct("__slot").alias("d")).collect()
    assert all(r.n == r.m + 1 == r.d for r in counts)


@pytest.mark.parametrize("piece_rows", [7, 50_000])
def test_rows_that_repeat_id_and_text_are_parted(spark, nothing, piece_rows):
    same = spark.range(400).selectExpr("1L doc_id", "'x' text")
    mixed = same.unionByName(spark.range(300).selectExpr("id + 5 doc_id", "repeat(cast(id as string), 1 + id % 9) text"))
    for docs, n in ((same, 400), (mixed, 700)):
        got = sharding.shard_by_bytes(docs, shards=8, piece_rows=piece_rows)
        found = got.groupBy("__shard").agg(F.sum("__bytes").alias("b"), F.count("*").alias("n"), F.max("__slot").alias("m"), F.countDistinct("__slot").alias("d")).collect()
        total = sum(r.b for r in found)
        assert len(found) == 8 and sum(r.n for r in found) == n and all(r.n == r.m + 1 == r.d for r in found)
        assert all(abs(r.b - total / 8) <= 40 for r in found)  # a few rows of at most 27 bytes
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_columns_of_the_same_names_stay(spark):
    docs = spark.range(30).selectExpr("id doc_id", "repeat('ab ', int(id)) text", "'own' __shard", "7 __first", "8 __slot")
    got = sharding.shard_by_bytes(docs, shards=3)
    assert got.columns == [*docs.columns, "__shard_", "__slot_", "__bytes"]
    assert {(r["__shard"], r["__first"], r["__slot"]) for r in got.collect()} == {("own", 7, 8)}


def test_the_sharding_query(spark, table, rows):
    got = entry_module.queries()["op1_histogram_sort"](spark, table).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= set(range(16))


# 2 ---------------------------------------------------------------------------------------------------


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(text: str | None) -> list[int]:
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def test_packed_pieces_are_the_tokens_once_each(docs, rows):
    parts = packing.pack(docs, packing.default_tokenizer(), length=64).cache()
    got = collected(parts, "sequence_id", "offset", "doc_id", "start", "length", "ids", "doc_tokens")
    got.sort()
    at, stream = 0, []
    for sequence, offset, *_, length, ids, _ in got:
        assert (sequence * 64 + offset, len(ids)) == (at, 4 * length)
        at += length
        stream.append(ids)
    want = Counter((r[0], array.array("I", ids_of(r[1])).tobytes()) for r in rows)
    whole, held = Counter(), b""
    for _, _, doc, start, _, ids, n in got:
        assert len(held) == 4 * start
        held += ids
        if len(held) == 4 * n:
            whole[doc, held] += 1
            held = b""
    assert whole == want
    sequences = dict(collected(packing.sequences(parts, length=64), "sequence_id", "ids"))
    joined = b"".join(sequences[k] for k in sorted(sequences))
    assert joined[: 4 * at] == b"".join(stream) and len(joined) == 256 * len(sequences) and not any(joined[4 * at :])


def test_remembered_chunks_give_the_ids_of_whole_texts():
    from fleetcast.llm.tokens import Tokens

    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        known = Tokens(f.read())
    for text in (
        "It's  TOKENS, don't\tsplit\x1cthem here\n\n", "été ÉTÉ!! İstanbul ΣΣ ﬁn ßa 12a3'll x's 'S",
        "<|endoftext|> a<|startoftext|>b </w> ##$$ foo_bar 你好\U0001f600a", " ", "", "we'll,'re;'ve  \r\n x́ 'tis O'S",
    ):
        assert known.ids(text) == array.array("I", ids_of(text)[:-1]).tobytes(), text


def known_tokens():
    from fleetcast.llm.tokens import Tokens

    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        return Tokens(f.read())


def test_rare_words_are_encoded_once():
    known, sent = known_tokens(), []
    encode = known.encode
    known.encode = lambda texts, **kw: sent.extend(texts) or encode(texts, **kw)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in "abcdefghijklm"]
    texts = [" ".join(words[at : at + 5000]) for at in range(0, len(words), 5000)]
    first = [known.ids(t) for t in texts]
    assert len(words) > 200_000 and sum(len(t.split()) for t in sent) == len(words)
    sent.clear()
    assert [known.ids(t) for t in texts] == first and not sent


def test_a_full_memory_keeps_the_pieces_used_most(monkeypatch):
    monkeypatch.setattr("fleetcast.llm.tokens.PIECES", 40)
    monkeypatch.setattr("fleetcast.llm.tokens.HELD", 500)
    known = known_tokens()
    for k in range(60):
        text = " ".join(["often", "seen!", "2x", *(f"q{'abcdefghij'[k % 10] * (i + 1)}z{'pqrstu'[k % 6]}" for i in range(12)), "y" * 200 * (k % 3)])
        assert known.ids(text) == array.array("I", ids_of(text)[:-1]).tobytes()
        assert len(known.known) <= 40 + 16 and known.held <= 500 + len(text)
        assert len(known.known) == len(known.sizes) == len(known.uses) and known.sizes.sum() == len(known.flat)
    assert {b"often", b"seen", b"!", b"2x"} <= known.known.keys()


def test_chunks_that_stay_whole_beside_words():
    known = known_tokens()
    parts = ["the", "The", "ÉTÉ", "İ", "ﬁn", "'S", "!!", " ", "\n", "\t", "12", "Z", "<|endoftext|>", "你好", "x́", "×", "\x00", "ᄀ", "ᅡ", "\u2003"]
    texts = [None, "", *("".join(parts[(i * k + k // 7) % len(parts)] for i in range(k % 9)) for k in range(400))]
    flat, lengths = known.of_texts(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    assert lengths.tolist() == [len(ids_of(t)) - 1 for t in texts]
    assert flat.tolist() == [i for t in texts for i in ids_of(t)[:-1]]


def test_pieces_are_cut_at_every_window(spark):
    sizes = [0, 1, 6, 7, 0, 8, 20, 40_000, 1, 13, 0]
    rows, at = [], 3
    for doc, n in enumerate(sizes):
        rows.append((None if doc == 5 else doc, at, bytes(range(251)) * (4 * n // 251) + bytes(4 * n % 251)))
        at += n
    stream = spark.createDataFrame(rows, "doc_id long, place long, ids binary").coalesce(1)
    want = []
    for doc, place, ids in rows:
        n, start = len(ids) // 4, 0
        while start < n:
            sequence, offset = divmod(place + start, 7)
            take = min(n - start, 7 - offset)
            want.append((doc, start, take, ids[4 * start : 4 * (start + take)], n, sequence, offset))
            start += take
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    got = packing.cut(stream, 7)
    assert got.columns == list(names) and [(*r[:3], bytes(r[3]), *r[4:]) for r in got.collect()] == want
    assert packing.cut(stream.filter("length(ids) = 0"), 7).count() == 0


def test_packing_nothing(nothing):
    parts = packing.pack(nothing, packing.default_tokenizer())
    assert parts.count() == 0 and packing.sequences(parts).count() == 0


# 3 ---------------------------------------------------------------------------------------------------


def spans_of(text: str) -> str:
    kinds = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        (re.compile("[0-9a-f]+"), 0, 24),
    ]
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= n]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_findings_reach_every_path(spark, table, rows):
    got = secrets.op3(spark, table).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == Counter((r[0], spans_of(r[1] or "")) for r in rows)
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
    one = next(r for r in got if r.n_hex)
    assert (one.n_assign, one.n_access, one.n_hex) == (1, 1, 1) and "token" in SECRET


def test_only_unseen_pairs_are_scanned(spark, docs, nothing):
    ledger = new_table_path(spark, "ledger")
    blobs = docs.select(secrets.blob_of(F.col("text"))).distinct().count()
    secrets.scan_unseen(docs, ledger)
    assert spark.read.parquet(ledger).count() == 3 * blobs
    secrets.scan_unseen(docs.unionByName(docs.limit(5)), ledger)
    assert spark.read.parquet(ledger).count() == 3 * blobs
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, r"[0-9a-f]+", 16))
    later = docs.selectExpr("doc_id", "text").unionByName(spark.sql("select 1L doc_id, 'new deadbeefdeadbeef' text"))
    found = secrets.findings(later, ledger, rules=newer)
    # the changed rule for all blobs, the others for the new one
    assert spark.read.parquet(ledger).count() == 4 * blobs + 3
    assert found.filter("size(spans) > 0 and text is null").count() == 0 if "text" in found.columns else found.count() == later.count()
    assert secrets.findings(nothing, new_table_path(spark, "ledger")).count() == 0


# 4 ---------------------------------------------------------------------------------------------------


def groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[ascii_lower(r[1] or "")].append(r[0])
    return by


def largest(ids):
    return max(ids, key=lambda i: (i is not None, i or 0))


def test_exact_groups(docs, rows, nothing):
    by = groups(rows)
    want = Counter((i, largest(ids), len(ids)) for ids in by.values() for i in ids)
    got = exact.exact_groups(docs, hash_settled=True)
    assert Counter(collected(got, "doc_id", "keep_id", "group_size")) == want
    kept = collected(got.filter("kept"), "doc_id", "text_hash")
    assert sorted(h for _, h in kept) == sorted(hashlib.sha256(t.encode()).digest() for t in by)
    assert Counter(i for i, _ in kept) == Counter(largest(ids) for ids in by.values())
    assert exact.exact_groups(nothing).count() == 0


def test_deduplicate_keeps_one_row_a_text(docs, rows, nothing):
    got = exact.deduplicate(docs)
    assert got.columns == docs.columns and exact.deduplicate(nothing).count() == 0
    assert Counter(ascii_lower(t or "") for _, t in collected(got, "doc_id", "text")) == Counter(list(groups(rows)))
    assert Counter(i for i, _ in collected(got, "doc_id", "text")) == Counter(largest(ids) for ids in groups(rows).values())


# 5 ---------------------------------------------------------------------------------------------------


def test_quality_of_a_small_table(spark, table, docs, rows, nothing):
    got = quality.op5(spark, table).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs.limit(3), labels).collect()} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0


def test_vectors_count_neighbours_across_runs(spark, monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(40))
    docs = spark.createDataFrame([(text,), ("",), ("w1",), (None,)], "text string")
    whole = quality.word_vectors(docs)
    places, signs = quality.index_vectors(quality.WORDS, 1)
    cells = [quality.Cells()[w] // quality.MARKS for w in text.split()]
    sums = np.zeros((quality.WORDS, quality.DIMENSIONS))
    for i, c in enumerate(cells):
        for j in (i - 2, i - 1, i + 1, i + 2):
            if 0 <= j < len(cells):
                for k in range(quality.NONZERO):
                    sums[c, places[cells[j], k]] += signs[cells[j], k]
    assert np.allclose(whole[0], quality._unit(sums), atol=1e-6)


def test_quality_separates_shouting_from_prose(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels).filter("held_out").join(labels, "doc_id")
    right, n = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 60 and right > 0.93


# 6 ---------------------------------------------------------------------------------------------------


def signatures(text: str) -> set[str]:
    stream, out = [w for w in re.split(r"[^\w]+|_", text.lower()) if w], set()
    anchors, others = set(spotsigs.ANCHORS), set(spotsigs.OTHERS)
    for i, w in enumerate(stream):
        rest = [v for v in stream[i + 1 :] if v not in anchors and v not in others]
        ahead = next((v for v in stream[i + 1 :] if v not in others), None)
        if w in anchors and ahead is not None and ahead not in anchors:
            out.add(f"{w}:{' '.join(rest[: spotsigs.CHAIN])}")
    return out


def test_spot_signatures(spark, docs, rows):
    long_ = [r for r in rows if r[1] and len(signatures(r[1])) > 0]
    made = spotsigs.with_signatures(docs.select("doc_id", "text"), "text", "s").withColumn("n", F.size("s"))
    assert all(n == len(signatures(t)) for t, n in collected(made.filter("text is not null"), "text", "n") if signatures(t)) and long_
    assert made.filter("coalesce(text, '') = '' and n > 0").count() == 0
    assert made.filter("coalesce(text, '') != '' and n = 0").count() == 0


def test_spotsigs_query(spark, table, rows, nothing):
    got = spotsigs.op6(spark, table).collect()
    line = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter()
    for k, (i, t) in enumerate(line):
        after = line[(k + 1) % len(line)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert spotsigs.with_next(nothing.select("doc_id", "text")).count() == 0


def test_near_links_are_those_of_all_pairs(docs, rows):
    held, links = spotsigs.near_links(docs.filter("doc_id is not null"))
    sets = {i: signatures(t) for i, t, *_ in rows if i is not None and t and signatures(t)}
    same = dict(collected(held, "doc_id", "class_id"))
    want = set()
    for a in sets:
        for b in sets:
            if same[a] < same[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want.add((same[a], same[b]))
    got = {tuple(sorted(x)) for x in collected(links, "left", "right")}
    assert {x for x in got if x[0] in sets and x[1] in sets} == want and want


# 7 ---------------------------------------------------------------------------------------------------


def test_audit_finds_the_planted_faults_only(spark):
    pages = spark.range(2000).selectExpr("if(id = 0, null, id) page_id", "if(id % 50 = 0, null, concat('http://x/', id)) url", "repeat(concat('<p>', id), cast(id % 90 as int)) html")
    records = fixity.warc_records(pages)
    turned = records.withColumn("record_sha256", F.sha2(fixity.damaged_record(), 256)).filter("record_sha256 is not null")
    found = fixity.audit(records, turned)
    ids = dict(collected(records, F.struct("archive", "offset"), "page_id"))
    want = {(i, "missing" if i % 389 == 7 else "changed") for i in range(1, 2000) if i % 97 == 5 or i % 389 == 7 or i % 577 == 11}
    assert {(ids[(r.archive, r.offset)], r.status) for r in found.collect()} == want
    assert fixity.audit(records, records).count() == 0
    none = records.limit(0)
    assert fixity.audit(none, none).count() == 0
    assert {r.status for r in fixity.audit(none, records.limit(3)).collect()} == {"added"}


def test_audit_of_records_without_archive_or_offset(spark):
    def replica(*rows):
        return spark.createDataFrame(rows, "archive long, offset long, record_sha256 string")

    one = replica((None, 0, "a"), (None, 70_000, "b"), (1, None, "c"), (1, 5, "d"), (2, 9, "e"))
    two = replica((None, 0, "a"), (None, 70_000, "B"), (1, None, "C"), (1, 5, "d"), (None, 8, "f"))
    got = {(r.archive, r.offset, r.status) for r in fixity.audit(one, two).collect()}
    assert got == {(None, 70_000, "changed"), (1, None, "changed"), (2, 9, "missing"), (None, 8, "added")}


def test_stage_operators_keep_columns_of_any_name(spark, docs, rows):
    """Columns named like an operator's own come back as they were."""
    plain = docs.select("doc_id", "text", "lang", "source").filter("doc_id is not null").dropDuplicates()
    clash = ["__size", "__lang", "__hash", "__settled", "__whole", "__print", "__repeats", "__id"]
    named = plain.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in clash])
    model = langid.fit(plain)
    stages = [mixing.mixed, exact.deduplicate, sim.without_near_duplicates, lambda d: langid.in_known_language(d, model)]
    for stage in stages:
        got = stage(named)
        assert got.columns == named.columns
        found = got.collect()
        assert all(r[c] == f"{c} {r.doc_id}" for r in found for c in clash)
        assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in stage(plain).collect())


def test_no_language_to_learn_rejects_all(spark, docs):
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.in_known_language(none, langid.fit(none)).count() == 0


def test_rows_that_repeat_id_and_text_leave_one_defined_row(spark):
    table = spark.createDataFrame([(1, "a", f"s{k}") for k in range(9)], "doc_id long, text string, source string")
    kept = {exact.deduplicate(table.repartition(n)).first().source for n in (1, 2, 5, 9)}
    assert len(kept) == 1


# 8 ---------------------------------------------------------------------------------------------------


def test_mix_meets_its_targets(docs, rows, nothing):
    got = mixing.mix(docs).select("doc_id", "text", "source", "__size", "__source_size", "__target", "__repeats").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1] or ""))
    assert len(got) == len(rows) and {r.source: r["__source_size"] for r in got} == sizes
    targets = {r.source: r["__target"] for r in got}
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    free = {s: t / (1 + k % 3) for k, (s, t) in enumerate(sorted(targets.items(), key=lambda x: (x[0] is None, x[0] or ""))) if t < 3 * sizes[s] - 1e-6}
    assert max(free.values()) - min(free.values()) < 1e-6 * max(free.values())
    for s, t in targets.items():
        own = [r for r in got if r.source == s]
        assert t <= 3 * sizes[s] + 1e-6 and {r["__repeats"] for r in own} <= {0, 1, 2, 3}
        taken = sum(r["__size"] * r["__repeats"] for r in own)
        units = Counter()
        for r in own:
            units[r.doc_id] += r["__size"]
        assert abs(taken - t) <= max(units.values())
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["__repeats"] for r in got)
    assert mixing.mix(nothing).count() == 0


# 9 ---------------------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.identify(docs, langid.fit(docs))
    right, n = found.filter(langid.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("__lang")).cast("int")), F.count("*")).first()
    assert n > 30 and right > 0.97


def test_undetermined_languages(docs, rows, nothing):
    found = langid.identify(docs, langid.fit(docs))
    for text, lang, score in collected(found, "text", "__lang", "__score"):
        assert (lang == "und") == (text is None or not any(map(str.isalpha, text))) and 0 <= score <= 1
    kept = langid.in_known_language(docs, langid.fit(docs))
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 0
    assert {r["__lang"] for r in langid.identify(docs, langid.fit(nothing)).collect()} == {"und"}
    assert langid.identify(nothing, langid.fit(docs)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 12])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code}) == (n if n > 1 else 1)
    assert all(len(set(bit)) == 2 for bit in code.T)


def test_trigram_blocks_match_a_plain_loop(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    texts = [b"abcdEF", b"", b"x", b"12 \xc3\xa9t", b"longer than one block of bytes"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = np.concatenate([c for _, c in langid.trigram_blocks(data, offsets)])
    want = []
    for t in texts:
        low = [langid._folded()[b] for b in t]
        for i in range(len(t)):
            code = int.from_bytes(bytes(low[i : i + 3]), "big")
            none = i + 3 > len(t) or code == 0x202020
            want.append(1 << langid.TABLE if none else (code * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - langid.TABLE)
    assert got.tolist() == want


# 10 --------------------------------------------------------------------------------------------------


def test_fingerprints_and_classes(spark, table, rows):
    got = sim.op10(spark, table).collect()
    prints = [(r[0], simhash(r[1] or "")) for r in rows]
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == Counter(prints)
    root = classes([p for _, p in prints])
    least = defaultdict(lambda: None)
    for i, p in prints:
        known = least[root[p]]
        least[root[p]] = i if known is None else known if i is None else min(i, known)
    assert all(r.component_id == least[root[int(r.fingerprint, 16)]] for r in got)


@pytest.mark.parametrize("bucket", [1, 64])
def test_links_of_clustered_fingerprints(spark, bucket):
    """Dense clusters, so that with a small bucket all go through the balls."""
    rng = np.random.default_rng(5)
    prints = set()
    for centre in rng.integers(0, 1 << 62, 12):
        for _ in range(25):
            prints.add(int(centre) ^ sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(0, 5)))))
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    found = dict(collected(components.components(sim.links(frame, bucket=bucket), "left", "right"), "node", "root"))
    want = classes(sorted(prints))
    assert {p: found.get(p, p) for p in prints} == want and len(set(want.values())) < len(prints)


def test_allocation_is_the_cheapest():
    costs = [[0, 5, 9, 30], [0, 1, 2, 3], [0, 4, 40, 400]]
    best, chosen = sim.allocation(costs, 0)
    every = [
        costs[0][a + 1] + costs[1][b + 1] + costs[2][c + 1]
        for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0
    ]
    assert best == min(every) and sum(chosen) == 0



def test_without_near_duplicates(docs, rows, nothing):
    got = sim.without_near_duplicates(docs)
    root = classes([simhash(r[1] or "") for r in rows])
    kept = Counter(root[simhash(t or "")] for t in {(i, t) for i, t in collected(got, "doc_id", "text")} for t in [t[1]])
    assert got.columns == docs.columns and kept == Counter(set(root.values()))
    assert sim.without_near_duplicates(nothing).count() == 0


def test_a_long_text_is_read_in_runs(monkeypatch):
    text = b"one two  three\tfour five six seven Eight nine ten"
    whole = sim.fingerprint(text)
    runs = sim._word_runs
    monkeypatch.setattr(sim, "_word_runs", lambda t: runs(t, step=5))
    assert sim.fingerprint(text) == whole


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    found = dict(collected(components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b"), "node", "root"))
    assert found == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
