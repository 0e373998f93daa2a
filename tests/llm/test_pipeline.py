"""The corpus pipeline stage by stage against plain Python, and its registration."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from plain import ascii_lower, classes, simhash

import __spark_entry__ as entry_module
from fleetcast.session import written


def test_stages_take_effect(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, table), f"test-{name}")
        if name != "pack":
            assert docs.columns == columns
        seen.append(docs.collect())
    lettered, alone, apart, mixed, packed = seen
    assert all(any(map(str.isalpha, r.text)) for r in lettered)
    assert Counter(ascii_lower(r.text) for r in alone) == Counter({ascii_lower(r.text) for r in lettered})
    root = classes([simhash(r.text) for r in alone])
    assert Counter(root[simhash(r.text)] for r in apart) == Counter(set(root.values()))
    assert {r.text for r in mixed} <= {r.text for r in apart} and max(Counter(mixed).values()) <= 3
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in mixed)
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)


def test_an_empty_table_runs_through(spark, nothing, tmp_path):
    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(entry_module.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
