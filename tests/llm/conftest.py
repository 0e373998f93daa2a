from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plain import documents, frame  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def table(spark, docs, tmp_path_factory):
    """The documents, labels and pages as tables of a folder, for the registered queries."""
    top = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{top}/documents.parquet")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "0 toxic").filter("doc_id is not null")
    labels.write.parquet(f"{top}/labels.parquet")
    return str(top)
