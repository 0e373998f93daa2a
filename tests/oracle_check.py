"""Compare registered queries with their SQL: python tests/oracle_check.py [sf] [name prefix ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from fleetcast.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    return v


def _rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1.5e-6 + 1e-9 * max(abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(_close, a, b))
    return type(a) is type(b) and a == b


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, int, float]:
    start = time.time()
    df = entry_module.queries()[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    took = time.time() - start
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return "rows only", len(got), took
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}", len(got), took
    want = _rows(columns, res.fetchall())
    if got == want:
        return "equal", len(got), took
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}", len(got), took
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not _close(g, w)]
    if not bad:
        return "close", len(got), took
    return f"VALUES differ in {len(bad)} rows: {sorted(columns)}\n   {bad[0][0]}\n   {bad[0][1]}", len(got), took


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wrong = 0
    for name in entry_module.queries():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            verdict, n, took = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            verdict, n, took = f"FAILED {type(e).__name__}: {str(e)[:600]}", 0, 0.0
        wrong += verdict not in ("equal", "close", "rows only")
        print(f"{name:36s} {n:8d} rows {took:7.2f} s  {verdict}", flush=True)
    print("not matching:", wrong)
    return wrong


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
