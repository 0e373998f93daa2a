"""Secret scans with an incremental blob ledger.

Every historical version of a text is addressed by its content. The ledger holds (blob, rule, version of the rule)
with the spans found; a scan reads only pairs that are not in it yet, each blob once however many paths and versions have it,
and findings are joined back to all paths. A changed rule gets a new version: only its pairs are scanned anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import ID, TEXT, column, documents, pieces
from fleetcast.session import new_table_path, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has at least `least` characters.

    `hints` are lower-case bytes of which a text must hold one in either case, `shape` bytes it must match, to be searched at all.
    """

    name: str
    version: int
    pattern: str
    least: int
    group: int = 0
    hints: tuple[bytes, ...] = ()
    shape: bytes = b""

    def finder(self) -> Callable[[bytes, bytes], list[tuple[int, int]]]:
        pattern = re.compile(self.pattern, re.ASCII)
        shape = re.compile(self.shape) if self.shape else None

        def find(text: bytes, lower: bytes) -> list[tuple[int, int]]:
            if self.hints and not any(h in lower for h in self.hints) or shape and not shape.search(text):
                return []
            # positions are those of code points
            return [m.span() for m in pattern.finditer(text.decode()) if m.end(self.group) - m.start(self.group) >= self.least]

        return find


#: The base kinds, in the order in which spans of one start are listed.
RULES = (
    Rule(
        "assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2,
        hints=(b"passw", b"secret", b"token", b"apikey", b"api_key"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, hints=(b"akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 24, shape=rb"[0-9a-f]{24}"),
)


def blob_of(text: Column) -> Column:
    """The content address: SHA-256 of the text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_unseen(versions: DataFrame, ledger_path: str, text_col: str = TEXT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at `ledger_path` lacks, add it, and return the ledger's rows of these rules and versions.

    Ledger: blob, rule, version, spans (start, end). A pair without findings has an empty list.
    """
    spark = versions.sparkSession
    text = column(text_col).cast("string")
    # each task keeps one copy of a blob before the exchange, so a text that a third of all rows have stays cheap
    blobs = versions.select(blob_of(text).alias("blob"), text.alias(TEXT)).groupBy("blob").agg(F.first(TEXT).alias(TEXT))
    wanted = [f"{r.name}/{r.version}" for r in rules]
    known = _ledger(spark, ledger_path)
    due = F.array(*map(F.lit, wanted))
    if known is not None:
        pair = F.concat_ws("/", "rule", "version")
        seen = known.filter(pair.isin(wanted)).groupBy("blob").agg(F.collect_set(pair).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        due = F.array_except(due, F.coalesce("seen", F.array().cast("array<string>")))
    todo = blobs.select("blob", F.col(TEXT).cast("binary").alias(TEXT), due.alias("due")).filter(F.size("due") > 0)
    kind = "blob binary, rule string, version int, spans array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {f"{r.name}/{r.version}": (r, r.finder()) for r in rules}
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in pieces(batch, TEXT):
                out: list[tuple] = []
                for blob, text, due in zip(*(part.column(c).to_pylist() for c in ("blob", TEXT, "due")), strict=True):
                    text = text or b""
                    lower = text.lower()
                    for key in due:
                        rule, find = finders[key]
                        out.append((blob, rule.name, rule.version, [{"start": a, "end": b} for a, b in find(text, lower)]))
                if out:
                    columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.string(), pa.int32(), spans))]
                    yield pa.RecordBatch.from_arrays(columns, names=["blob", "rule", "version", "spans"])

    todo.mapInArrow(run, kind).write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path).filter(F.concat_ws("/", "rule", "version").isin(wanted))


def findings(
    versions: DataFrame, ledger_path: str, path_cols: tuple[str, ...] = (ID,), text_col: str = TEXT, rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """The path columns of every version with `spans`: (start, order, kind, end) sorted by start, then by the rules' order.

    A null or empty text has no spans; repeated rows each get theirs; an empty table gives none.
    """
    order = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule")).cast("int")
    ledger = scan_unseen(versions, ledger_path, text_col, rules)
    listed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order.alias("order"), F.col("rule").alias("kind"), s["end"].alias("end")))
    # a row per rule; two runs at a time may have scanned a pair twice, with equal results
    per_blob = ledger.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(listed)))).alias("spans"))
    # a third of all rows may have one blob: from a written table, adaptive execution splits that partition of the join
    per_blob = written(per_blob, "secret-findings")
    return versions.select(*[column(c) for c in path_cols], blob_of(column(text_col)).alias("blob")).join(per_blob, "blob")


def op3(spark, sf_dir: str) -> DataFrame:
    found = findings(documents(spark, sf_dir), new_table_path(spark, "secret-ledger"))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        ID, *[count(r.name) for r in RULES], F.sha2(told.cast("binary"), 256).alias("base_sha256"), told.alias("spans")
    )
