"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetcast.llm import decontaminate, exact, fixity, langid, mixing, packing, quality, secrets, sharding, simhash, spotsigs, trie, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_histogram_sort": sharding.op1,
    "op2_concatenate_and_cut": packing.op2,
    "op3_blob_ledger": secrets.op3,
    "op4_progressive_dedup": exact.op4,
    "op5_random_indexing": quality.op5,
    "op6_spotsigs": spotsigs.op6,
    "op7_merkle_fixity": fixity.op7,
    "op8_threshold_mix": mixing.op8,
    "op9_output_codes": langid.op9,
    "op10_pigeonhole_simhash": simhash.op10,
    "op11_vertical_bitmaps": trie.op11,
    "op12_multiplicity_whitening": whitening.op12,
    "op13_fm_index": decontaminate.op13,
}
CHECKS: dict[str, str] = {
    "op4_progressive_dedup": exact.OP4_SQL,
    "op7_merkle_fixity": fixity.OP7_SQL,
    "op8_threshold_mix": mixing.OP8_SQL,
    "op11_vertical_bitmaps": trie.OP11_SQL,
    "op13_fm_index": decontaminate.OP13_SQL,
}
