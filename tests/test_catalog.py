"""Every registered query runs at sf0.001 and equals its SQL, where it has one."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry_module

# 250 rows an asset are too few to fit a sequence model.
EMPTY_AT_THIS_SCALE = {"b5_sequence_model", "c4_sequence_calibration", "g8_sequence_forecast", "s9a_sequence_save_and_load"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    verdict, n, _ = compare(spark, duck, name, sf_dir)
    assert verdict in ("equal", "close", "rows only")
    assert n > 0 or name in EMPTY_AT_THIS_SCALE


def test_checks_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 36
