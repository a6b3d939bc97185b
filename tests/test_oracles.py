"""Every registered case against its DuckDB oracle at sf0.01 (the driver's check)."""

from __future__ import annotations

import pytest
from conftest import SF001, SF01
from oracle_util import compare, duck

import __spark_entry__ as entry_module
from stevedore.plans import CASES
from stevedore.plans.oracle import ORACLE_SQL as ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_case_has_an_oracle_and_is_registered():
    assert set(CASES) == set(ORACLES)
    assert CASES.items() <= entry_module.queries().items()
    assert ORACLES.items() <= entry_module.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(CASES))
def test_case_matches_oracle(spark, con, name):
    ok, msg = compare(CASES[name](spark, SF01), con, ORACLES[name])
    assert ok, f"{name}: {msg}"


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    first = df.schema
    assert df.count() > 0
    assert entry_module.entry(spark).schema == first
    ok, msg = compare(df, duck(SF001), ORACLES["merge_upsert"])
    assert ok, msg
