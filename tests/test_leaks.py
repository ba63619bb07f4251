"""Shapes of leaks over all registered statements: raw names, odd dates, off-bucket balances."""

from __future__ import annotations

import pytest

from veilspark.catalogue import STATEMENTS, VARIANTS, queries

from .conftest import SF


@pytest.fixture(scope="module")
def raw(spark):
    read = lambda t, c: {r[0] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c).distinct().collect()}
    return {"names": read("customer", "c_name") | read("supplier", "s_name"), "parts": {p for p in read("part", "p_name") if p and len(p) > 4}}


@pytest.mark.parametrize("name", [*STATEMENTS, *VARIANTS])
def test_no_raw_values(spark, raw, name):
    frame = queries()[name](spark, SF)
    for row in frame.collect():
        for column, value in row.asDict().items():
            assert value not in raw["names"] and value not in raw["parts"], (name, column)
            if column == "o_orderdate" and value is not None:
                assert value.day == 1 and (name == "role_analyst" or value.month == 1)
            if column == "c_acctbal" and value is not None:
                assert value % 1000 == 0


def test_raw_values_would_be_noticed(spark, raw):
    assert spark.read.parquet(f"{SF}/customer.parquet").first().c_name in raw["names"]
