"""Every registered query against its SQL on small tables, and the entry points."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from veilspark import catalogue
from veilspark.operators.classify import emit_toml, propose
from veilspark.sources.config import Config

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    want = sorted([plain(v) for v in row] for row in result.fetchall())
    got = sorted([plain(r[c]) for c in columns] for r in frame.collect())
    assert got == want


def with_tables(folder, **tables):
    """A folder of the small tables with some of them replaced."""
    for t in catalogue.TABLES:
        if t not in tables:
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    for t, frame in tables.items():
        frame.write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_sorted_masks_keep_all_rows(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet").drop("p_partkey", "p_name")
    many = spark.range(1_000_001).selectExpr("id AS p_partkey", "'part ' || id % 1000 AS p_name").crossJoin(part.limit(1))
    got = catalogue.queries()["hostile_order_by"](spark, with_tables(tmp_path, part=many))
    assert got.select("p_partkey").distinct().count() == 1_000_001


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scrub_over_documents(spark):
    from veilspark.functions.scrub import py_scrub

    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r.doc_id: r.text for r in catalogue.mask_scrub(spark, SF).collect()}
    assert out == {k: py_scrub(v) for k, v in raw.items()}


def test_emitted_policy_loads(spark):
    tables = {"s.t": spark.createDataFrame([], "email string, phone bigint, city string, zip string, salary int, note string")}
    text = emit_toml(propose(tables))
    assert "NEEDS REVIEW" in text
    Config.parse('pseudonym_key = "0123456789abcdef"\n' + text)
