"""Unique keys: found as by brute force, and noticed through plans."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veilspark.catalogue import session
from veilspark.errors import Cause, PolicyRejection
from veilspark.operators.keys import discover_keys
from veilspark.plans.dependencies import closure

from .conftest import SF


def brute(columns, rows, most):
    found = []
    for level in range(1, most + 1):
        for s in combinations(range(len(columns)), level):
            if rows and not any(set(k) <= set(s) for k in found) and len({tuple(str(r[i]) for i in s) for r in rows}) == len(rows):
                found.append(s)
    return {frozenset(columns[i] for i in k) for k in found}


@pytest.mark.parametrize("seed", range(6))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    columns = ["A b", "b.c", "`q`", "c", "d"]
    n = rng.choice((1, 2, 30, 200))
    rows = [tuple(None if rng.random() < 0.02 else rng.randrange(size) for size in (n * 30, 15, 15, 3, n)) for _ in range(n)]
    if seed == 5:
        rows += rows[:1]
    df = spark.createDataFrame(rows, ", ".join(f"`{c.replace('`', '``')}` int" for c in columns)) if seed != 4 else spark.createDataFrame([], "`A b` int, `b.c` int, c int, d int, e int")
    if seed == 4:
        assert discover_keys(df) == ()
        return
    df = df.toDF("A b", "b.c", "q", "c", "d")
    names = ["a b", "b.c", "q", "c", "d"]
    assert set(discover_keys(df, 3, 2 if seed == 1 else 12)) == brute(names, rows, 3)


def test_types_that_cannot_be_grouped_are_left_out(spark):
    df = spark.range(4).select("id", F.create_map(F.lit("k"), F.col("id")).alias("m"), F.array(F.col("id")).alias("l"), F.lit(None).alias("nothing"), F.array(F.create_map(F.lit(1), F.lit(2))).alias("x"))
    assert discover_keys(df) == (frozenset({"id"}), frozenset({"l"}))


def test_closure():
    f = frozenset
    facts = [(f({1}), f({2, 3})), (f({3, 4}), f({5})), (f(), f({4})), (f({9}), f({1}))]
    assert closure(f({1}), facts) == {1, 2, 3, 4, 5} and closure(f({9}), facts) == {9, 1, 2, 3, 4, 5} and closure(f({5}), facts) == {5, 4}


@pytest.fixture(scope="module")
def guard(spark):
    g = session(spark, SF, unique_keys={})
    g.found_keys = {"demo.customer": (f({"c_custkey"}),), "demo.nation": (f({"n_nationkey"}), f({"n_name"})), "demo.orders": (f({"o_orderkey"}),), "demo.lineitem": (f({"l_orderkey", "l_linenumber"}),)}
    return g


f = frozenset
JOIN = "demo.customer JOIN demo.nation ON c_custkey = n_nationkey"


@pytest.mark.parametrize(
    "text",
    [
        f"SELECT n_name, sum(c_acctbal) AS s FROM {JOIN} GROUP BY n_name", f"SELECT z, sum(c_acctbal) AS s FROM (SELECT *, n_name AS z FROM {JOIN}) GROUP BY z",
        "SELECT b, avg(c_acctbal) AS s FROM demo.customer AS t(a, n, k, c_acctbal, m) JOIN (SELECT a AS b FROM demo.customer AS u(a, n, k, x, m)) v ON t.a = v.b GROUP BY b",
        f"SELECT n_name, corr(c_acctbal, c_acctbal) AS s FROM {JOIN} GROUP BY ROLLUP (n_name)", f"SELECT n_name, sum(c_acctbal) FILTER (WHERE c_acctbal > 0) AS s FROM {JOIN} GROUP BY CUBE (n_name)",
        "SELECT r, sum(c_acctbal) AS s FROM (SELECT *, row_number() OVER (ORDER BY c_nationkey) AS r FROM demo.customer) GROUP BY r",
        "SELECT c_nationkey, r, sum(c_acctbal) AS s FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r FROM demo.customer) GROUP BY c_nationkey, r",
        "SELECT g, sum(l_extendedprice) AS s FROM (SELECT o_orderkey AS g FROM demo.orders) JOIN demo.lineitem ON l_orderkey = g AND l_linenumber = 1 GROUP BY g",
        "SELECT n_name, avg(c_acctbal) AS s FROM demo.customer LEFT JOIN demo.nation ON c_custkey = n_nationkey JOIN (SELECT 1 AS one) ON true WHERE n_nationkey = c_custkey GROUP BY n_name",
    ],
)
def test_pinned_rows_give_no_summary(guard, text):
    with pytest.raises(PolicyRejection) as e:
        guard.sql(text)
    assert e.value.cause is Cause.OPAQUE_AGGREGATE


@pytest.mark.parametrize(
    "text",
    [
        "SELECT n_name, avg(c_acctbal) AS s FROM demo.customer JOIN demo.nation ON c_nationkey = n_nationkey GROUP BY n_name", f"SELECT n_name, count(*) AS s FROM {JOIN} GROUP BY n_name",
        "SELECT o_orderkey, sum(l_extendedprice) AS s FROM demo.orders JOIN demo.lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey", "SELECT l_linenumber, avg(l_extendedprice) AS s FROM demo.lineitem GROUP BY l_linenumber",
        "SELECT c_nationkey, r, sum(c_acctbal) AS s FROM (SELECT *, rank() OVER (ORDER BY c_mktsegment) AS r FROM demo.customer) GROUP BY c_nationkey, r",
        "SELECT n_name, avg(c_acctbal) AS s FROM demo.customer JOIN demo.nation ON c_custkey > n_nationkey GROUP BY n_name", "SELECT avg(c_acctbal) AS s FROM demo.customer",
    ],
)
def test_groups_of_many_rows_are_served(guard, text):
    guard.sql(text).collect()


def test_a_session_finds_the_keys_of_its_tables(spark):
    from veilspark.operators.session import GuardedSession
    from veilspark.sources.config import Config

    g = GuardedSession(spark, Config.build({"pseudonym_key": "0123456789abcdef", "columns": {"s.t": {"k": {"mask": "none"}, "v": {"mask": "numeric-bucket", "bucket": 10}}}}))
    g.add_table("s.t", spark.createDataFrame([(1, 5), (2, 5), (3, 7)], "k int, v int"))
    g.sql("SELECT k, sum(v) FROM s.t GROUP BY k")
    assert g.discover_keys() == {"s.t": (f({"k"}),)}
    with pytest.raises(PolicyRejection):
        g.sql("SELECT k, sum(v) FROM s.t GROUP BY k")


def test_hashes_settle_what_grouping_would(spark, monkeypatch):
    """Non-keys are told by two equal rows and keys by hashes that all differ: no row's values are shuffled."""
    from veilspark.operators import keys

    grouped = []
    unique = keys._unique
    monkeypatch.setattr(keys, "_unique", lambda data, sets: grouped.extend(sets) or unique(data, sets))
    df = spark.range(3000).select("id", (F.col("id") - F.when(F.col("id") % 100 == 7, 1).otherwise(0)).alias("near"), F.when(F.col("id") == 5, F.lit("")).when(F.col("id") > 5, F.col("id").cast("string")).alias("text"), F.when(F.col("id") == 0, F.lit(-0.0)).when(F.col("id") == 1, F.lit(0.0)).otherwise(F.col("id") / 7).alias("x"))
    assert discover_keys(df, 1) == (f({"id"}),) and grouped == []
    monkeypatch.setattr(keys, "_together", lambda columns: F.lit(64).cast("long") + 0 * sum(F.coalesce(F.hash(c), F.lit(0)) for c in columns))  # all hashes collide
    assert keys._keys_of(df.select(F.col("id").alias("c0"), F.col("near").alias("c1")), [(0,), (1,)]) == [(0,)] and grouped == [(0,)]
