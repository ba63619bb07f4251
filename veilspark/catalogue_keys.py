"""Registered queries of unique keys: found in the rows, and noticed through plans."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from .errors import PolicyRejection
from .operators.keys import discover_keys

Entry = tuple[Callable[[SparkSession, str], DataFrame], str]

#: The columns of the given tables.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
}


def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All minimal keys of one or two columns of the given tables, found in their rows."""
    rows = [(t, ",".join(sorted(k))) for t in COLUMNS for k in discover_keys(spark.read.parquet(f"{sf_dir}/{t}.parquet"))]
    return spark.createDataFrame(rows, "relation string, columns string")


def _keys_sql() -> str:
    rows = []
    for table, names in COLUMNS.items():
        for level in (1, 2):
            for key in combinations(sorted(names.split()), level):
                listed = ", ".join(key)
                rows.append(f"SELECT '{table}' AS relation, {list(key)!r} AS k, (SELECT count(*) FROM {table}) = (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {table})) AS is_key")
    return (
        f"WITH s AS ({' UNION ALL '.join(rows)}), u AS (SELECT relation, k FROM s WHERE is_key) "
        "SELECT relation, array_to_string(k, ',') AS columns FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS v WHERE v.relation = u.relation AND len(v.k) < len(u.k) AND list_has_all(u.k, v.k))"
    )


def _unique(table: str, columns: str) -> str:
    return f"(SELECT count(*) FROM {table}) = (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {table}))"


#: (name, statement, what of the data makes its groups single rows)
CASES = (
    ("found key", "SELECT s_name, avg(s_acctbal) AS a FROM demo.supplier GROUP BY s_name", _unique("supplier", "s_name")),
    ("found pair", "SELECT c_nationkey, c_acctbal, avg(c_acctbal) AS a FROM demo.customer GROUP BY c_nationkey, c_acctbal", _unique("customer", "c_nationkey, c_acctbal")),
    ("join on a key", "SELECT n_nationkey, avg(c_acctbal) AS a FROM demo.customer JOIN demo.nation ON c_custkey = n_nationkey GROUP BY n_nationkey", _unique("customer", "c_custkey")),
    ("join on a key, renamed", "SELECT k, avg(b) AS a FROM (SELECT n_nationkey AS k, c_acctbal AS b FROM demo.customer JOIN demo.nation ON c_custkey = n_nationkey) GROUP BY k", _unique("customer", "c_custkey")),
    ("join over two tables", "SELECT r_name, avg(c_acctbal) AS a FROM demo.customer JOIN demo.nation ON c_custkey = n_nationkey JOIN demo.region ON n_nationkey = r_regionkey GROUP BY r_name", f"{_unique('region', 'r_name')} AND {_unique('customer', 'c_custkey')}"),
    ("key of a grouped query", "SELECT x.g, avg(c_acctbal) AS a FROM (SELECT n_nationkey AS g, count(*) AS n FROM demo.nation GROUP BY n_nationkey) x JOIN demo.customer ON c_custkey = x.g GROUP BY x.g", _unique("customer", "c_custkey")),
    ("output of a grouped query", "SELECT x.n, avg(c_acctbal) AS a FROM (SELECT n_nationkey AS g, count(*) AS n FROM demo.nation GROUP BY n_nationkey) x JOIN demo.customer ON c_custkey = x.n GROUP BY x.n", _unique("customer", "c_custkey")),
    ("key fixed by a filter", "SELECT n_name, avg(c_acctbal) AS a FROM demo.customer, demo.nation WHERE c_custkey = 3 GROUP BY n_name", _unique("customer", "c_custkey")),
    ("key behind a CTE", "WITH w(p, q) AS (SELECT n_nationkey, n_name FROM demo.nation) SELECT p, avg(c_acctbal) AS a FROM w JOIN demo.customer ON c_custkey = p GROUP BY p", _unique("customer", "c_custkey")),
    ("many rows a group", "SELECT n_nationkey, avg(c_acctbal) AS a FROM demo.customer JOIN demo.nation ON c_nationkey = n_nationkey GROUP BY n_nationkey", _unique("customer", "c_nationkey")),
    ("other side of the join", "SELECT n_name, avg(s_acctbal) AS a FROM demo.supplier JOIN demo.nation ON s_nationkey = n_nationkey GROUP BY n_name", f"{_unique('nation', 'n_name')} AND {_unique('supplier', 's_nationkey')}"),
    ("plain column", "SELECT c_mktsegment, avg(c_acctbal) AS a FROM demo.customer GROUP BY c_mktsegment", _unique("customer", "c_mktsegment")),
)


def keys_through_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groupings that pin rows down by found keys, through joins, renames and grouped queries: none of them gives a summary."""
    from .catalogue import session

    guard = session(spark, sf_dir, unique_keys={})
    for name in ("nation", "region", "customer", "supplier"):
        guard.found_keys[f"demo.{name}"] = discover_keys(guard.tables[f"demo.{name}"].frame)
    rows = []
    for name, text, _ in CASES:
        try:
            guard.sql(text)
            rows.append((name, "served"))
        except PolicyRejection as e:
            rows.append((name, e.cause.value))
    return spark.createDataFrame(rows, "case_name string, verdict string")


def entries() -> dict[str, Entry]:
    sql = " UNION ALL ".join(f"SELECT '{n}' AS case_name, CASE WHEN {w} THEN 'opaque_aggregate' ELSE 'served' END AS verdict" for n, _, w in CASES)
    return {"unique_keys": (unique_keys, _keys_sql()), "keys_through_plans": (keys_through_plans, sql)}
