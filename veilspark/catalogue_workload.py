"""A real workload under the example policy: how much of it is refused?

Twenty-two decision-support statements over the given tables, after the public TPC-H benchmark and
cut to the columns that these tables have.  The policy masks persons (names, account balances) and
releases trade data.  Each statement is decided with lineage refused and allowed, and what is served is run: its number of rows
must be that of the same statement without any policy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .errors import PolicyRejection

Entry = tuple[Callable[[SparkSession, str], DataFrame], str]
_REVENUE = "l_extendedprice * (1 - l_discount)"

WORKLOAD = {
    "q01": f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum({_REVENUE}) AS revenue, avg(l_discount) AS disc, count(*) AS n FROM demo.lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "q02": "SELECT s_acctbal, s_suppkey, n_name, p_partkey FROM demo.part, demo.lineitem, demo.supplier, demo.nation, demo.region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 1 ORDER BY s_acctbal DESC, p_partkey, s_suppkey LIMIT 100",
    "q03": f"SELECT l_orderkey, sum({_REVENUE}) AS revenue, o_orderdate FROM demo.customer, demo.orders, demo.lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC LIMIT 10",
    "q04": "SELECT o_orderpriority, count(*) AS order_count FROM demo.orders WHERE o_orderdate >= TIMESTAMP '1993-07-01 00:00:00' AND EXISTS (SELECT 1 FROM demo.lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20) GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "q05": f"SELECT n_name, sum({_REVENUE}) AS revenue FROM demo.customer, demo.orders, demo.lineitem, demo.supplier, demo.nation, demo.region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name",
    "q06": "SELECT sum(l_extendedprice * l_discount) AS revenue FROM demo.lineitem WHERE l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 24",
    "q07": f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, sum({_REVENUE}) AS volume FROM demo.supplier, demo.lineitem, demo.orders, demo.customer, demo.nation n1, demo.nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_nationkey < n2.n_nationkey GROUP BY 1, 2, 3",
    "q08": f"SELECT date_trunc('year', o_orderdate) AS o_year, sum(CASE WHEN n_nationkey = 3 THEN {_REVENUE} ELSE 0 END) / sum({_REVENUE}) AS share FROM demo.lineitem, demo.orders, demo.supplier, demo.nation WHERE s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND s_nationkey = n_nationkey GROUP BY date_trunc('year', o_orderdate)",
    "q09": f"SELECT n_name, date_trunc('year', o_orderdate) AS o_year, sum({_REVENUE}) AS profit FROM demo.part, demo.supplier, demo.lineitem, demo.orders, demo.nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_type LIKE '%STEEL%' GROUP BY n_name, date_trunc('year', o_orderdate)",
    "q10": f"SELECT c_custkey, c_name, sum({_REVENUE}) AS revenue, c_acctbal, n_name FROM demo.customer, demo.orders, demo.lineitem, demo.nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name",
    "q11": "SELECT l_partkey, sum(l_extendedprice) AS value FROM demo.lineitem, demo.supplier WHERE l_suppkey = s_suppkey AND s_nationkey = 7 GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM demo.lineitem) ORDER BY value DESC",
    "q12": "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low FROM demo.orders, demo.lineitem WHERE o_orderkey = l_orderkey AND l_linestatus IN ('O', 'F') GROUP BY o_orderstatus",
    "q13": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM demo.customer LEFT OUTER JOIN demo.orders ON c_custkey = o_custkey GROUP BY c_custkey) AS c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC",
    "q14": f"SELECT 100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REVENUE} ELSE 0 END) / sum({_REVENUE}) AS promo FROM demo.lineitem, demo.part WHERE l_partkey = p_partkey",
    "q15": f"WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({_REVENUE}) AS total FROM demo.lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM demo.supplier, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue)",
    "q16": "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM demo.lineitem, demo.part WHERE p_partkey = l_partkey AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM demo.supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size",
    "q17": "SELECT sum(l_extendedprice) / 7.0 AS avg_yearly FROM demo.lineitem, demo.part WHERE p_partkey = l_partkey AND p_size = 5 AND l_quantity < (SELECT 0.9 * avg(l_quantity) FROM demo.lineitem WHERE l_partkey = p_partkey)",
    "q18": "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS q FROM demo.customer, demo.orders, demo.lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM demo.lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 100) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice",
    "q19": f"SELECT sum({_REVENUE}) AS revenue FROM demo.lineitem, demo.part WHERE (p_partkey = l_partkey AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_partkey = l_partkey AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)",
    "q20": "SELECT s_name, n_name FROM demo.supplier, demo.nation WHERE s_suppkey IN (SELECT l_suppkey FROM demo.lineitem WHERE l_partkey IN (SELECT p_partkey FROM demo.part WHERE p_size < 10) GROUP BY l_suppkey HAVING sum(l_quantity) > 100) AND s_nationkey = n_nationkey ORDER BY s_name",
    "q21": "SELECT s_name, count(*) AS numwait FROM demo.supplier, demo.lineitem l1, demo.orders, demo.nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM demo.lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND s_nationkey = n_nationkey GROUP BY s_name",
    "q22": "SELECT c_nationkey, count(*) AS numcust, sum(c_acctbal) AS total FROM demo.customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM demo.customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM demo.orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY c_nationkey",
}
#: Trade data is released; persons stay masked.
RELEASED = {"demo.lineitem": ("l_extendedprice", "l_shipdate"), "demo.orders": ("o_orderdate", "o_orderpriority"), "demo.part": ("p_name", "p_brand", "p_type", "p_size")}
#: What is refused, and why; all else is served.
_ALWAYS = {"q07": "untrusted_function", "q10": "opaque_aggregate", "q15": "untrusted_function", "q17": "opaque_anonymous", "q18": "opaque_aggregate"}
REFUSED: dict[str, dict[str, str]] = {
    # sums of expressions over several columns have no single source, unless lineage may follow them
    "refuse": _ALWAYS | dict.fromkeys(("q01", "q03", "q05", "q06", "q12", "q13", "q19"), "opaque_aggregate") | dict.fromkeys(("q08", "q09", "q14"), "opaque_anonymous"),
    # left: year() is not trusted, max gives values back, a correlated average has no source, groups by a key are single rows
    "allow": _ALWAYS,
}


def _policy() -> dict:
    from .catalogue import POLICY

    return {t: {c: ({"mask": "none"} if c in RELEASED.get(t, ()) else rule) for c, rule in columns.items()} for t, columns in POLICY["columns"].items()}


def workload(spark: SparkSession, sf_dir: str, lineage: str) -> DataFrame:
    """Each statement of the workload: served or why not, and the rows of what is served."""
    from .catalogue import session

    guard = session(spark, sf_dir, columns=_policy(), lineage=lineage)
    rows = []
    for name, text in WORKLOAD.items():
        try:
            rows.append((name, "served", guard.sql(text).count()))
        except PolicyRejection as e:
            rows.append((name, e.cause.value, None))
    return spark.createDataFrame(rows, "statement string, verdict string, n_rows long")


def _sql(lineage: str) -> str:
    told = REFUSED[lineage]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS statement, '{told.get(n, 'served')}' AS verdict, {'NULL::BIGINT' if n in told else f'(SELECT count(*) FROM ({t.replace("demo.", "")}))'} AS n_rows" for n, t in WORKLOAD.items()
    )


def entries() -> dict[str, Entry]:
    return {"workload_strict": (partial(workload, lineage="refuse"), _sql("refuse")), "workload_lineage": (partial(workload, lineage="allow"), _sql("allow"))}
