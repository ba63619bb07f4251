"""The registered queries of the governed engine and their SQL.

All run under one example policy, over whole tables.  The SQL side writes each
mask out again in another dialect; keyed digests share only the padded keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalogue_keys
from . import catalogue_more as more
from . import catalogue_workload
from .errors import ConfigError, PolicyRejection
from .functions import masks
from .functions.keyed import Key, mac_sql
from .functions.scrub import PATTERNS, scrub
from .operators.classify import as_frame, check, propose
from .operators.corpus import survey
from .operators.coverage import coverage_diff, snapshot
from .operators.session import GuardedSession
from .sources.config import Config
from .sources.folders import new_folder
from .spec import Mask, MaskSpec
from .streaming.guard import masked_stream, rebinding

KEY = "demo-key-not-for-production"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
UNIQUE = {
    "demo.customer": [["c_custkey"]],
    "demo.orders": [["o_orderkey"]],
    "demo.lineitem": [["l_orderkey", "l_linenumber"]],
    "demo.events": [["event_id"]],
    "demo.part": [["p_partkey"]],
}
_NONE = {"mask": "none"}
POLICY = {
    "pseudonym_key": KEY,
    "unique_keys": UNIQUE,
    "role": [{"name": "support", "members": ["sam"]}, {"name": "analyst", "members": ["ann", "sam"]}],
    "semantic_type": [
        {"name": "person", "mask": "pseudonym", "keep": 3, "by_role": {"support": "inner"}},
        {"name": "day", "mask": "date-year", "by_role": {"analyst": "date-month"}},
    ],
    "columns": {
        "demo.region": {"r_regionkey": _NONE, "r_name": _NONE},
        "demo.nation": {"n_nationkey": _NONE, "n_name": _NONE, "n_regionkey": _NONE},
        "demo.customer": {"c_custkey": _NONE, "c_name": {"type": "person"}, "c_nationkey": _NONE, "c_acctbal": {"mask": "numeric-bucket", "bucket": 1000}, "c_mktsegment": _NONE},
        "demo.supplier": {"s_suppkey": _NONE, "s_name": {"mask": "hash", "domain": "supplier"}, "s_nationkey": _NONE, "s_acctbal": _NONE},
        "demo.part": {
            "p_partkey": _NONE, "p_name": {"mask": "partial"}, "p_brand": {"mask": "outer", "keep": 2}, "p_type": {"mask": "range", "start": 2, "end": 6},
            "p_size": {"mask": "numeric-bucket", "bucket": 10},
        },
        "demo.orders": {"o_orderkey": _NONE, "o_custkey": _NONE, "o_orderstatus": _NONE, "o_totalprice": _NONE, "o_orderdate": {"type": "day"}, "o_orderpriority": {"mask": "redact"}},
        "demo.lineitem": {
            "l_orderkey": _NONE, "l_partkey": _NONE, "l_suppkey": _NONE, "l_linenumber": _NONE, "l_quantity": _NONE, "l_extendedprice": {"mask": "numeric-bucket", "bucket": 500},
            "l_discount": _NONE, "l_returnflag": _NONE, "l_linestatus": _NONE, "l_shipdate": {"mask": "date-month"},
        },
        "demo.events": {
            "event_id": _NONE, "ts": {"mask": "date-month"}, "user_id": {"mask": "numeric-bucket", "bucket": 100}, "event_type": {"mask": "inner", "keep": 2}, "value": _NONE,
            "props": {"mask": "json", "json_schema": {"k": "integer"}, "json": {"/k": {"mask": "numeric-bucket", "bucket": 10}}},
        },
        "demo.documents": {"doc_id": _NONE, "text": {"mask": "scrub"}, "lang": _NONE, "source": {"mask": "pseudonym", "domain": "source"}, "n_chars": _NONE},
    },
}


def session(spark: SparkSession, sf_dir: str, **overlay: object) -> GuardedSession:
    guard = GuardedSession(spark, Config.build({**POLICY, **overlay}))
    for name in TABLES:
        frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "events":  # the string column holds JSON documents
            frame = frame.withColumn("props", F.col("props").alias("props", metadata={"logical_type": "json"}))
        guard.add_table(f"demo.{name}", frame)
    return guard


_KEY = Key(KEY.encode())


def _mac(column: str, domain: str | None, digits: int, salt: bytes = b"") -> str:
    return f"left({mac_sql(_KEY, f'encode({column})', domain, salt)}, {digits})"


def _floor(c: str, b: int) -> str:
    return f"floor({c} / {b}) * {b}"


def _stars(n: str) -> str:
    return f"repeat('*', ({n})::INT)"


_PERSON = _mac("c_name", "person", 16)
_BAL = _floor("c_acctbal", 1000)

#: name: (statement, SQL of the masked result)
STATEMENTS: dict[str, tuple[str, str]] = {
    "governed_join": (
        "SELECT c.c_custkey, c.c_name, c.c_acctbal, o.o_orderkey, o.o_orderdate, o.o_orderpriority FROM demo.customer c JOIN demo.orders o ON c.c_custkey = o.o_custkey",
        f"SELECT c_custkey, {_PERSON} AS c_name, {_BAL} AS c_acctbal, o_orderkey, date_trunc('year', o_orderdate) AS o_orderdate, '***' AS o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey",
    ),
    "mask_redact": ("SELECT o_orderkey, o_orderpriority FROM demo.orders", "SELECT o_orderkey, CASE WHEN o_orderpriority IS NOT NULL THEN '***' END AS o_orderpriority FROM orders"),
    "mask_partial": (
        "SELECT p_partkey, p_name FROM demo.part",
        f"SELECT p_partkey, CASE WHEN length(p_name) <= 4 THEN {_stars('length(p_name)')} ELSE {_stars('length(p_name) - 4')} || right(p_name, 4) END AS p_name FROM part",
    ),
    "mask_outer": (
        "SELECT p_partkey, p_brand FROM demo.part",
        f"SELECT p_partkey, CASE WHEN length(p_brand) <= 4 THEN {_stars('length(p_brand)')} ELSE '**' || substr(p_brand, 3, length(p_brand) - 4) || '**' END AS p_brand FROM part",
    ),
    "mask_range": (
        "SELECT p_partkey, p_type FROM demo.part",
        f"SELECT p_partkey, CASE WHEN length(p_type) <= 2 THEN {_stars('length(p_type)')} ELSE left(p_type, 2) || {_stars('least(6, length(p_type)) - 2')} || substr(p_type, least(6, length(p_type)) + 1) END AS p_type FROM part",
    ),
    "mask_inner": (
        "SELECT event_id, event_type FROM demo.events",
        f"SELECT event_id, CASE WHEN length(event_type) <= 4 THEN {_stars('length(event_type)')} ELSE left(event_type, 2) || {_stars('length(event_type) - 4')} || right(event_type, 2) END AS event_type FROM events",
    ),
    "mask_hash": ("SELECT s_suppkey, s_name FROM demo.supplier", f"SELECT s_suppkey, {_mac('s_name', 'supplier', 32)} AS s_name FROM supplier"),
    "mask_pseudonym": ("SELECT c_custkey, c_name FROM demo.customer", f"SELECT c_custkey, {_PERSON} AS c_name FROM customer"),
    "mask_date_year": ("SELECT o_orderkey, o_orderdate FROM demo.orders", "SELECT o_orderkey, date_trunc('year', o_orderdate) AS o_orderdate FROM orders"),
    "mask_date_month": ("SELECT l_orderkey, l_linenumber, l_shipdate FROM demo.lineitem", "SELECT l_orderkey, l_linenumber, date_trunc('month', l_shipdate) AS l_shipdate FROM lineitem"),
    "mask_bucket_int": ("SELECT p_partkey, p_size FROM demo.part", "SELECT p_partkey, (p_size - ((p_size % 10) + 10) % 10)::INT AS p_size FROM part"),
    "mask_bucket_long": ("SELECT event_id, user_id FROM demo.events", "SELECT event_id, user_id - ((user_id % 100) + 100) % 100 AS user_id FROM events"),
    "mask_bucket_double": ("SELECT c_custkey, c_acctbal FROM demo.customer", f"SELECT c_custkey, {_BAL} AS c_acctbal FROM customer"),
    "unclassified_type_aware": (
        "SELECT l_orderkey, l_linenumber, l_tax FROM demo.lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(NULL AS DOUBLE) AS l_tax FROM lineitem",
    ),
    "json_walk": (
        "SELECT event_id, props FROM demo.events",
        """SELECT event_id, CASE WHEN props IS NULL THEN NULL ELSE '{' || array_to_string(list_transform(list_sort(json_keys(props)), lambda x: '"' || x || '":' ||
        CASE WHEN x = 'k' THEN CAST(CAST(floor(CAST(json_extract_string(props, '$.' || x) AS DOUBLE) / 10) * 10 AS BIGINT) AS VARCHAR) ELSE 'null' END), ',') || '}' END AS props FROM events""",
    ),
    "select_star": ("SELECT * FROM demo.orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, date_trunc('year', o_orderdate) AS o_orderdate, '***' AS o_orderpriority FROM orders"),
    "filter_on_cleartext": (
        "SELECT c_custkey, c_name FROM demo.customer WHERE c_name LIKE '%7' AND c_acctbal > 500",
        f"SELECT c_custkey, {_PERSON} AS c_name FROM customer WHERE c_name LIKE '%7' AND c_acctbal > 500",
    ),
    "distinct": ("SELECT DISTINCT o_orderdate FROM demo.orders", "SELECT date_trunc('year', o_orderdate) AS o_orderdate FROM (SELECT DISTINCT o_orderdate FROM orders)"),
    "left_join": (
        "SELECT c.c_name, o.o_orderkey FROM demo.customer c LEFT JOIN demo.orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
        f"SELECT {_PERSON} AS c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    ),
    "full_join": (
        "SELECT n.n_name, r.r_name FROM demo.nation n FULL JOIN demo.region r ON n.n_regionkey = r.r_regionkey",
        "SELECT n_name, r_name FROM nation FULL JOIN region ON n_regionkey = r_regionkey",
    ),
    "right_join": (
        "SELECT c_nationkey AS k, n.n_name FROM demo.customer c RIGHT JOIN demo.nation n ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000",
        "SELECT c_nationkey AS k, n_name FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000",
    ),
    "join_using": (
        "SELECT k, a.c_name, b.c_mktsegment FROM (SELECT c_custkey k, c_name FROM demo.customer) a JOIN (SELECT c_custkey k, c_mktsegment FROM demo.customer) b USING (k)",
        f"SELECT c_custkey AS k, {_PERSON} AS c_name, c_mktsegment FROM customer",
    ),
    "natural_join": (
        "SELECT a.c_name, b.c_mktsegment FROM (SELECT c_custkey k, c_name FROM demo.customer) a NATURAL JOIN (SELECT c_custkey k, c_mktsegment FROM demo.customer) b",
        f"SELECT {_PERSON} AS c_name, c_mktsegment FROM customer",
    ),
    "identity_cast": ("SELECT c_custkey, CAST(c_name AS STRING) AS who FROM demo.customer", f"SELECT c_custkey, {_PERSON} AS who FROM customer"),
    "column_alias_list": ("SELECT t.b FROM demo.customer AS t(a, b, c, d, e)", f"SELECT {_PERSON} AS b FROM customer"),
    "pipe_syntax": ("FROM demo.customer |> WHERE c_acctbal > 0 |> SELECT c_custkey, c_name", f"SELECT c_custkey, {_PERSON} AS c_name FROM customer WHERE c_acctbal > 0"),
    "distribution_windows": (
        "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS quarter, dense_rank() OVER (ORDER BY s_nationkey) AS nation, count(*) OVER (PARTITION BY s_nationkey) AS n FROM demo.supplier",
        "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey)::INT AS quarter, dense_rank() OVER (ORDER BY s_nationkey)::INT AS nation, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier",
    ),
    "context_and_literals": ("SELECT r_regionkey, 1 + 2 AS three, current_date() >= DATE '2000-01-01' AS late FROM demo.region", "SELECT r_regionkey, 3 AS three, true AS late FROM region"),
    "semi_join": (
        "SELECT c_custkey, c_name FROM demo.customer c WHERE EXISTS (SELECT 1 FROM demo.orders o WHERE o.o_custkey = c.c_custkey)",
        f"SELECT c_custkey, {_PERSON} AS c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    ),
    "anti_join": (
        "SELECT c_custkey, c_name FROM demo.customer WHERE c_custkey NOT IN (SELECT o_custkey FROM demo.orders)",
        f"SELECT c_custkey, {_PERSON} AS c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    ),
    "self_join": (
        "SELECT a.c_custkey, b.c_name FROM demo.customer a JOIN demo.customer b ON a.c_custkey = b.c_custkey + 1",
        f"SELECT a.c_custkey, {_mac('b.c_name', 'person', 16)} AS c_name FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey + 1",
    ),
    "theta_join": (
        "SELECT r.r_name, n.n_name FROM demo.region r JOIN demo.nation n ON n.n_nationkey > r.r_regionkey * 5",
        "SELECT r_name, n_name FROM region JOIN nation ON n_nationkey > r_regionkey * 5",
    ),
    "cross_join_small": ("SELECT a.r_name, b.r_name AS other FROM demo.region a CROSS JOIN demo.region b", "SELECT a.r_name, b.r_name AS other FROM region a CROSS JOIN region b"),
    "lateral_join": (
        "SELECT n.n_name, x.r_name FROM demo.nation n, LATERAL (SELECT r.r_name FROM demo.region r WHERE r.r_regionkey = n.n_regionkey) x",
        "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey",
    ),
    "cte_subquery": (
        "WITH rich AS (SELECT c_custkey k, c_name nm FROM demo.customer WHERE c_acctbal > 5000) SELECT x.nm, o.o_orderkey FROM rich x JOIN demo.orders o ON o.o_custkey = x.k",
        f"SELECT {_PERSON} AS nm, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000",
    ),
    "group_keys_masked_after": (
        "SELECT o_orderdate, count(*) AS n FROM demo.orders GROUP BY o_orderdate",
        "SELECT date_trunc('year', d) AS o_orderdate, n FROM (SELECT o_orderdate AS d, count(*) AS n FROM orders GROUP BY 1)",
    ),
    "summary_masked": (
        "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_name) AS names, avg(c_acctbal) AS mean FROM demo.customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_name) AS names, floor(avg(c_acctbal) / 1000) * 1000 AS mean FROM customer GROUP BY 1",
    ),
    "summary_released": (
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(l_tax) AS taxed, max_of.n FROM demo.lineitem CROSS JOIN (SELECT count(*) AS n FROM demo.region) max_of GROUP BY l_returnflag, l_linestatus, max_of.n",
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(l_tax) AS taxed, 5::BIGINT AS n FROM lineitem GROUP BY 1, 2",
    ),
    "aggregate_filter": (
        "SELECT c_mktsegment, sum(c_acctbal) FILTER (WHERE c_acctbal > 0) AS s FROM demo.customer GROUP BY c_mktsegment HAVING count(*) > 1",
        "SELECT c_mktsegment, floor(sum(c_acctbal) FILTER (c_acctbal > 0) / 1000) * 1000 AS s FROM customer GROUP BY 1 HAVING count(*) > 1",
    ),
    "rollup_counts": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM demo.lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
    "cube_counts": (
        "SELECT o_orderstatus, count(*) AS n FROM demo.orders GROUP BY CUBE (o_orderstatus)",
        "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus)",
    ),
    "grouping_sets_counts": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM demo.lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    ),
    "window_ranking": (
        "SELECT s_suppkey, s_name, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM demo.supplier",
        f"SELECT s_suppkey, {_mac('s_name', 'supplier', 32)} AS s_name, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS place FROM supplier",
    ),
    "top_k": (
        "SELECT c_custkey, c_name FROM demo.customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5",
        f"SELECT c_custkey, {_PERSON} AS c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5",
    ),
    "date_trunc_year": (
        "SELECT date_trunc('year', o_orderdate) AS y, count(*) AS n FROM demo.orders GROUP BY date_trunc('year', o_orderdate)",
        "SELECT date_trunc('year', o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1",
    ),
    "case_constants": (
        "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS band, coalesce(NULL, 7) AS seven FROM demo.orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS band, 7 AS seven FROM orders",
    ),
}
STATEMENTS |= more.STATEMENTS_MORE

#: Statements under another policy or principal: (overlay, principal, statement, SQL).
VARIANTS: dict[str, tuple[dict, str | None, str, str]] = {
    "summary_moments": (
        {"lineage": "allow"},
        None,
        "SELECT l_returnflag, round(variance(l_quantity), 6) AS v, bool_and(l_quantity > 0) AS pos FROM demo.lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS v, bool_and(l_quantity > 0) AS pos FROM lineitem GROUP BY 1",
    ),
    "role_support": (
        {},
        "sam",
        "SELECT c_custkey, c_name FROM demo.customer",
        f"SELECT c_custkey, CASE WHEN length(c_name) <= 6 THEN {_stars('length(c_name)')} ELSE left(c_name, 3) || {_stars('length(c_name) - 6')} || right(c_name, 3) END AS c_name FROM customer",
    ),
    "role_analyst": ({}, "ann", "SELECT o_orderkey, o_orderdate FROM demo.orders", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS o_orderdate FROM orders"),
    "unclassified_null": ({"unclassified_mask": "null"}, None, "SELECT p_partkey, p_retailprice FROM demo.part", "SELECT p_partkey, CAST(NULL AS DOUBLE) AS p_retailprice FROM part"),
    "unclassified_allow": ({"unclassified": "allow"}, None, "SELECT p_partkey, p_retailprice FROM demo.part", "SELECT p_partkey, p_retailprice FROM part"),
    "opaque_masked": ({"opaque": "mask"}, None, "SELECT c_custkey, upper(c_name) AS u FROM demo.customer", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS u FROM customer"),
    "lineage_expression": (
        {"lineage": "allow"},
        None,
        "SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice, upper(o_orderstatus) AS s FROM demo.orders",
        "SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice, upper(o_orderstatus) AS s FROM orders",
    ),
    "lineage_union": (
        {"lineage": "allow"},
        None,
        "SELECT n_name AS name FROM demo.nation UNION SELECT r_name FROM demo.region",
        "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region",
    ),
    "lineage_intersect_except": (
        {"lineage": "allow"},
        None,
        "(SELECT c_nationkey AS k FROM demo.customer INTERSECT SELECT s_nationkey FROM demo.supplier) EXCEPT SELECT n_nationkey FROM demo.nation WHERE n_nationkey < 5",
        "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 5",
    ),
    "lineage_aggregate": (
        {"lineage": "allow"},
        None,
        "SELECT l_returnflag, round(sum(l_quantity) / count(*), 6) AS mean FROM demo.lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(sum(l_quantity) / count(*), 6) AS mean FROM lineitem GROUP BY 1",
    ),
    "hostile_projection": (
        {"posture": "hostile"},
        None,
        "SELECT c_custkey, c_name FROM demo.customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name",
        f"SELECT c_custkey, {_PERSON} AS c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "json_text_extract": (
        {},
        None,
        "SELECT event_id, get_json_object(props, '$.other') AS other FROM demo.events",
        "SELECT event_id, CAST(NULL AS VARCHAR) AS other FROM events",
    ),
}
VARIANTS |= more.VARIANTS_MORE


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        overlay, principal, text = VARIANTS[name][:3] if name in VARIANTS else ({}, None, STATEMENTS[name][0])
        return session(spark, sf_dir, **overlay).sql(text, principal)

    return run


# ------------------------------------------------- masks as column functions
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _email_pseudonyms(spark: SparkSession, sf_dir: str, keep_domain: bool) -> DataFrame:
    mail = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    return _table(spark, sf_dir, "customer").select("c_custkey", masks.pseudonym(mail, _KEY, "email", keep_domain).alias("mail"))


_MAIL = "(lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example')"
_HOST = "(lower(c_mktsegment) || '.example')"


def mask_pseudonym_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", masks.pseudonym_uuid(F.md5("c_name"), _KEY, "account").alias("id"))


def mask_ip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ip = F.concat_ws(".", F.lit("10"), k % 256, F.floor(k / 256) % 256, F.floor(k / 7) % 256)
    return _table(spark, sf_dir, "orders").select("o_orderkey", masks.ip_prefix(F.when(k % 3 == 0, F.concat(ip, F.lit("/32"))).otherwise(ip)).alias("ip"))


def mask_bucket_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.DecimalType(12, 2)
    return _table(spark, sf_dir, "orders").select("o_orderkey", masks.bucket(F.col("o_totalprice").cast(d), 250, d).alias("price"))


def mask_scrub_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns that need no word boundary, over all documents."""
    return _table(spark, sf_dir, "documents").select("doc_id", scrub(F.col("text"), PATTERNS[:2]).alias("text"))


def mask_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql("SELECT doc_id, text FROM demo.documents")


def mask_null_any_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events")
    null = MaskSpec(Mask.NULL)
    return t.select("event_id", *[masks.mask(F.col(f.name), null, f, _KEY).alias(f.name) for f in t.schema if f.name in ("ts", "value", "props")])


# --------------------------------------------------------- decisions as rows
REFUSALS = (
    ("aggregate over a hidden key", "SELECT avg(d) FROM demo.customer AS s(a, b, c, d, e) GROUP BY a + 0", "opaque_aggregate"),
    ("aggregate over a name", "SELECT max(c_name) FROM demo.customer", "untrusted_function"),
    ("alias of a union", "SELECT c_name FROM demo.customer UNION ALL SELECT c_name FROM demo.customer", "opaque_named_like_column"),
    ("cast that quotes", "SELECT c_custkey FROM demo.customer WHERE CAST(c_name AS INT) = 1", "opaque_function"),
    ("character set that quotes", "SELECT c_custkey FROM demo.customer WHERE encode('a', c_name) IS NULL", "opaque_function"),
    ("document that quotes", "SELECT c_custkey FROM demo.customer WHERE variant_get(parse_json(c_name), '$.a', 'int') = 1", "opaque_function"),
    ("format that quotes", "SELECT c_custkey FROM demo.customer WHERE format_string(c_name, 1) = 'x'", "opaque_function"),
    ("pattern that quotes", "SELECT c_custkey FROM demo.customer WHERE 'a' LIKE c_name", "opaque_function"),
    ("comparison that quotes", "SELECT c_custkey FROM demo.customer WHERE c_name = 5", "opaque_function"),
    ("copy", "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT * FROM demo.customer", "copy_stream"),
    ("create table as", "CREATE TABLE t AS SELECT * FROM demo.customer", "write_refused"),
    ("cursor", "EXECUTE IMMEDIATE 'SELECT 1'", "sql_prepare_cursor"),
    ("date behind a list", "SELECT date_trunc('day', e) FROM demo.orders AS s(a, b, c, d, e, f)", "opaque_function"),
    ("date behind a query", "SELECT date_trunc('day', e) FROM (SELECT * FROM demo.orders) AS s(a, b, c, d, e, f)", "opaque_function"),
    ("date behind a name", "WITH s(a, b, c, d, e, f) AS (SELECT * FROM demo.orders) SELECT date_trunc('month', e) FROM s", "opaque_function"),
    ("date compared", "SELECT date_trunc('day', e) = TIMESTAMP '1995-01-01' AS same FROM demo.orders AS s(a, b, c, d, e, f)", "opaque_anonymous"),
    ("explain", "EXPLAIN SELECT * FROM demo.customer", "write_refused"),
    ("expression", "SELECT upper(c_name) FROM demo.customer", "opaque_function"),
    ("file by path", "SELECT * FROM parquet.`/tmp/never`", "leaky_catalog"),
    ("function of rows", "SELECT * FROM range(3)", "untrusted_function"),
    ("group of one", "SELECT c_custkey, avg(c_acctbal) FROM demo.customer GROUP BY c_custkey", "opaque_aggregate"),
    ("identifier of a column", "SELECT IDENTIFIER('c_name') FROM demo.customer", "leaky_catalog"),
    ("identifier of a file", "SELECT count(*) FROM IDENTIFIER('text.`/etc/hosts`')", "leaky_catalog"),
    ("identifier of a function", "SELECT 1 WHERE IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.name') = 'root'", "leaky_catalog"),
    ("identifier of a table", "SELECT c_name FROM IDENTIFIER('demo.customer')", "leaky_catalog"),
    ("insert", "INSERT INTO demo.customer SELECT * FROM demo.customer", "write_refused"),
    ("java", "SELECT reflect('java.lang.System', 'getenv')", "untrusted_function"),
    ("not SQL", "SELEC 1", "malformed"),
    ("scalar subquery", "SELECT (SELECT count(c_name) FROM demo.customer) AS n", "opaque_anonymous"),
    ("statistics", "DESCRIBE EXTENDED demo.customer", "leaky_catalog"),
    ("two statements", "SELECT 1; SELECT 2", "malformed"),
    ("unpivoted columns", "SELECT v FROM (SELECT c_mktsegment, c_name FROM demo.customer) UNPIVOT (v FOR k IN (c_mktsegment, c_name))", "opaque_anonymous"),
    ("windowed sum", "SELECT sum(c_acctbal) OVER (ORDER BY c_custkey ROWS 0 PRECEDING) FROM demo.customer", "opaque_aggregate"),
)
HOSTILE = (
    ("filter", "SELECT c_custkey FROM demo.customer WHERE c_name = 'x'", "hostile_masked_use"),
    ("group", "SELECT count(*) FROM demo.customer GROUP BY c_name", "hostile_masked_use"),
    ("join", "SELECT a.c_custkey FROM demo.customer a JOIN demo.customer b ON a.c_name = b.c_name", "hostile_masked_use"),
    ("order by test", "SELECT c_custkey FROM demo.customer ORDER BY c_name = 'x'", "hostile_masked_use"),
    ("plain order", "SELECT c_custkey, c_name FROM demo.customer ORDER BY c_name", "served"),
    ("set operation", "SELECT c_name FROM demo.customer UNION SELECT c_name FROM demo.customer", "hostile_masked_use"),
    ("unpivot", "SELECT v FROM (SELECT c_mktsegment, c_name FROM demo.customer) UNPIVOT (v FOR k IN (c_mktsegment, c_name))", "hostile_masked_use"),
    ("identifier of a function", "SELECT 1 WHERE IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.name') = 'root'", "leaky_catalog"),
    ("whole row", "SELECT concat(c_name, c_name) FROM demo.customer", "hostile_masked_use"),
)


def _verdicts(spark: SparkSession, sf_dir: str, cases: tuple, **overlay: object) -> DataFrame:
    guard = session(spark, sf_dir, **overlay)
    rows = []
    for name, text, _ in cases:
        try:
            guard.sql(text)
            rows.append((name, "served"))
        except PolicyRejection as e:
            rows.append((name, e.cause.value))
    return spark.createDataFrame(rows, "case_name string, verdict string")


def _values(names: str, rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy files that must not load."""
    rows = []
    for name, change in CONFIG_ERRORS:
        try:
            Config.build({**POLICY, **change})
            rows.append((name, "loaded"))
        except ConfigError:
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "case_name string, verdict string")


CONFIG_ERRORS = (
    ("bucket of one", {"columns": {"a.b": {"c": {"mask": "numeric-bucket", "bucket": 1}}}}),
    ("duplicate rule", {"column": [{"relation": "Demo.Customer", "column": "C_NAME", "mask": "none"}]}),
    ("empty range", {"columns": {"a.b": {"c": {"mask": "range", "start": 3, "end": 3}}}}),
    ("json parameter elsewhere", {"columns": {"a.b": {"c": {"mask": "redact", "json_unlisted": "null"}}}}),
    ("short key", {"pseudonym_key": "short"}),
    ("unknown key", {"surprise": 1}),
    ("unknown mask", {"columns": {"a.b": {"c": {"mask": "blur"}}}}),
    ("unknown type", {"columns": {"a.b": {"c": {"type": "nobody"}}}}),
    ("wildcards that overlap", {"columns": {"a.b": {"c": {"mask": "json", "json": {"/a/*/0": "null", "/a/0/*": "null"}}}}}),
)


def role_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Config.build(POLICY)
    rows = [(p or "nobody", ".".join(c), config.rules[c].for_roles(config.roles_of(p)).mask.value) for p in (None, "ann", "sam") for c in (("demo.customer", "c_name"), ("demo.orders", "o_orderdate"))]
    return spark.createDataFrame(rows, "principal string, column_name string, mask string")


ROLE_ROWS = [
    ("nobody", "demo.customer.c_name", "pseudonym"), ("nobody", "demo.orders.o_orderdate", "date-year"), ("ann", "demo.customer.c_name", "pseudonym"),
    ("ann", "demo.orders.o_orderdate", "date-month"), ("sam", "demo.customer.c_name", "inner"), ("sam", "demo.orders.o_orderdate", "date-month"),
]


def corpus_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals by cause over all statements of this module."""
    texts = {k: v[0] for k, v in STATEMENTS.items()} | {n: t for n, t, _ in REFUSALS}
    report = survey(session(spark, sf_dir), texts)
    return spark.createDataFrame(sorted(report.causes.items()), "cause string, n long")


def field_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    guard = session(spark, sf_dir)
    plans = guard.decisions("SELECT c_custkey, c_name, c_acctbal, 1 AS one, p.p_retailprice FROM demo.customer CROSS JOIN demo.part p")
    return spark.createDataFrame([(p.name, p.spec.mask.value, p.why) for p in plans], "field string, mask string, why string")


DECISION_ROWS = [("c_custkey", "none", "rule"), ("c_name", "pseudonym", "rule"), ("c_acctbal", "numeric-bucket", "rule"), ("one", "none", "releasable"), ("p_retailprice", "null", "unclassified")]


# ---------------------------------------------------- classifier and drift
def classify_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {f"demo.{t}": _table(spark, sf_dir, t) for t in TABLES}
    return as_frame(spark, propose(tables)).filter("semantic_type IS NOT NULL")


PROPOSED = [("demo.events", "user_id", "bigint", "account_id", "pseudonym", "needs-review")]


def classify_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors over columns that hold card numbers, addresses and phone numbers under dull names."""
    k = F.col("o_orderkey")
    made = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("user"), k, F.lit("@mail.example")).alias("col_1"),
        F.concat_ws(".", F.lit("192.168"), k % 256, F.lit("7")).alias("col_2"),
        F.concat(F.lit("555-01"), F.lpad((k % 100).cast("string"), 2, "0")).alias("col_3"),
        F.lit("4111 1111 1111 1111").alias("col_4"),
        F.col("o_orderpriority").alias("col_5"),
    )
    rows = [(p.column, p.semantic_type, p.mask, p.note) for p in propose({"demo.t": made}, sample=1000)]
    return spark.createDataFrame(rows, "column_name string, semantic_type string, mask string, note string")


SHAPES = [
    ("col_1", "unidentified", "null", "values look like email"), ("col_2", "unidentified", "null", "values look like ip_address or phone"),
    ("col_3", "unidentified", "null", "values look like phone"), ("col_4", "unidentified", "null", "values look like payment"), ("col_5", None, "none", ""),
]


def classify_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {f"demo.{t}": _table(spark, sf_dir, t) for t in TABLES}
    columns = {**POLICY["columns"], "demo.gone": {"x": _NONE}}
    columns["demo.nation"] = {**columns["demo.nation"], "n_nationkey": {"mask": "redact"}}
    return spark.createDataFrame(check(Config.build({**POLICY, "columns": columns}), tables), "problem string, relation string, column_name string")


CHECKED = [
    ("mask_does_not_fit", "demo.events", "props"), ("mask_does_not_fit", "demo.nation", "n_nationkey"), ("missing_rule", "demo.lineitem", "l_tax"),
    ("missing_rule", "demo.part", "p_retailprice"), ("stale_rule", "demo.gone", "x"),
]


def coverage_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {f"demo.{n}": _table(spark, sf_dir, n) for n in ("customer", "supplier")}
    old = snapshot(spark, t)
    t["demo.customer"] = t["demo.customer"].select("c_name", "c_custkey", "c_acctbal", "c_nationkey")
    t["demo.region"] = _table(spark, sf_dir, "region")
    rules = spark.createDataFrame(list(Config.build(POLICY).rules), "relation string, column_name string")
    return coverage_diff(old, snapshot(spark, t), rules)


CHANGES = [
    ("demo.customer", "c_custkey", "moved"), ("demo.customer", "c_name", "moved"), ("demo.customer", "c_nationkey", "moved"), ("demo.customer", "c_acctbal", "moved"),
    ("demo.customer", "c_mktsegment", "lost"), ("demo.region", "r_regionkey", "restored"), ("demo.region", "r_name", "restored"),
]


# ------------------------------------------------------------------ streams
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def stream_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, masked, and written to files by the tasks: no row goes through the driver."""
    guard = session(spark, sf_dir)
    path = new_folder(spark, "masked_events")
    out = masked_stream(guard, "demo.events", _stream(spark, sf_dir))
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def stream_rebinding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreachBatch sink under the policy of its moment: here one that releases user_id."""
    guard = session(spark, sf_dir)
    columns = {**POLICY["columns"], "demo.events": {**POLICY["columns"]["demo.events"], "user_id": _NONE}}
    guard.reload(Config.build({**POLICY, "columns": columns}))
    path = new_folder(spark, "rebound_events")

    def sink(batch: DataFrame, number: int) -> None:  # a batch that is run again replaces its own rows
        batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    frame = _stream(spark, sf_dir).select("event_id", "user_id")
    frame.writeStream.foreachBatch(rebinding(guard, "demo.events", sink)).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("user_id").agg(F.sum("n").alias("n"))


_PROPS = STATEMENTS["json_walk"][1].split("event_id, ", 1)[1].rsplit(" FROM", 1)[0]
_EVENT_TYPE = STATEMENTS["mask_inner"][1].split("event_id, ", 1)[1].rsplit(" FROM", 1)[0]

OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "mask_pseudonym_email": (
        partial(_email_pseudonyms, keep_domain=False),
        f"SELECT c_custkey, {_mac(_MAIL, 'email', 16)} || '@' || {_mac(_HOST, 'email', 8, b'domain' + bytes(1))} || '.invalid' AS mail FROM customer",
    ),
    "mask_pseudonym_keep_domain": (partial(_email_pseudonyms, keep_domain=True), f"SELECT c_custkey, {_mac(_MAIL, 'email', 16)} || '@' || {_HOST} AS mail FROM customer"),
    "mask_pseudonym_uuid": (
        mask_pseudonym_uuid,
        "SELECT c_custkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-4' || substr(d, 14, 3) || '-' || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id "
        f"FROM (SELECT c_custkey, left({mac_sql(_KEY, 'unhex(md5(c_name))', 'account')}, 32) AS d FROM customer)",
    ),
    "mask_ip_prefix": (
        mask_ip_prefix,
        "SELECT o_orderkey, '10.' || (o_orderkey % 256) || '.' || ((o_orderkey // 256) % 256) || '.0' || CASE WHEN o_orderkey % 3 = 0 THEN '/24' ELSE '' END AS ip FROM orders",
    ),
    "mask_bucket_decimal": (mask_bucket_decimal, "SELECT o_orderkey, CAST(floor(CAST(o_totalprice AS DECIMAL(12,2)) / 250) * 250 AS DECIMAL(12,2)) AS price FROM orders"),
    "mask_scrub_simple": (
        mask_scrub_simple,
        r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g'), 'https?://[^\s]+', '<URL>', 'g') AS text FROM documents",
    ),
    "mask_scrub": (mask_scrub, more.scrub_sql("documents", "doc_id", "text")),
    "mask_null_any_type": (mask_null_any_type, "SELECT event_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS props FROM events"),
    "refusals": (partial(_verdicts, cases=REFUSALS), _values("case_name, verdict", [(n, v) for n, _, v in REFUSALS])),
    "refusals_hostile": (partial(_verdicts, cases=HOSTILE, posture="hostile"), _values("case_name, verdict", [(n, v) for n, _, v in HOSTILE])),
    "config_errors": (config_errors, _values("case_name, verdict", [(n, "refused") for n, _ in CONFIG_ERRORS])),
    "role_resolution": (role_resolution, _values("principal, column_name, mask", ROLE_ROWS)),
    "corpus_survey": (corpus_survey, "SELECT verdict AS cause, count(*) AS n FROM (" + _values("case_name, verdict", [(n, v) for n, _, v in REFUSALS]) + ") GROUP BY 1"),
    "field_decisions": (field_decisions, _values("field, mask, why", DECISION_ROWS)),
    "classify_propose": (classify_propose, _values("relation, column_name, data_type, semantic_type, mask, confidence", PROPOSED)),
    "classify_shapes": (classify_shapes, _values("column_name, semantic_type, mask, note", SHAPES)),
    "classify_check": (classify_check, _values("problem, relation, column_name", CHECKED)),
    "coverage_diff": (coverage_changes, _values("relation, column_name, change", CHANGES)),
    "stream_masked": (
        stream_masked,
        f"SELECT event_id, date_trunc('month', ts) AS ts, user_id - ((user_id % 100) + 100) % 100 AS user_id, {_EVENT_TYPE}, value, {_PROPS} FROM events",
    ),
    "stream_rebinding": (stream_rebinding, "SELECT user_id, count(*) AS n FROM events GROUP BY 1"),
} | more.entries(lambda column: _mac(column, "supplier", 32)) | catalogue_keys.entries() | catalogue_workload.entries()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _statement(k) for k in (*STATEMENTS, *VARIANTS)} | {k: f for k, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    told = {k: v[-1] for k, v in (*STATEMENTS.items(), *VARIANTS.items())}
    return told | {k: sql for k, (_, sql) in OTHERS.items() if sql is not None}
