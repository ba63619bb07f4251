"""More registered queries: scrub patterns, detectors, JSON rules, IPv6, aggregates, the leak campaign."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import masks
from .functions.keyed import Key
from .functions.scrub import IBAN_LENGTH, PATTERNS, scrub
from .operators import campaign, differential, roles
from .operators.classify import DETECTORS
from .sources.folders import new_folder
from .spec import Mask, MaskSpec

_KEY = Key(b"demo-key-not-for-production")
Entry = tuple[Callable[[SparkSession, str], DataFrame], str]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ------------------------------------------------------------- scrub, in SQL
_DIGITS = "regexp_replace({m}, '[^0-9]', '', 'g')"


def _sql_valid(kind: str, m: str) -> str:
    """The validators again, for DuckDB; ``m`` is the match."""
    if kind == "luhn":
        d = f"reverse(regexp_replace({m}, '[ -]', '', 'g'))"
        return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {d}[i]::INT WHEN {d}[i]::INT > 4 THEN {d}[i]::INT * 2 - 9 ELSE {d}[i]::INT * 2 END)) % 10 = 0)"
    if kind == "iban":
        known = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in IBAN_LENGTH.items()) + "}"
        digits = f"list_aggregate(list_transform(string_split({m}[5:] || {m}[:4], ''), lambda x: CASE WHEN x >= 'A' THEN (ascii(x) - 55)::VARCHAR ELSE x END), 'string_agg', '')"
        rest = lambda before, a: f"(({before} || {digits}[{a}:{a + 34}])::HUGEINT % 97)::VARCHAR"
        return f"coalesce({known}[left({m}, 2)] = length({m}) AND {rest(rest("''", 1), 36)} = '1', false)"
    d = _DIGITS.format(m=m)
    if kind == "nhs":
        total = f"list_sum(list_transform(range(1, 10), lambda i: {d}[i]::INT * (11 - i)))"
        return f"(length({d}) = 10 AND (11 - {total} % 11) % 11 = {d}[10]::INT)"
    return f"(length({d}) BETWEEN 7 AND CASE WHEN left(ltrim({m}), 1) = '+' THEN 15 ELSE 11 END)"


def scrub_sql(source: str, key: str, text: str) -> str:
    """All patterns over ``text``, each where it matched the text as it came in."""
    steps = [f"s0 AS (SELECT {key}, {text} AS o, {text} AS t FROM {source})"]
    for n, (label, pattern, validator) in enumerate(PATTERNS):
        p = _lit(pattern)
        if validator is None:
            new = f"regexp_replace(t, {p}, {_lit(label)}, 'g')"
        else:
            parts, found = f"string_split_regex(t, {p})", f"regexp_extract_all(t, {p})"
            m = f"{found}[j]"
            new = f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda j: {parts}[j] || CASE WHEN j > len({found}) THEN '' WHEN {_sql_valid(validator, m)} THEN {_lit(label)} ELSE {m} END), '')"
        steps.append(f"s{n + 1} AS (SELECT {key}, o, CASE WHEN regexp_matches(o, {p}) THEN {new} ELSE t END AS t FROM s{n})")
    return f"WITH {', '.join(steps)} SELECT {key}, t AS {text} FROM s{len(PATTERNS)}"


#: (text, what is left of it): each pattern with a value that is valid and, where it has a validator, one that is not.
SCRUBBED = (
    ("mail ann.lee+x@mail.example now", "mail <EMAIL> now"), ("see https://a.example/p?q=1 there", "see <URL> there"),
    ("id 123e4567-e89b-12d3-a456-426614174000.", "id <UUID>."), ("at 00:1A:2b:3C:4d:5E,", "at <MAC>,"), ("pay GB82WEST12345698765432 soon", "pay <IBAN> soon"),
    ("pay GB82WEST12345698765431 soon", "pay GB82WEST12345698765431 soon"), ("card 4111-1111-1111-1111 ok", "card <CARD> ok"), ("ssn 123-45-6789 ok", "ssn <NATIONAL_ID> ok"),
    ("nhs 9434765919 ok", "nhs <NATIONAL_ID> ok"), ("nino AB123456C ok", "nino <NATIONAL_ID> ok"), ("post SW1A 1AA ok", "post <POSTCODE> ok"),
    ("eth 0x52908400098527886E0F7030069857D2E4169EE7 ok", "eth <CRYPTO> ok"), ("ip 10.20.30.40 ok", "ip <IP> ok"), ("call +44 20 7946 0958 ok", "call <PHONE> ok"),
    ("call 555-0199 ok", "call <PHONE> ok"), ("nothing here", "nothing here"), ("one 1 and 22 two", "one 1 and 22 two"),
)


def mask_scrub_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern and validator, over texts that number the orders."""
    k = F.col("o_orderkey")
    texts = F.array(*[F.lit(t) for t, _ in SCRUBBED])
    return _orders(spark, sf_dir).select("o_orderkey", scrub(F.concat_ws(" | ", F.get(texts, (k % len(SCRUBBED)).cast("int")), F.get(texts, ((k + 5) % len(SCRUBBED)).cast("int")))).alias("text"))


_TEXTS = "[" + ", ".join(_lit(t) for _, t in SCRUBBED) + "]"
SCRUB_PATTERNS_SQL = f"SELECT o_orderkey, {_TEXTS}[o_orderkey % {len(SCRUBBED)} + 1] || ' | ' || {_TEXTS}[(o_orderkey + 5) % {len(SCRUBBED)} + 1] AS text FROM orders"


# ----------------------------------------------------------------- detectors
#: (value, the detectors that take it).
DETECTED = (
    ("ann@mail.example", {3}), ("@mail.example", set()), ("10.1.2.3", {4}), ("10.1.2.300", {5}), ("fe80::1", {4}), ("fe80::1::2", set()), ("+44 20 7946 0958", {5}), ("12345", set()),
    ("4111 1111 1111 1111", {0}), ("4111 1111 1111 1112", set()), ("GB82 WEST 1234 5698 7654 32", {1}), ("GB82 WEST 1234 5698 7654 33", set()), ("123-45-6789", {2, 5}), ("000-45-6789", {5}), ("plain", set()),
)
NAMES = ("card", "iban", "ssn", "email", "ip", "phone")


def detector_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each detector takes, over values that number the orders and over all documents."""
    k = F.col("o_orderkey")
    values = _orders(spark, sf_dir).select(F.get(F.array(*[F.lit(v) for v, _ in DETECTED]), (k % len(DETECTED)).cast("int")).alias("v"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("v"))
    count = lambda d: F.sum(F.coalesce(d(F.col("v")), F.lit(False)).cast("long"))
    hits = values.unionAll(docs).agg(*[count(d).alias(n) for n, (_, d) in zip(NAMES, DETECTORS, strict=True)])
    return hits.unpivot([], list(NAMES), "detector", "hits")


def _detector_sql(n: int) -> str:
    there = [str(i) for i, (_, takes) in enumerate(DETECTED) if n in takes]
    listed = f"(SELECT count(*) FROM orders WHERE o_orderkey % {len(DETECTED)} IN ({', '.join(there)}))"
    bare = "regexp_replace(text, '[ -]', '', 'g')"
    own = {
        "email": r"regexp_matches(trim(text, ' '), '(?s)^[^@]+@[^.].*\.')",
        "ip": r"regexp_matches(trim(text, ' '), '^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}$')",
        "phone": rf"length({_DIGITS.format(m='text')}) BETWEEN 7 AND 15 AND regexp_full_match(text, '[0-9 ()+.\-]*')",
        "card": f"regexp_full_match({bare}, '[0-9]{{13,19}}') AND {_sql_valid('luhn', 'text')}",
        "iban": "false AND regexp_full_match(upper(replace(text, ' ', '')), '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}')",
        "ssn": f"regexp_full_match({bare}, '[0-9]{{9}}') AND left({bare}, 3) NOT IN ('000', '666') AND left({bare}, 1) <> '9' AND substr({bare}, 4, 2) <> '00' AND substr({bare}, 6) <> '0000'",
    }[NAMES[n]]
    return f"SELECT '{NAMES[n]}' AS detector, ({listed} + (SELECT count(*) FROM documents WHERE {own}))::BIGINT AS hits"


# ----------------------------------------------------------------- addresses
def mask_ip_prefix_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 in several spellings, with zones, sizes and embedded IPv4, and what is no address."""
    k = F.col("o_orderkey")
    part = F.lower(F.hex(k % 65535 + 1))
    spelled = F.array(
        F.concat(F.lit("2001:DB8:"), part, F.lit("::1")), F.concat(F.lit("2001:db8:0:"), part, F.lit(":1:2:3:4/64")), F.concat(F.lit("fe80::"), part, F.lit("%eth0")),
        F.concat(F.lit("::ffff:10.0.0."), (k % 256).cast("string")), F.concat(F.lit("1::"), part, F.lit("::2")), F.concat(part, F.lit(":0:0:1:2:3:4:5")),
    )
    return _orders(spark, sf_dir).select("o_orderkey", masks.ip_prefix(F.get(spelled, (k % 6).cast("int"))).alias("ip"))


_PART = "lower(format('{:x}', o_orderkey % 65535 + 1))"
IP_V6_SQL = f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '2001:db8:' || {_PART} || '::' WHEN 1 THEN '2001:db8::/48' WHEN 2 THEN 'fe80::' WHEN 3 THEN '::'
WHEN 4 THEN repeat('*', (6 + length({_PART}))::INT) ELSE {_PART} || '::' END AS ip FROM orders"""


# ----------------------------------------------------------------------- JSON
_SPECS = (
    ("/tags/*/n", MaskSpec(Mask.NUMERIC_BUCKET, bucket=10)),
    ("/tags/1/t", MaskSpec(Mask.NONE)),
    ("/deep/mail", MaskSpec(Mask.REDACT)),
)


#: What the documents of json_unlisted look like.
_SHAPE = {"id": "integer", "name": "string", "tags": [{"t": "string", "n": "number"}], "deep": {"mail": "string", "name": "string", "ok": "boolean", "none": "string"}}


def json_unlisted(spark: SparkSession, sf_dir: str, unlisted: str, declared: bool = False) -> DataFrame:
    """Wildcards, an index that beats one, a key rule at any depth, and each treatment of unlisted leaves; ``declared``: by expressions."""
    k = F.col("o_orderkey").cast("string")
    document = F.concat(
        F.lit('{"id":'), k, F.lit(',"name":"n'), k, F.lit('","tags":[{"t":"a'), k, F.lit('","n":'), (F.col("o_orderkey") % 100).cast("string"), F.lit('},{"t":"b","n":7.5}],"deep":{"mail":"u'), k,
        F.lit('@x.example","name":"in","ok":true,"none":null}}'),
    )
    spec = MaskSpec(Mask.JSON, json_schema=json.dumps(_SHAPE) if declared else None, json_unlisted=unlisted, json=_SPECS, json_keys=(("name", MaskSpec(Mask.PARTIAL, keep=1)),))
    field = T.StructField("doc", T.StringType(), metadata={"logical_type": "json"})
    return _orders(spark, sf_dir).select("o_orderkey", masks.mask(document, spec, field, _KEY).alias("doc"))


def _json_sql(flag: str, number: str, text: str) -> str:
    name = "repeat('*', length(o_orderkey::VARCHAR)::INT) || right('n' || o_orderkey, 1)"
    return (
        f"""SELECT o_orderkey, '{{"deep":{{"mail":"***","name":"*n","none":null,"ok":{flag}}},"id":' || {number} || ',"name":"' || {name} || '","tags":[{{"n":' || (o_orderkey % 100) // 10 * 10 || ',"t":' || {text} || '}},"""
        """{"n":0,"t":"b"}]}' AS doc FROM orders"""
    )


def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document taken from under a path keeps the rules that hold there."""
    from .catalogue import session

    out = session(spark, sf_dir).sql("SELECT event_id, variant_get(parse_json(props), '$.k', 'variant') AS k FROM demo.events")
    return out.select("event_id", F.to_json("k").alias("k"))


# ---------------------------------------------------------------- aggregates
_ONE = ("sum", "avg", "mean", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp")
_TWO = ("corr", "covar_pop", "covar_samp", "regr_avgx", "regr_avgy", "regr_count", "regr_intercept", "regr_r2", "regr_slope", "regr_sxx", "regr_sxy", "regr_syy")
_CALLS = [f"round({f}(l_quantity), 3) AS {f}_q" for f in _ONE] + [f"round({f}(l_discount, l_quantity), 3) AS {f}_dq" for f in _TWO] + ["bool_and(l_quantity > 0) AS all_q", "bool_or(l_quantity > 49) AS any_q", "count(l_quantity) AS n_q"]
AGGREGATES = f"SELECT l_returnflag, {', '.join(_CALLS)}, every(l_quantity > 1) AS every_q FROM demo.lineitem GROUP BY l_returnflag"
AGGREGATES_SQL = f"SELECT l_returnflag, {', '.join(_CALLS)}, bool_and(l_quantity > 1) AS every_q FROM lineitem GROUP BY l_returnflag"

_SEGMENT = "c_mktsegment"
TEXTS = (
    f"lower({_SEGMENT}) AS a, upper({_SEGMENT}) AS b, length({_SEGMENT}) AS c, substring({_SEGMENT}, 2, 3) AS d, left({_SEGMENT}, 2) AS e, right({_SEGMENT}, 2) AS f, replace({_SEGMENT}, 'A', 'x') AS g, "
    f"concat({_SEGMENT}, '-', {_SEGMENT}) AS h, reverse({_SEGMENT}) AS i, trim({_SEGMENT}) AS j, repeat({_SEGMENT}, 2) AS k, translate({_SEGMENT}, 'AB', 'ab') AS l, ascii({_SEGMENT}) AS m, md5({_SEGMENT}) AS n"
)
NUMBERS = "abs(s_nationkey - 12) AS a, round(s_nationkey / 7, 3) AS b, CAST(ceil(s_nationkey / 3) AS INT) AS c, CAST(floor(s_nationkey / 3) AS INT) AS d, CAST(sign(s_nationkey - 5) AS INT) AS e, greatest(s_nationkey, 5) AS f, least(s_nationkey, 5) AS g, nullif(s_nationkey, 3) AS h, coalesce(nullif(s_nationkey, 3), -1) AS i"

_PERSON_COLUMNS = "c_custkey, c_name"
STATEMENTS_MORE: dict[str, tuple[str, str]] = {
    "tablesample_all": ("SELECT l_orderkey, l_linenumber FROM demo.lineitem TABLESAMPLE (100 PERCENT)", "SELECT l_orderkey, l_linenumber FROM lineitem"),
    "values_rows": ("SELECT t.a, t.b FROM VALUES (1, 'x'), (2, 'y') AS t(a, b)", "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) t(a, b)"),
    "values_joined": (
        "SELECT v.label, r.r_name FROM demo.region r JOIN (VALUES (0, 'zero'), (1, 'one')) AS v(k, label) ON r.r_regionkey = v.k",
        "SELECT v.label, r_name FROM region JOIN (VALUES (0, 'zero'), (1, 'one')) v(k, label) ON r_regionkey = v.k",
    ),
    "more_windows": (
        "SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS p, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM demo.supplier",
        "SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal, s_suppkey), 9) AS p, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::INT AS i FROM supplier",
    ),
    "cume_dist_windows": (
        "SELECT s_suppkey, cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS share FROM demo.supplier",
        "SELECT s_suppkey, cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS share FROM supplier",
    ),
    "full_join_on_using": (
        "SELECT x.n_name, y.r_name FROM (SELECT n_regionkey AS k, n_name FROM demo.nation) x FULL JOIN (SELECT r_regionkey + 1 AS k, r_name FROM demo.region) y USING (k)",
        "SELECT x.n_name, y.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) x FULL JOIN (SELECT r_regionkey + 1 AS k, r_name FROM region) y USING (k)",
    ),
}
VARIANTS_MORE: dict[str, tuple[dict, str | None, str, str]] = {
    "reducing_aggregates": ({"lineage": "allow"}, None, AGGREGATES, AGGREGATES_SQL),
    "lineage_texts": ({"lineage": "allow"}, None, f"SELECT c_custkey, {TEXTS} FROM demo.customer", f"SELECT c_custkey, {TEXTS} FROM customer"),
    "lineage_numbers": ({"lineage": "allow"}, None, f"SELECT s_suppkey, {NUMBERS} FROM demo.supplier", f"SELECT s_suppkey, {NUMBERS} FROM supplier"),
    "lineage_unpivot": (
        {"lineage": "allow"},
        None,
        "SELECT n_nationkey, k, v FROM (SELECT n_nationkey, n_regionkey AS a, n_nationkey AS b FROM demo.nation) UNPIVOT (v FOR k IN (a, b))",
        "SELECT n_nationkey, k, v FROM (SELECT n_nationkey, 'a' AS k, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_nationkey FROM nation)",
    ),
    "unpivot_masked": (
        {"opaque": "mask"},
        None,
        "SELECT v FROM (SELECT c_mktsegment, c_name FROM demo.customer) UNPIVOT (v FOR k IN (c_mktsegment, c_name))",
        "SELECT CAST(NULL AS VARCHAR) AS v FROM customer, range(2)",
    ),
    "hostile_order_by": ({"posture": "hostile"}, None, "SELECT p_partkey, p_name FROM demo.part ORDER BY p_name", "SELECT p_partkey, CASE WHEN length(p_name) <= 4 THEN repeat('*', length(p_name)::INT) ELSE repeat('*', (length(p_name) - 4)::INT) || right(p_name, 4) END AS p_name FROM part"),
}


# --------------------------------------------------------------------- views
def view_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered view is a relation of its own: the rules of the tables below it are not its rules."""
    from .catalogue import POLICY, session

    rules = {**POLICY["columns"], "demo.rich": {"k": {"mask": "none"}, "who": {"mask": "partial", "keep": 2}}}
    guard = session(spark, sf_dir, columns=rules)
    guard.add_table("demo.rich", spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal > 0").selectExpr("c_custkey AS k", "c_name AS who"))
    return guard.sql("SELECT k, who FROM demo.rich")


def opaque_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over a set operation has no single source: its columns are withheld, released ones too."""
    from .catalogue import POLICY, session

    rules = {**POLICY["columns"], "demo.both": {"name": {"mask": "none"}}}
    guard = session(spark, sf_dir, columns=rules, opaque="mask")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    guard.add_table("demo.both", read("nation").selectExpr("n_name AS name").unionAll(read("region").selectExpr("r_name AS name")))
    return guard.sql("SELECT name, 1 AS one FROM demo.both")


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table by way of each file format, masked alike."""
    from .catalogue import POLICY
    from .operators.session import GuardedSession
    from .sources.config import Config

    root = new_folder(spark, "formats")
    names = ("parquet", "orc", "csv", "json")
    out = None
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    for name in names:
        path, options = f"{root}/{name}", {"header": "true"} if name == "csv" else {}
        rows.write.format(name).options(**options).save(path)
        guard = GuardedSession(spark, Config.build({**POLICY, "columns": {f"files.{name}_supplier": POLICY["columns"]["demo.supplier"]}}))
        guard.read_table(f"files.{name}_supplier", path, name, **options)
        part = guard.sql(f"SELECT s_suppkey, s_name FROM files.{name}_supplier")
        part = part.select(F.lit(name).alias("format"), F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")
        out = part if out is None else out.unionAll(part)
    return out


# ----------------------------------------------------------------- campaigns
def leak_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated statements over copies of given tables with canaries, under three policies, and under one that gives a masked column away, which must be noticed."""
    rows = []
    for name, overlay, rules in (("plain", {}, None), ("lineage", {"lineage": "allow", "opaque": "mask"}, None), ("hostile", {"posture": "hostile"}, None), ("poisoned", {}, {"x": {"mask": "none"}})):
        report = campaign.run(campaign.guard(spark, sf_dir, rules, **overlay), 17, 120)
        rows.append((name, report.statements, report.served > 0, bool(report.leaks)))
    return spark.createDataFrame(rows, "policy string, statements long, some_served boolean, leaks boolean")


def differential_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated statements over given tables, run by a second engine too and masked afterwards; a mask done wrong must be noticed."""
    from .catalogue import session

    rows = []
    for name, principal, tamper in (("nobody", None, None), ("ann", "ann", None), ("sam", "sam", None), ("tampered", None, _tampered)):
        found = differential.compare(session(spark, sf_dir), sf_dir, 29, 40, principal, tamper)
        rows.append((name, found.statements, found.served > 20, bool(found.different)))
    return spark.createDataFrame(rows, "principal string, statements long, most_served boolean, differences boolean")


def _tampered(frame: DataFrame) -> DataFrame:
    """One more star on every text."""
    kinds = dict(frame.dtypes)
    return frame.select(*[F.concat(F.col(f"`{c}`"), F.lit("*")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`") for c in frame.columns]) if len(kinds) == len(frame.columns) else frame


def roles_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principals in threads while the policy is swapped: no row of anybody else's view, and a session that shares plans is noticed."""
    people = roles.names_of(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey")
    rows = []
    for name, kind in (("guarded", roles.GuardedSession), ("shared plans", roles.SharedPlans)):
        found = roles.campaign(spark, people, 120, session=kind)
        rows.append((name, found.statements, bool(found.mixed)))
    return spark.createDataFrame(rows, "kind string, statements long, mixed boolean")


def entries(pseudonym: Callable[[str], str]) -> dict[str, Entry]:
    """``pseudonym``: SQL of the hash mask of a column in the supplier domain."""
    s = "SELECT '{0}' AS format, s_suppkey::BIGINT AS s_suppkey, {1} AS s_name FROM supplier"
    return {
        "mask_scrub_patterns": (mask_scrub_patterns, SCRUB_PATTERNS_SQL),
        "detector_rates": (detector_rates, " UNION ALL ".join(map(_detector_sql, range(len(NAMES))))),
        "mask_ip_prefix_v6": (mask_ip_prefix_v6, IP_V6_SQL),
        "json_unlisted_null": (partial(json_unlisted, unlisted="null"), _json_sql("null", "'null'", "'null'")),
        "json_unlisted_shape": (partial(json_unlisted, unlisted="shape-only"), _json_sql("false", "'0'", "'\"\"'")),
        "json_unlisted_pass": (partial(json_unlisted, unlisted="pass-through"), _json_sql("true", "o_orderkey", "'\"a' || o_orderkey || '\"'")),
        "json_declared_null": (partial(json_unlisted, unlisted="null", declared=True), _json_sql("null", "'null'", "'null'")),
        "json_declared_shape": (partial(json_unlisted, unlisted="shape-only", declared=True), _json_sql("false", "'0'", "'\"\"'")),
        "json_declared_pass": (partial(json_unlisted, unlisted="pass-through", declared=True), _json_sql("true", "o_orderkey", "'\"a' || o_orderkey || '\"'")),
        "json_projection": (json_projection, "SELECT event_id, CAST(CAST(floor(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10) * 10 AS BIGINT) AS VARCHAR) AS k FROM events"),
        "view_identity": (view_identity, "SELECT c_custkey AS k, CASE WHEN length(c_name) <= 2 THEN repeat('*', length(c_name)::INT) ELSE repeat('*', (length(c_name) - 2)::INT) || right(c_name, 2) END AS who FROM customer WHERE c_acctbal > 0"),
        "opaque_view": (opaque_view, "SELECT CAST(NULL AS VARCHAR) AS name, 1 AS one FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)"),
        "file_formats": (file_formats, " UNION ALL ".join(s.format(n, pseudonym("s_name")) for n in ("parquet", "orc", "csv", "json"))),
        "differential_campaign": (differential_campaign, "SELECT p AS principal, 40::BIGINT AS statements, true AS most_served, d AS differences FROM (VALUES ('nobody', false), ('ann', false), ('sam', false), ('tampered', true)) v(p, d)"),
        "roles_campaign": (roles_campaign, "SELECT k AS kind, 120::BIGINT AS statements, m AS mixed FROM (VALUES ('guarded', false), ('shared plans', true)) v(k, m)"),
        "leak_campaign": (leak_campaign, "SELECT * FROM (VALUES ('plain', 120::BIGINT, true, false), ('lineage', 120::BIGINT, true, false), ('hostile', 120::BIGINT, true, false), ('poisoned', 120::BIGINT, true, true)) v(policy, statements, some_served, leaks)"),
    }
