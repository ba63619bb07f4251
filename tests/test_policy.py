"""Statements under policy: what is served, masked and refused; and that no masked value escapes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.catalogue import HOSTILE, POLICY, REFUSALS, session
from veilspark.errors import Cause, ConfigError, PolicyRejection
from veilspark.operators.limits import RateLimiter
from veilspark.operators.session import GuardedSession
from veilspark.plans.trees import identifiers, join_names
from veilspark.sources.config import Config

from .conftest import SF

CANARY = "CANARY"


@pytest.fixture(scope="module")
def guard(spark):
    return session(spark, SF)


@pytest.fixture(scope="module")
def vault(spark):
    """Text columns hold canaries; ids are released; the wide view mixes columns."""
    t = spark.range(40).select(F.col("id"), F.concat(F.lit(CANARY), F.col("id").cast("string")).alias("a"), F.concat(F.lit(CANARY), (F.col("id") + 100).cast("string")).alias("b"), (F.col("id") * 7).alias("n"))

    def make(**overlay):
        g = GuardedSession(spark, Config.build({
            "pseudonym_key": "0123456789abcdef", "unique_keys": {"fz.t": [["id"]]},
            "columns": {"fz.t": {"id": {"mask": "none"}, "a": {"mask": "redact"}, "b": {"mask": "redact"}, "n": {"mask": "none"}}}, **overlay,
        }))
        g.add_table("fz.t", t)
        g.add_table("fz.mixed", t.select("id", F.col("a").alias("v")).union(t.select("id", F.col("b"))))
        return g

    return make


SHAPES = [
    "SELECT a FROM fz.t", "SELECT * FROM fz.t", "SELECT x.a y FROM fz.t x JOIN fz.t z ON x.id = z.id", "WITH c AS (SELECT a q FROM fz.t) SELECT q FROM c",
    "SELECT DISTINCT a FROM fz.t", "SELECT a FROM fz.t GROUP BY a", "SELECT a FROM fz.t UNION SELECT b FROM fz.t", "SELECT upper(a) FROM fz.t", "SELECT a || '' FROM fz.t",
    "SELECT CASE WHEN n > 0 THEN a ELSE b END FROM fz.t", "SELECT coalesce(a, b) FROM fz.t", "SELECT (SELECT a FROM fz.t WHERE id = 1) FROM fz.t",
    "SELECT first_value(a) OVER (ORDER BY id) FROM fz.t", "SELECT max(a) FROM fz.t", "SELECT v FROM fz.mixed", "SELECT collect_list(a) FROM fz.t", "SELECT struct(a) FROM fz.t",
    "SELECT a FROM (SELECT a FROM fz.t EXCEPT SELECT 'x')", "SELECT x.q FROM fz.t, LATERAL (SELECT fz.t.a AS q) x", "SELECT k.c2 FROM fz.t AS k(c1, c2, c3, c4)",
    "SELECT a FROM fz.t ORDER BY a LIMIT 3", "SELECT nullif(a, 'x') FROM fz.t", "SELECT substring(a, 1, 100) FROM fz.t", "TABLE fz.t", "FROM fz.t |> SELECT a",
    "SELECT a FROM fz.t TABLESAMPLE (50 PERCENT)", "SELECT to_json(struct(*)) FROM fz.t", "SELECT cast(a AS string) s FROM fz.t", "SELECT min_by(a, id) FROM fz.t",
    "WITH RECURSIVE r(x) AS (SELECT a FROM fz.t UNION ALL SELECT x FROM r WHERE false) SELECT x FROM r",
]


@pytest.mark.parametrize("overlay", [{}, {"opaque": "mask"}, {"lineage": "allow"}, {"posture": "hostile"}, {"opaque": "mask", "lineage": "allow"}])
def test_no_canary_escapes(vault, overlay):
    g = vault(**overlay)
    served = 0
    for text in SHAPES:
        try:
            rows = g.sql(text).collect()
        except PolicyRejection as e:
            assert CANARY not in str(e)
            continue
        served += 1
        assert CANARY not in str(rows), text
    assert served >= 2


def test_poisoned_policy_is_noticed(vault):
    g = vault(columns={"fz.t": {"id": {"mask": "none"}, "a": {"mask": "none"}, "b": {"mask": "redact"}, "n": {"mask": "none"}}})
    assert CANARY in str(g.sql("SELECT a FROM fz.t").collect())


@pytest.mark.parametrize(("name", "text", "cause"), REFUSALS)
def test_refusals(guard, name, text, cause):
    with pytest.raises(PolicyRejection) as e:
        guard.sql(text)
    assert e.value.cause.value == cause and e.value.sqlstate == "42501"


@pytest.mark.parametrize(("name", "text", "verdict"), HOSTILE)
def test_hostile(spark, name, text, verdict):
    g = session(spark, SF, posture="hostile")
    if verdict == "served":
        g.sql(text)
    else:
        with pytest.raises(PolicyRejection) as e:
            g.sql(text)
        assert e.value.cause.value == verdict


SINGLES = [
    ("SELECT c_custkey, sum(c_acctbal) FROM demo.customer GROUP BY c_custkey", False),
    ("SELECT c_mktsegment, c_custkey, sum(c_acctbal) FROM demo.customer GROUP BY c_mktsegment, c_custkey", False),
    ("SELECT c_custkey, sum(c_acctbal) FROM demo.customer GROUP BY 1", False),
    ("SELECT c_custkey, sum(c_acctbal) FROM demo.customer GROUP BY ROLLUP (c_custkey)", False),
    ("SELECT c_custkey, sum(c_acctbal) FROM demo.customer GROUP BY GROUPING SETS ((c_custkey), ())", False),
    ("SELECT c_custkey AS k, sum(c_acctbal) FROM demo.customer GROUP BY k", False),
    ("SELECT sum(c_acctbal) FROM demo.customer GROUP BY c_custkey + 0", False),
    ("SELECT * FROM (SELECT c_custkey, sum(c_acctbal) FROM demo.customer GROUP BY c_custkey)", False),
    ("SELECT * FROM (SELECT * FROM (SELECT c_custkey, sum(c_acctbal) FROM demo.customer GROUP BY c_custkey))", False),
    ("SELECT sum(c_acctbal) FROM demo.customer", True),
    ("SELECT c_mktsegment, sum(c_acctbal) FROM demo.customer GROUP BY c_mktsegment", True),
]


@pytest.mark.parametrize(("text", "served"), SINGLES)
def test_groups_of_one(guard, text, served):
    if served:
        guard.sql(text)
    else:
        with pytest.raises(PolicyRejection):
            guard.sql(text)


def test_mask_sits_above_filters_and_limits(guard):
    frame = guard.sql("SELECT c_name FROM demo.customer WHERE c_custkey = 5 ORDER BY c_name LIMIT 3")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    scan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.index("sha2") < plan.index("c_custkey#") and "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,5)]" in scan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in scan


def test_not_null_and_type_mismatch(spark):
    with pytest.raises(PolicyRejection) as e:
        session(spark, SF, not_null={"demo.lineitem": ["l_tax"]}).sql("SELECT l_tax FROM demo.lineitem")
    assert e.value.cause is Cause.NULLABILITY_MISMATCH
    columns = {**POLICY["columns"], "demo.region": {"r_regionkey": {"mask": "redact"}, "r_name": {"mask": "none"}}}
    with pytest.raises(PolicyRejection) as e:
        session(spark, SF, columns=columns).sql("SELECT * FROM demo.region")
    assert e.value.cause is Cause.MASK_TYPE_MISMATCH


def test_errors_do_not_quote_values(vault):
    with pytest.raises(PolicyRejection) as e:
        vault().collect("SELECT id FROM fz.t WHERE cast(a AS int) = 1")
    assert CANARY not in str(e.value)


def test_reload_and_metrics(vault, tmp_path):
    g = vault()
    g.sql("SELECT a FROM fz.t")
    path = tmp_path / "policy.toml"
    path.write_text('pseudonym_key = "0123456789abcdef"\n[columns."fz.t"]\na = { mask = "null" }\n')
    assert g.reload(path) == 2 and g.sql("SELECT a FROM fz.t").first().a is None
    path.write_text("pseudonym_key = 1\nbad = 2")
    with pytest.raises(ConfigError):
        g.reload(path)
    assert g.policy.generation == 2
    with pytest.raises(PolicyRejection):
        g.sql("DROP VIEW x")
    counts = g.metrics.as_dict()
    assert counts["served"] == 2 and counts["rejected_write_refused"] == 1 and 'cause="write_refused"} 1' in g.metrics.prometheus()


def test_rules_must_resolve(vault):
    g = vault(columns={"fz.t": {"nowhere": {"mask": "none"}}})
    with pytest.raises(ConfigError):
        g.check_rules()


def test_rate_limit():
    now = [0.0]
    limit = RateLimiter(60, 2, clock=lambda: now[0])
    limit.take("a"), limit.take("a"), limit.take("b")
    with pytest.raises(PolicyRejection) as e:
        limit.take("a")
    assert e.value.sqlstate == "54000"
    now[0] = 1.0
    limit.take("a")


def test_lexer():
    text = "SELECT 'demo.customer', demo . customer.c_name -- demo.customer\nFROM `demo`.customer /* x */"
    assert join_names(text, {"demo.customer"}) == "SELECT 'demo.customer', `demo.customer`.c_name -- demo.customer\nFROM `demo.customer` /* x */"
    assert identifiers("SELECT \"quoted\", a.b FROM `C d`") == {"select", "a", "b", "from", "c d"}


def test_config_text():
    config = Config.parse('pseudonym_key = "0123456789abcdef"\nposture = "hostile"\n[[column]]\nrelation = "S.T"\ncolumn = "C"\nmask = "partial"\nkeep = 2\n')
    assert config.summaries == "refuse" and config.rules["s.t", "c"].spec.keep == 2


def test_metamorphic_wrapping_never_releases_more(guard):
    for text in ("SELECT upper(c_name) u FROM demo.customer", "SELECT sum(c_acctbal) OVER (ORDER BY c_custkey) s FROM demo.customer", "SELECT c_name || 'x' y FROM demo.customer"):
        for wrap in ("{}", "SELECT * FROM ({})", "SELECT * FROM (SELECT * FROM ({}) p) q", "WITH w AS ({}) SELECT * FROM w", "SELECT DISTINCT * FROM ({})"):
            with pytest.raises(PolicyRejection):
                guard.sql(wrap.format(text))
