"""Routes around the gates that were once open, and errors that must not quote values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.catalogue import session
from veilspark.errors import Cause, PolicyRejection
from veilspark.functions.jsonmask import too_deep
from veilspark.plans.masked_use import _fits

from .conftest import SF


@pytest.fixture(scope="module")
def guard(spark):
    return session(spark, SF)


def refused(guard, text, **named):
    with pytest.raises(PolicyRejection) as e:
        guard.sql(text, **named)
    return e.value


@pytest.mark.parametrize("posture", ["default", "hostile"])
@pytest.mark.parametrize(
    "text",
    [
        "SELECT count(*) FROM IDENTIFIER('text.`/etc/passwd`') WHERE value LIKE 'root%'",
        "SELECT count(*) FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/customer.parquet`') WHERE c_name = 'x'",
        "SELECT 1 WHERE IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.name') = 'root'",
        "SELECT IDENTIFIER('c_' || 'name') FROM demo.customer",
        "SELECT * FROM demo.customer ORDER BY IDENTIFIER('upper')(c_mktsegment)",
        "SELECT (SELECT count(*) FROM IDENTIFIER('text.`/etc/passwd`'))",
        "WITH s AS (SELECT * FROM IDENTIFIER('text.`/etc/passwd`')) SELECT 1 FROM s",
        "SELECT transform(array(1), x -> x) FROM demo.region",
    ],
)
def test_made_up_names_are_refused(spark, posture, text):
    assert refused(session(spark, SF, posture=posture), text).cause in (Cause.LEAKY_CATALOG, Cause.UNTRUSTED_FUNCTION)


def test_frames_over_other_relations_are_refused(spark, guard):
    raw = spark.read.parquet(f"{SF}/customer.parquet")
    with pytest.raises(PolicyRejection) as e:
        guard.mask_frame(raw)
    assert e.value.cause is Cause.LEAKY_CATALOG
    view = spark.table("`demo.customer`")
    with pytest.raises(PolicyRejection):
        guard.mask_frame(view.join(raw.select(F.col("c_custkey").alias("k")), F.col("k") == F.col("c_custkey")))
    with pytest.raises(PolicyRejection):
        guard.mask_frame(view.filter(F.expr("java_method('java.lang.System', 'getProperty', 'user.name') = 'root'")))
    assert guard.mask_frame(view.select("c_custkey")).count() == raw.count()


def test_dates_stay_coarse_however_they_are_named(spark, guard):
    orders = spark.table("`demo.orders`")
    with pytest.raises(PolicyRejection):
        guard.mask_frame(orders.select(F.date_trunc("day", "o_orderdate")))
    with pytest.raises(PolicyRejection):
        guard.mask_frame(orders.toDF("a", "b", "c", "d", "e", "f").select(F.date_trunc("month", "e").alias("x")))
    assert guard.mask_frame(orders.select(F.date_trunc("year", "o_orderdate").alias("y"))).count() > 0


@pytest.mark.parametrize(
    "text",
    [
        "SELECT c_custkey FROM demo.customer WHERE CAST(c_name AS INT) = 1", "SELECT c_custkey FROM demo.customer WHERE c_name = 1", "SELECT c_custkey FROM demo.customer ORDER BY CAST(c_name AS DATE)",
        "SELECT c_custkey FROM (SELECT c_custkey, c_name AS z FROM demo.customer) WHERE CAST(z AS DOUBLE) > 0", "SELECT c_custkey FROM demo.customer WHERE CAST(c_acctbal AS TINYINT) > 0",
        "SELECT c_custkey FROM demo.customer WHERE try_cast(c_name AS INT) = 1", "SELECT c_custkey FROM demo.customer WHERE to_number(c_name, '999') = 1", "SELECT count(*) FROM demo.customer GROUP BY CAST(upper(c_name) AS INT)",
    ],
)
def test_casts_that_quote_are_refused(guard, text):
    assert "Customer#" not in str(refused(guard, text))


@pytest.mark.parametrize("text", ["SELECT c_custkey FROM demo.customer WHERE CAST(c_name AS STRING) = 'x'", "SELECT c_custkey FROM demo.customer WHERE c_acctbal > 5"])
def test_casts_that_fit_are_served(guard, text):
    guard.sql(text).count()


def test_errors_of_results_quote_nothing(spark, guard):
    frame = guard.sql("SELECT c_custkey, c_name FROM demo.customer")
    bad = frame.filter(F.col("c_name").cast("int") > 0)
    for act in (bad.collect, bad.count, bad.show, bad.toPandas, lambda: bad.write.format("noop").mode("overwrite").save(), lambda: list(bad.toLocalIterator())):
        with pytest.raises(PolicyRejection) as e:
            act()
        assert e.value.cause is Cause.MALFORMED and e.value.__cause__ is None
    with pytest.raises(PolicyRejection):
        frame.explain()
    assert frame.limit(3).count() == 3 and len(frame.toPandas()) == frame.count()


def test_decisions_tell_no_columns(guard):
    with pytest.raises(PolicyRejection) as e:
        guard.decisions("SELECT c_nam FROM demo.customer")
    assert "c_name" not in str(e.value)


def test_streams_know_logical_types(spark, guard):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{SF}/events.parquet*")
    out = guard.mask_rows_of("demo.events", stream)
    assert out.isStreaming and "props" in out.columns
    batch = {r.event_id: r.props for r in guard.sql("SELECT event_id, props FROM demo.events").collect()}
    query = out.select("event_id", "props").writeStream.format("memory").queryName("typed_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.event_id: r.props for r in spark.table("typed_stream").collect()} == batch


def test_which_casts_fit():
    assert _fits("integer", "long") and _fits("decimal(9,2)", "double") and _fits("date", "timestamp") and _fits("integer", "string") and _fits("string", "binary")
    assert not any(_fits(a, b) for a, b in (("string", "integer"), ("long", "integer"), ("double", "decimal(9,2)"), ("string", "date"), ("double", "long"), ("string", "boolean")))


def test_depth():
    assert not too_deep("[" * 5 + "]" * 5, 5) and too_deep("[" * 6 + "]" * 6, 5)
    assert not too_deep('["[[[[[[", "\\"[[[["]', 2) and too_deep('{"a": "x\\\\", "b": [[[1]]]}', 3)
    assert not too_deep("[]" * 50, 1) and not too_deep('"' + "[" * 90, 3)


def test_values_are_counted_by_the_action(spark):
    g = session(spark, SF)
    frame, seen = g.counted("SELECT c_custkey, c_name, c_acctbal FROM demo.customer")
    n = len(frame.collect())
    assert g.count_values(seen) == 2 * n == g.metrics.as_dict()["values_masked"]


def test_tables_of_a_catalog(spark, tmp_path):
    from veilspark.operators.session import GuardedSession
    from veilspark.sources.config import Config

    spark.sql("CREATE DATABASE IF NOT EXISTS shopdb")
    spark.createDataFrame([(1, "ann")], "id int, who string").write.mode("overwrite").saveAsTable("shopdb.people")
    g = GuardedSession(spark, Config.build({"pseudonym_key": "0123456789abcdef", "columns": {"shopdb.people": {"id": {"mask": "none"}, "who": {"mask": "redact"}}}}))
    assert g.add_catalog("shopdb") == ["shopdb.people"]
    assert [tuple(r) for r in g.sql("SELECT id, who FROM shopdb.people").collect()] == [(1, "***")]
    spark.sql("DROP DATABASE shopdb CASCADE")


def test_keys_stand_in_no_plan_and_both_ways_agree(spark):
    text = "SELECT c_custkey, c_name FROM demo.customer"
    one, two = session(spark, SF, digests="batches"), session(spark, SF)
    pads = [p.hex().upper() for p in one.policy.config.key.pads()]
    shown = one.sql(text)._jdf.queryExecution().toString().upper()
    assert not any(p[:32] in shown for p in pads) and "DEMO-KEY" not in shown
    assert sorted(map(tuple, one.sql(text).collect())) == sorted(map(tuple, two.sql(text).collect()))
