"""No value in any error: results by reflection, expressions by an allowlist."""

from __future__ import annotations

import inspect
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame
from pyspark.sql.group import GroupedData

from veilspark.catalogue import session
from veilspark.errors import Cause, ConfigError, PolicyRejection
from veilspark.functions.jsonmask import MOST_DIGITS, DocumentMask
from veilspark.functions.keyed import Key
from veilspark.functions.scrub import iban, mod97, py_iban
from veilspark.operators import results
from veilspark.operators.limits import MOST_PRINCIPALS, RateLimiter
from veilspark.operators.results import REFUSED, MaskedFrame, Quiet, public_names
from veilspark.operators.session import GuardedSession
from veilspark.plans.masked_use import _fits
from veilspark.sources.config import Config
from veilspark.spec import Mask, MaskSpec

from .conftest import SF


@pytest.fixture(scope="module")
def guard(spark):
    return session(spark, SF)


@pytest.fixture(scope="module")
def bad(guard):
    """A result that fails on every row by naming a value."""
    return guard.sql("SELECT c_custkey, c_name FROM demo.customer").filter(F.col("c_name").cast("int") > 0)


def test_every_public_method_is_dealt_with():
    for name in public_names():
        assert name in MaskedFrame.__dict__, name
    assert not [n for n in dir(ClassicFrame) if not n.startswith("_") and n not in public_names() and n not in results._TELLING]


def _arguments(f, bad):
    """Arguments by parameter name for any method of frames and groupings."""
    known = {
        "other": bad, "func": lambda *x: x[0], "f": print, "schema": bad.schema, "colName": "c_custkey", "col": "c_custkey", "col1": "c_custkey", "col2": "c_custkey", "cols": ["c_custkey"], "name": "n", "existing": "c_name", "new": "n", "num": 1,
        "numPartitions": 2, "pivot_col": "c_name", "subset": ["c_name"], "to_replace": "a", "value": "b", "weights": [0.5, 0.5], "fractions": {1: 1.0}, "ids": ["c_custkey"], "values": ["c_name"], "variableColumnName": "v",
        "valueColumnName": "w", "eventTime": "c_name", "delayThreshold": "1 hour", "probabilities": [0.5], "relativeError": 0.1, "tableName": "t", "viewName": "quiet_view", "observation": "o", "metadata": {}, "columnName": "c_name",
        "condition": F.col("c_custkey") > 0, "table": "t", "fraction": 0.9, "indexColumn": None, "colsMap": {"c_name": "n"}, "columns": [], "outputStructType": bad.schema, "stateStructType": bad.schema, "outputMode": "append", "timeoutConf": "NoTimeout",
    }
    out = []
    for p in inspect.signature(f).parameters.values():
        if p.name == "self" or p.default is not p.empty or p.kind in (p.VAR_KEYWORD, p.KEYWORD_ONLY):
            continue
        if p.kind is p.VAR_POSITIONAL:
            out += [F.max("c_name")] if p.name == "exprs" else []
            continue
        out.append(known[p.name])
    return out


def _run_down(made):
    if isinstance(made, MaskedFrame):
        made.collect()
    elif isinstance(made, list):
        for m in made:
            _run_down(m)


def test_no_method_of_a_frame_tells_a_value(bad):
    """Whatever is called on a result that cannot run, and whatever is run of what it gives: refusals without values."""
    for name in public_names():
        if name in ("cache", "persist", "unpersist", "na", "stat", "write", "writeStream", "rdd", "executionInfo", "plot"):
            continue
        f = getattr(ClassicFrame, name)
        try:
            made = getattr(bad, name)(*_arguments(f, bad))
            assert not isinstance(made, ClassicFrame) or isinstance(made, MaskedFrame), name
            assert not isinstance(made, GroupedData), name
            _run_down(made)
            if isinstance(made, Quiet):
                _run_down(made.count() if name != "mergeInto" and name != "writeTo" else None)
        except PolicyRejection as e:
            assert "Customer#" not in str(e) and "'" not in str(e) and e.__cause__ is None, name
        except (TypeError, ValueError, KeyError, AssertionError) as e:  # of the arguments, not of a row
            assert "CAST_INVALID" not in str(e), name


def test_what_is_made_of_frames_is_quiet(bad, tmp_path):
    acts = (
        lambda: bad.groupBy("c_custkey").count().collect(), lambda: bad.agg(F.count("*")).collect(), lambda: bad.groupBy("c_custkey").pivot("c_name").count().collect(), lambda: bad.na.fill("x").collect(), lambda: bad.stat.freqItems(["c_name"]).collect(),
        lambda: bad.groupBy("c_custkey").applyInPandas(lambda p: p, bad.schema).count(), lambda: bad.groupBy("c_custkey").cogroup(bad.groupBy("c_custkey")).applyInPandas(lambda a, b: a, bad.schema).count(),
        lambda: bad.write.mode("overwrite").parquet(str(tmp_path / "w")), lambda: bad.transform(lambda d: d.groupBy().count()).collect(), lambda: bad["c_custkey", "c_name"].collect(), lambda: bad.toArrow(), lambda: bad.foreach(print), lambda: next(bad.toLocalIterator()),
        lambda: bad.mapInArrow(lambda it: it, bad.schema).collect(), lambda: [p.collect() for p in bad.randomSplit([0.5, 0.5])],
    )
    for act in acts:
        with pytest.raises(PolicyRejection) as e:
            act()
        assert e.value.cause is Cause.MALFORMED and "'" not in str(e.value)
    with pytest.raises(PolicyRejection) as e:
        bad.groupBy("c_custkey").count().collect()
    assert (e.value.sqlstate, e.value.condition) == ("22018", "CAST_INVALID_INPUT")
    for name in REFUSED:
        with pytest.raises(PolicyRejection):
            made = getattr(bad, name)
            made()


def test_streams_are_quiet(spark, guard, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    out = guard.mask_rows_of("demo.events", spark.readStream.schema(schema).parquet(f"{SF}/events.parquet*")).selectExpr("CAST(event_type AS INT) AS n")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(PolicyRejection) as e:
        query.awaitTermination()
    assert "'" not in str(e.value) and "'" not in str(query.exception())
    kinds = []
    again = guard.mask_rows_of("demo.events", spark.readStream.schema(schema).parquet(f"{SF}/events.parquet*")).writeStream
    again.foreachBatch(lambda b, n: kinds.append(type(b))).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert set(kinds) == {MaskedFrame}


@pytest.mark.parametrize(
    "use",
    [
        "format_string(c_name, 1) = 'x'", "encode('a', c_name) IS NULL", "decode(encode('a', 'UTF-8'), c_name) = 'a'", "'a' LIKE c_name", "'a' RLIKE c_name", "variant_get(parse_json(c_name), '$.a', 'int') = 1", "to_number(c_name, '999') = 1",
        "CAST(c_acctbal AS DECIMAL(4,1)) > 0", "CAST(c_acctbal AS DECIMAL(38,0)) * CAST(c_acctbal AS DECIMAL(38,0)) > 0", "CAST(c_acctbal AS SMALLINT) + 1S > 0", "array(1, 2)[c_acctbal] = 1",
    ],
)
def test_uses_that_quote_are_refused(guard, use):
    with pytest.raises(PolicyRejection) as e:
        guard.sql(f"SELECT c_custkey FROM demo.customer WHERE {use}").collect()
    assert "Customer#" not in str(e.value)


@pytest.mark.parametrize("use", ["c_name LIKE 'C%'", "c_acctbal * 2 + 1 > 3", "parse_json(c_name) IS NULL", "upper(c_name) = 'X' OR length(c_name) > 3", "try_variant_get(parse_json(c_name), '$.a', 'int') IS NULL", "abs(c_acctbal) > 5", "c_name IN ('a', 'b') OR c_acctbal BETWEEN 1 AND 9000"])
def test_uses_that_cannot_quote_are_served(guard, use):
    guard.sql(f"SELECT c_custkey FROM demo.customer WHERE {use}").collect()


def test_decimals_that_fit():
    assert _fits("integer", "decimal(10,0)") and _fits("decimal(9,2)", "decimal(12,2)") and _fits("long", "decimal(22,2)")
    assert not _fits("decimal(12,2)", "decimal(11,2)") and not _fits("long", "decimal(20,1)") and not _fits("double", "decimal(38,2)")


def test_sqlstates_are_kept(guard):
    with pytest.raises(PolicyRejection) as e:
        guard.sql("SELECT nothing_like_it FROM demo.customer")
    assert e.value.sqlstate == "42703" and "nothing_like_it" not in str(e.value)


# ----------------------------------------------------------------- checksums
def test_ibans(spark):
    good = ["GB82WEST12345698765432", "DE89370400440532013000", "MT84MALT011000012345MTLCAST001S", "NO9386011117947", "FR1420041010050500013M02606"]
    rows = [(g,) for g in good] + [(g[:-1] + ("0" if g[-1] != "0" else "1"),) for g in good] + [("GB82WEST1234569876543",), ("ZZ00" + "A" * 30,), ("gb82west12345698765432",), ("GB82-WEST1234569876543",), ("",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    assert [r.ok for r in df.select(iban(F.col("v")).alias("ok")).collect()] == [v is not None and v == v.upper() and v.isalnum() and py_iban(v) if v else False for (v,) in rows]
    plan = df.select(mod97(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5_000


# ------------------------------------------------------------- JSON, NOT NULL
def test_long_exponents_are_refused_at_once():
    walk = DocumentMask(MaskSpec(Mask.JSON, json=(("/k", MaskSpec(Mask.NUMERIC_BUCKET, bucket=10)),)), Key(b"0123456789abcdef"))
    began = time.monotonic()
    for text in ('{"k":1e10000000}', '{"k":-1e10000000}', '{"k":1e999999999999}', '{"k":' + "9" * 5_000 + "}"):
        with pytest.raises(ValueError) as e:
            walk.text(text)
        assert type(e.value).__name__ == "MaskError"
    assert walk.text('{"k":1e-10000000}') == '{"k":0}' and walk.text('{"k":-1e-10000000}') == '{"k":-10}' and walk.text('{"k":0e99999999}') == '{"k":0}'
    assert walk.text('{"k":17.25}') == '{"k":10}' and walk.text('{"k":-0.5}') == '{"k":-10}' and len(walk.text(f'{{"k":1e{MOST_DIGITS}}}')) > MOST_DIGITS
    assert time.monotonic() - began < 2


def test_a_column_that_a_catalog_keeps_from_null_is_not_nulled(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS strictdb")
    spark.sql("CREATE OR REPLACE VIEW strictdb.t AS SELECT id, X'00' AS raw, nullif(X'01', X'01') AS soft FROM range(2)")  # file tables of this catalog forget NOT NULL
    try:
        g = GuardedSession(spark, Config.build({"pseudonym_key": "0123456789abcdef", "columns": {"strictdb.t": {"id": {"mask": "none"}}}}))
        g.add_catalog("strictdb")
        assert g.planner(g.policy.config).config.not_null == {("strictdb.t", "id"), ("strictdb.t", "raw")}
        assert g.sql("SELECT id, soft FROM strictdb.t").collect()[0].soft is None
        with pytest.raises(PolicyRejection) as e:
            g.sql("SELECT raw FROM strictdb.t")
        assert e.value.cause is Cause.NULLABILITY_MISMATCH
    finally:
        spark.sql("DROP DATABASE strictdb CASCADE")


def test_counting_takes_one_token(spark):
    g = session(spark, SF, rate_limit_per_minute=1, rate_limit_burst=1)
    g.counted("SELECT c_custkey FROM demo.customer")
    assert g.metrics.as_dict()["statements"] == 1
    with pytest.raises(PolicyRejection) as e:
        g.sql("SELECT c_custkey FROM demo.customer")
    assert e.value.cause is Cause.RATE_LIMITED


def test_principals_with_full_buckets_are_forgotten():
    now = [0.0]
    limiter = RateLimiter(60, 1, clock=lambda: now[0])
    for i in range(MOST_PRINCIPALS + 1):
        limiter.take(f"p{i}")
    now[0] = 2.0
    limiter.take("last")
    assert set(limiter.left) == {"last"}


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from veilspark.sources import folders

    class Cluster:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(ConfigError):
        folders.shared_dir(Cluster())
    assert folders.new_folder(spark, "x") != folders.new_folder(spark, "x")
