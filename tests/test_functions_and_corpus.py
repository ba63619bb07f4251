"""The function lists against the engine, and the refusal survey."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.catalogue import session
from veilspark.errors import PolicyRejection
from veilspark.operators.corpus import read_statements, survey
from veilspark.operators.session import GuardedSession
from veilspark.plans.names import TRUSTED, VALUE_RETURNING
from veilspark.sources.config import Config

from .conftest import SF

#: Names that another engine has and Spark does not.
ABSENT = {"like_escape"}


def test_trusted_functions_exist(spark):
    known = {r[0].lower() for r in spark.sql("SHOW FUNCTIONS").collect()}
    assert TRUSTED - known - ABSENT <= {"format_string", "current_timestamp", "overlay", "localtimestamp", "coalesce", "nullif", "trim"} - known
    assert not TRUSTED & VALUE_RETURNING


@pytest.mark.parametrize("name", sorted(VALUE_RETURNING))
def test_value_returning_functions_are_refused(spark, name):
    guard = session(spark, SF)
    with pytest.raises(PolicyRejection) as e:
        guard.sql(f"SELECT {name}(c_name) FROM demo.customer")
    assert e.value.cause.value in ("untrusted_function", "malformed")


def test_survey(spark, tmp_path):
    (tmp_path / "a.sql").write_text("SELECT c_name FROM demo.customer;")
    (tmp_path / "b.sql").write_text("SELECT upper(c_name) FROM demo.customer")
    (tmp_path / "c.sql").write_text("SELEC")
    report = survey(session(spark, SF), read_statements(tmp_path))
    assert (report.statements, report.unparsed, report.refused) == (3, 1, 1) and report.refusal_rate == 0.5


def test_variants_are_walked_and_projected(spark):
    frame = spark.createDataFrame([(1, '{"a":{"b":17,"c":"x"},"d":"y"}')], "id long, j string").select("id", F.parse_json("j").alias("v"))
    rules = {"id": {"mask": "none"}, "v": {"mask": "json", "json": {"/a/b": {"mask": "numeric-bucket", "bucket": 10}, "/d": "redact"}}}
    guard = GuardedSession(spark, Config.build({"pseudonym_key": "0123456789abcdef", "columns": {"s.t": rules}}))
    guard.add_table("s.t", frame)
    text = lambda q: guard.sql(q).select(F.to_json("x")).first()[0]
    assert text("SELECT v AS x FROM s.t") == '{"a":{"b":10,"c":null},"d":"***"}'
    assert text("SELECT variant_get(v, '$.a', 'variant') AS x FROM s.t") == '{"b":10,"c":null}'
    assert guard.sql("SELECT variant_get(v, '$.d', 'string') AS x FROM s.t").first().x == "***"
    with pytest.raises(PolicyRejection):
        guard.sql("SELECT variant_get(v, '$.a', 'string') AS x FROM s.t")


def test_streams_take_the_policy_of_their_moment(spark, tmp_path):
    from veilspark.catalogue import stream_masked, stream_rebinding

    assert stream_masked(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert stream_rebinding(spark, SF).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_masked_streams_stay_out_of_the_driver(spark):
    from veilspark.catalogue import stream_masked

    once, again = stream_masked(spark, SF), stream_masked(spark, SF)
    assert once.schema["event_id"].dataType == again.schema["event_id"].dataType and sorted(once.columns) == sorted(spark.read.parquet(f"{SF}/events.parquet").columns)
    assert once.inputFiles() and not set(once.inputFiles()) & set(again.inputFiles())
    assert once.exceptAll(again).count() == again.exceptAll(once).count() == 0
