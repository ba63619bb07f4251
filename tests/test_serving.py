"""Decisions kept by shape, statements cancelled by their own principals, streams counted."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from veilspark.catalogue import POLICY, session
from veilspark.errors import PolicyRejection
from veilspark.plans.cache import Shapes, shape_of
from veilspark.sources.config import Config

from .conftest import SF

TEXT = "SELECT c_custkey, c_name, c_acctbal FROM demo.customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' LIMIT 5"


def test_shapes():
    assert shape_of("SELECT a FROM t WHERE b = 1 -- why\n") == shape_of("select a\nfrom t where b = 22") == shape_of("SELECT a FROM t /* x */ WHERE b = 999999999")
    assert shape_of("SELECT a FROM t WHERE b = 'x'") == shape_of("SELECT a FROM t WHERE b = 'it''s'") != shape_of("SELECT a FROM t WHERE b = 1")
    assert shape_of("SELECT a FROM t WHERE b >= 5 LIMIT 3") == shape_of("SELECT a FROM t WHERE b >= 6 LIMIT 4")
    for a, b in (("SELECT 1", "SELECT 2"), ("SELECT a FROM t GROUP BY 1", "SELECT a FROM t GROUP BY 2"), ("SELECT get_json_object(a, '$.x') FROM t", "SELECT get_json_object(a, '$.y') FROM t"), ("SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 1234567890"),
                 ("SELECT a FROM t WHERE b = 1.5", "SELECT a FROM t WHERE b = 1.25"), ("SELECT a FROM `T`", "SELECT a FROM t"), ("SELECT date_trunc('day', a) FROM t", "SELECT date_trunc('year', a) FROM t"), ("SELECT a FROM t WHERE b = r'x'", "SELECT a FROM t WHERE b = 'x'")):
        assert shape_of(a) != shape_of(b)


def test_the_least_used_shape_goes():
    kept = Shapes(most=2)
    for k in ("a", "b"):
        kept.put((k,), k)
    kept.get(("a",))
    kept.put(("c",), "c")
    assert kept.get(("b",)) is None and kept.get(("a",)) == "a" and (kept.hits, kept.misses) == (2, 1)


def test_repeated_shapes_are_decided_once_and_answer_as_new_ones(spark):
    g, fresh = session(spark, SF), session(spark, SF)
    g.decisions(TEXT)
    began = time.monotonic()
    for _ in range(50):
        said = g.decisions(TEXT)
    each = (time.monotonic() - began) / 50
    assert each < 0.003 and said == fresh.decisions(TEXT) and g.shapes.hits == 50
    for other in (TEXT.replace("7", "8"), TEXT.replace("BUILDING", "MACHINERY").lower().replace("machinery", "MACHINERY"), TEXT.replace("LIMIT 5", "LIMIT 9")):
        before = g.shapes.hits
        assert sorted(map(tuple, g.sql(other).collect())) == sorted(map(tuple, session(spark, SF).sql(other).collect())) and g.shapes.hits == before + 1
    # names of fields follow the statement's own text
    assert g.sql("SELECT 5 = 1 FROM demo.customer").columns == ["(5 = 1)"] and g.sql("SELECT 5 = 2 FROM demo.customer").columns == ["(5 = 2)"]


def test_roles_reloads_and_new_tables_part_the_decisions(spark):
    g = session(spark, SF)
    text = "SELECT c_name FROM demo.customer"
    assert {g.decisions(text, p)[0].spec.mask.value for p in ("sam", "ann", None)} == {"inner", "pseudonym"}
    g.reload(Config.build({**POLICY, "columns": {**POLICY["columns"], "demo.customer": {**POLICY["columns"]["demo.customer"], "c_name": {"mask": "redact"}}}}))
    assert g.decisions(text)[0].spec.mask.value == "redact"
    g.add_table("demo.customer", spark.createDataFrame([(1, 2)], "c_custkey long, other int"))
    with pytest.raises(PolicyRejection):
        g.decisions(text)
    refused = "SELECT max(c_custkey) FROM demo.customer"
    for _ in range(2):
        with pytest.raises(PolicyRejection):
            g.sql(refused)


def test_one_of_two_running_statements_is_cancelled(spark):
    g = session(spark, SF)
    slow = F.udf(lambda n: time.sleep(0.4) or n, "long")
    frames = {p: g.sql("SELECT c_custkey FROM demo.customer LIMIT 30", p).repartition(2).select(slow("c_custkey").alias("n")) for p in ("ann", "sam")}
    got = {}

    def run(principal):
        try:
            got[principal] = len(frames[principal].collect())
        except PolicyRejection as e:
            got[principal] = e

    threads = [threading.Thread(target=run, args=(p,)) for p in frames]
    for t in threads:
        t.start()
    time.sleep(2.5)
    assert g.cancel("bob", frames["ann"]) == 0 and g.cancel("bob") == 0 and g.cancel("sam", frames["ann"]) == 0
    assert g.cancel("ann", frames["ann"]) >= 1
    for t in threads:
        t.join()
    assert got["sam"] == 30 and isinstance(got["ann"], PolicyRejection)


def test_streams_count_after_each_batch(spark, tmp_path):
    g = session(spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet").limit(50)
    for k in range(3):
        events.withColumn("event_type", F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = g.mask_rows_of("demo.events", stream.select("event_id", "event_type", "user_id", "value"), count=True)
    seen = []
    q = out.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    some = events.where("event_id % 2 = 0").where("event_type is not null").count()
    told = g.metrics.as_dict()
    for _ in range(50):
        if told["stream_batches"] == 3:
            break
        time.sleep(0.2)
        told = g.metrics.as_dict()
    assert seen == [50, 50, 50] and told["stream_batches"] == 3 and told["values_masked"] == 3 * (50 + some)
