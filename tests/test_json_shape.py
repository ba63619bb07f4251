"""Documents of a declared shape: masked by expressions as they are by the walk in Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import types as T

from veilspark.errors import Cause, ConfigError, MaskError, PolicyRejection
from veilspark.functions.jsonmask import DocumentMask
from veilspark.functions.jsonshape import below
from veilspark.functions.masks import mask
from veilspark.operators.session import GuardedSession
from veilspark.sources.config import Config

FIELD = T.StructField("j", T.StringType(), metadata={"logical_type": "json"})
SHAPE = {
    "company": "string", "city": "string", "age": "integer", "score": "number", "vip": "boolean", "Ünï\"code": "string",
    "profiles": [{"kind": "string", "handle": "string", "seen": ["integer"]}], "links": {"*": {"url": "string", "hits": "integer"}}, "grid": [["number"]],
}
RULES = {
    "/company": {"mask": "none"}, "/age": {"mask": "numeric-bucket", "bucket": 10}, "/score": {"mask": "numeric-bucket", "bucket": 7}, "/profiles": {"mask": "none"}, "/profiles/*/handle": {"mask": "pseudonym", "keep_domain": True},
    "/profiles/1/handle": {"mask": "inner", "keep": 1}, "/profiles/*/seen/0": {"mask": "null"}, "/links/home/url": {"mask": "redact"}, "/grid/*/*": {"mask": "numeric-bucket", "bucket": 5}, "/grid/0/1": {"mask": "none"},
}
KEYS = {"hits": {"mask": "numeric-bucket", "bucket": 100}, "url": {"mask": "scrub"}, "Ünï\"code": {"mask": "partial", "keep": 2}}


def column(**overlay):
    rule = {"mask": "json", "json": RULES, "json_keys": KEYS, "json_schema": SHAPE, **overlay}
    config = Config.build({"pseudonym_key": "0123456789abcdef", "columns": {"s.t": {"id": {"mask": "none"}, "j": rule}}})
    return config, config.rules["s.t", "j"].spec


def made(rng: random.Random, shape):
    """A document of a shape: keys left out, nulls, odd texts and numbers."""
    if rng.random() < 0.08:
        return None
    if isinstance(shape, list):
        return [made(rng, shape[0]) for _ in range(rng.randrange(4))]
    if isinstance(shape, dict):
        names = shape if "*" not in shape else rng.sample(["home", "work", "a.b", "x/y", "", "é", "*", "0"], rng.randrange(4))
        return {k: made(rng, shape.get(k, shape.get("*"))) for k in names if rng.random() < 0.8}
    if shape == "integer":
        return rng.choice((0, -1, 17, -17, 10**18, -(10**18), rng.randrange(1000)))
    if shape == "number":
        return rng.choice((0, -3, 2.5, -2.5, -7, 7.25, 123456789.125, -0.125))
    if shape == "boolean":
        return rng.random() < 0.5
    return rng.choice(("", "ann@mail.example", "a\"b\\c", "tab\there", "née 😀", "call 020 7946 0018 now", "null", "17", "x" * 50))


@pytest.mark.parametrize("unlisted", ["null", "shape-only", "pass-through"])
def test_random_documents(spark, unlisted):
    config, spec = column(json_unlisted=unlisted)
    rng = random.Random(unlisted)
    texts = [json.dumps(made(rng, SHAPE), ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1))) for _ in range(80)] + [None, "null", "{}"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string").select("i", mask(spark_column("j"), spec, FIELD, config.key).alias("m"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    walk = DocumentMask(spec, config.key)
    got = {r.i: r.m for r in out.collect()}
    for i, text in enumerate(texts):
        assert got[i] == walk.text(text), text


def spark_column(name):
    from pyspark.sql import functions as F

    return F.col(name)


@pytest.mark.parametrize("text", ['{"other": 1}', '{"age": "17"}', '{"age": 1.5}', '{"age": 1e3}', '{"profiles": {}}', '{"links": {"a": 5}}', "[]", '"secret"', "secret", '{"age": 1', '{"vip": "true"}', '{"company": ' + '"x"' * 1 + ', "city": "' + "y" * 300 + '"}', '{"age": 99999999999999999999}'])
def test_others_are_refused_and_nothing_is_told(spark, text):
    config, spec = column(json_max_bytes=200)
    g = GuardedSession(spark, config)
    frame = spark.createDataFrame([(1, text)], "id int, j string")
    g.add_table("s.t", frame.withColumn("j", spark_column("j").alias("j", metadata=FIELD.metadata)))
    with pytest.raises(PolicyRejection) as e:
        g.sql("SELECT j FROM s.t").collect()
    assert e.value.cause is Cause.MALFORMED and "secret" not in str(e.value) and "17" not in str(e.value)


def test_what_stands_under_a_path(spark):
    config, spec = column()
    g = GuardedSession(spark, config)
    rows = [(1, '{"profiles":[{"handle":"ann@x.example","kind":"web"},{"handle":"bobby","seen":[4,5]}],"company":"Acme"}'), (2, '{"company":null}'), (3, None)]
    g.add_table("s.t", spark.createDataFrame(rows, "id int, j string").withColumn("j", spark_column("j").alias("j", metadata=FIELD.metadata)))
    told = [r.p for r in g.sql("SELECT id, variant_get(parse_json(j), '$.profiles', 'variant') AS p FROM s.t ORDER BY id").collect()]
    assert json.loads(told[0].toJson())[1] == {"handle": "b***y", "seen": [None, 5]} and told[2] is None
    with pytest.raises(PolicyRejection):  # a key rule could hold inside the text
        g.sql("SELECT get_json_object(j, '$.company') AS c FROM s.t")
    g.reload(column(json_keys={})[0])
    assert [r.c for r in g.sql("SELECT get_json_object(j, '$.company') AS c FROM s.t ORDER BY id").collect()] == ["Acme", None, None]
    with pytest.raises(PolicyRejection):
        g.sql("SELECT variant_get(parse_json(j), '$.nowhere', 'variant') AS p FROM s.t")


def test_shapes_are_checked():
    for shape in ("text", [], ["string", "string"], {"*": "string", "a": "string"}, {"a": 5}, {"a": {"b": ["float"]}}, [[["string"]]]):
        with pytest.raises(ConfigError):
            column(json_schema=shape, json={}, json_keys={}, json_max_depth=2)
    with pytest.raises(ConfigError):
        Config.build({"pseudonym_key": "0123456789abcdef", "columns": {"s.t": {"j": {"mask": "redact", "json_schema": {"a": "string"}}}}})
    assert below({"a": [{"*": "integer"}]}, ("a", "0", "k")) == "integer"
    with pytest.raises(MaskError):
        below({"a": "string"}, ("a", "b"))


def test_a_leaf_that_does_not_fit_its_mask_refuses_the_statement(spark):
    config, _ = column(json={"/vip": {"mask": "redact"}})
    g = GuardedSession(spark, config)
    g.add_table("s.t", spark.createDataFrame([(1, "{}")], "id int, j string").withColumn("j", spark_column("j").alias("j", metadata=FIELD.metadata)))
    with pytest.raises(PolicyRejection) as e:
        g.sql("SELECT j FROM s.t")
    assert e.value.cause is Cause.MASK_TYPE_MISMATCH
