"""Masks: goldens, edge values, and Spark against the one-value versions."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.errors import MaskError
from veilspark.functions import masks
from veilspark.functions.keyed import Key, redaction_conf
from veilspark.functions.scalars import ip_prefix, mask_text
from veilspark.functions.scrub import py_scrub
from veilspark.spec import Mask, MaskSpec, fallback_for, most_restrictive, supports

KEY = Key(b"demo-key-not-for-production")
TEXTS = [
    None, "", "a", "abcd", "abcde", "naïve€x", "user1@example.com", "@x", "x@", "a@b@c", "203.0.113.77", "1.2.3.4/32", "fe80::1%eth0", "2001:DB8:0001:2::1/64", "::ffff:1.2.3.4",
    "::1", "1:2:3:4:5:6:7:8", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "01.2.3.4", "1::2::3", "12345::", "256.1.1.1", "call +44 20 7946 0958 or 555-0101 now",
    "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "iban GB82WEST12345698765432 DE89370400440532013000 GB82WEST12345698765431", "nhs 943 476 5919, 943 476 5918; nino AB123456C",
    "see https://x.y/z?q=1 mail a.b@c.de at SW1A 1AA ip 10.0.0.1 mac 00:1B:44:11:3A:B7 id 123e4567-e89b-12d3-a456-426614174000", "ssn 123-45-6789 batch 1234567890123456",
]
SPECS = [
    MaskSpec(Mask.REDACT), MaskSpec(Mask.PARTIAL), MaskSpec(Mask.PARTIAL, keep=0), MaskSpec(Mask.INNER, keep=2), MaskSpec(Mask.OUTER, keep=2), MaskSpec(Mask.RANGE, start=1, end=3),
    MaskSpec(Mask.RANGE, start=2, end=64), MaskSpec(Mask.HASH, domain="d"), MaskSpec(Mask.PSEUDONYM), MaskSpec(Mask.PSEUDONYM, domain="email"),
    MaskSpec(Mask.PSEUDONYM, keep_domain=True), MaskSpec(Mask.IP_PREFIX), MaskSpec(Mask.SCRUB),
]


def test_native_masks_agree_with_one_value_versions(spark):
    df = spark.createDataFrame([(v,) for v in TEXTS], "v string")
    rows = df.select("v", *[masks.mask(F.col("v"), s, df.schema[0], KEY).alias(f"m{i}") for i, s in enumerate(SPECS)]).collect()
    for r in rows:
        for i, s in enumerate(SPECS):
            assert r[f"m{i}"] == (None if r.v is None else mask_text(r.v, s, KEY)), (s, r.v)


def test_goldens():
    text = lambda v, m, **k: mask_text(v, MaskSpec(m, **k), KEY)
    assert text("naïve€x", Mask.PARTIAL) == "***ve€x"
    assert text("555-0101", Mask.PARTIAL) == "****0101"
    assert text("94103", Mask.RANGE, start=2, end=64) == "94***"
    assert text("a", Mask.RANGE, start=2, end=64) == "*"
    assert text("abcdef", Mask.OUTER, keep=2) == "**cd**"
    assert re.fullmatch(r"[0-9a-f]{16}@[0-9a-f]{8}\.invalid", text("user1@example.com", Mask.PSEUDONYM))
    assert py_scrub("ending 4111 1111 1111 1111 declined") == "ending <CARD> declined"
    assert py_scrub("Ref 20201555") == "Ref 20201555"


def test_uuid_pseudonym(spark):
    df = spark.createDataFrame([("00000000-0000-4000-8000-000000000100",), ("0000000000004000800000000000 0100",), (None,)], "v string")
    out = [r[0] for r in df.select(masks.pseudonym_uuid(F.col("v"), KEY, "account_id", lenient=True)).collect()]
    assert re.fullmatch("[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", out[0])
    assert out[1:] == [None, None]
    with pytest.raises(Exception, match="not a UUID"):
        df.select(masks.pseudonym_uuid(F.col("v"), KEY, None)).collect()


def test_buckets(spark):
    row = lambda v, t, b, **k: spark.createDataFrame([(v,)], T.StructType([T.StructField("v", t)])).select(masks.bucket(F.col("v"), b, t, **k)).first()[0]
    assert row(-7, T.IntegerType(), 5) == -10
    assert row(-(1 << 63), T.LongType(), 10) == -(1 << 63)  # saturates
    assert row(-3.5, T.DoubleType(), 2) == -4.0
    assert row(float("inf"), T.DoubleType(), 2) == float("inf")
    assert row(1e300, T.DoubleType(), 7) == pytest.approx(1e300)
    assert row(None, T.DoubleType(), 7) is None
    from decimal import Decimal

    assert row(Decimal("-0.01"), T.DecimalType(10, 2), 25000) == Decimal("-25000.00")
    assert row(-32768, T.ShortType(), 1000, lenient=True) is None
    with pytest.raises(Exception, match="OVERFLOW"):
        row(-32768, T.ShortType(), 1000)


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(1970, 4, 11), dt.datetime(1999, 12, 31, 23, 59))], "d date, t timestamp")
    r = df.select(masks.coarse_date(F.col("d"), "year", T.DateType()), masks.coarse_date(F.col("t"), "month", T.TimestampType())).first()
    assert tuple(r) == (dt.date(1970, 1, 1), dt.datetime(1999, 12, 1))


def test_unsupported_types_are_errors(spark):
    for f in (T.StructField("a", T.ArrayType(T.StringType())), T.StructField("b", T.BooleanType()), T.StructField("c", T.BinaryType())):
        for m in Mask:
            if m in (Mask.NONE, Mask.NULL):
                assert supports(m, f.dataType)
            else:
                with pytest.raises(MaskError):
                    masks.mask(F.col(f.name), MaskSpec(m), f, KEY)


def test_keys_do_not_print(spark):
    assert "demo" not in repr(KEY)
    for k, v in redaction_conf().items():
        spark.conf.set(k, v)
    shown = spark.range(1).select(masks.digest(F.col("id").cast("string"), KEY, None))._jdf.queryExecution().toString()
    inner, outer = KEY.pads()
    assert inner.hex().upper() not in shown.upper() and " ".join(f"{b:02X}" for b in outer) not in shown.upper()


def test_fallback_and_roles():
    assert fallback_for(T.StructField("a", T.StringType()), "s.t.a").domain == "unclassified:s.t.a"
    assert fallback_for(T.StructField("a", T.CharType(2)), "s.t.a").mask is Mask.NULL
    assert fallback_for(T.StructField("a", T.DateType()), "s.t.a").mask is Mask.DATE_YEAR
    assert fallback_for(T.StructField("a", T.StringType(), metadata={"logical_type": "inet"}), "s.t.a").mask is Mask.IP_PREFIX
    assert fallback_for(T.StructField("a", T.DoubleType()), "s.t.a").mask is Mask.NULL
    assert most_restrictive([("b", MaskSpec(Mask.INNER)), ("a", MaskSpec(Mask.OUTER)), ("c", MaskSpec(Mask.NONE))]).mask is Mask.OUTER


@given(st.text(max_size=40), st.integers(0, 6))
def test_stars_keep_the_width(v, keep):
    for m in (Mask.PARTIAL, Mask.INNER, Mask.OUTER):
        assert len(mask_text(v, MaskSpec(m, keep=keep), KEY)) == len(v)


@given(st.text(min_size=1, max_size=40))
def test_pseudonyms_do_not_echo(v):
    out = mask_text(v, MaskSpec(Mask.PSEUDONYM), KEY)
    assert out == mask_text(v, MaskSpec(Mask.PSEUDONYM), KEY) and out != v and len(out) in (16, 33)


@given(st.ip_addresses().map(str))
def test_ip_prefixes_are_stable(v):
    assert ip_prefix(ip_prefix(v)) == ip_prefix(v)
