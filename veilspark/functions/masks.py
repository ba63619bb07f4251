"""Every mask as a native expression.  Null stays null; characters are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaskError
from ..spec import Mask, MaskSpec, logical_type, supports
from .jsonmask import mask_documents
from .jsonshape import mask_shaped
from .keyed import Key, Texts, hasher, in_batches, mac_hex
from .scrub import let, scrub


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def redact(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("***"))


def partial(c: Column, keep: int) -> Column:
    n = F.length(c)
    return F.when(n <= keep, _stars(n)).otherwise(F.concat(_stars(n - keep), F.right(c, F.lit(keep))))


def inner(c: Column, keep: int) -> Column:
    n = F.length(c)
    return F.when(n <= 2 * keep, _stars(n)).otherwise(F.concat(F.left(c, F.lit(keep)), _stars(n - 2 * keep), F.right(c, F.lit(keep))))


def outer(c: Column, keep: int) -> Column:
    n = F.length(c)
    if not keep:
        return _stars(n)
    edge = "*" * keep
    return F.when(n <= 2 * keep, _stars(n)).otherwise(F.concat(F.lit(edge), F.substring(c, F.lit(keep + 1), n - 2 * keep), F.lit(edge)))


def span(c: Column, start: int, end: int) -> Column:
    n = F.length(c)
    last = F.least(F.lit(end), n)
    return F.when(n <= start, _stars(n)).otherwise(F.concat(F.left(c, F.lit(start)), _stars(last - start), F.substring(c, last + 1, n)))


def digest(c: Column, key: Key, domain: str | None, batches: bool = False) -> Column:
    if batches:
        return in_batches(c, lambda: hasher(key, domain, digits=32))
    return F.left(mac_hex(key, c, domain), F.lit(32))


def pseudonyms(key: Key, domain: str | None, keep_domain: bool) -> Texts:
    """The pseudonyms of values, addresses or any other texts."""
    local, short = hasher(key, domain, digits=16), hasher(key, domain, b"domain" + bytes(1), 8)

    def run(values: list[bytes]) -> list[str]:
        out = local(values)
        for i in [i for i, v in enumerate(values) if b"@" in v]:
            name, _, host = values[i].partition(b"@")
            if name and host:
                out[i] += f"@{host.decode()}" if keep_domain else f"@{short([host])[0]}.invalid"
        return out

    return run


def pseudonym(c: Column, key: Key, domain: str | None, keep_domain: bool = False, batches: bool = False) -> Column:
    if batches:
        return in_batches(c, lambda: pseudonyms(key, domain, keep_domain))
    local = F.left(mac_hex(key, c, domain), F.lit(16))
    at = F.locate("@", c)
    host = F.substring(c, at + 1, F.length(c))
    if keep_domain:
        named = F.concat(local, F.lit("@"), host)
    else:
        named = F.concat(local, F.lit("@"), F.left(mac_hex(key, host, domain, b"domain\0"), F.lit(8)), F.lit(".invalid"))
    return F.when((at > 1) & (at < F.length(c)), named).otherwise(local)


def pseudonym_uuid(c: Column, key: Key, domain: str | None, lenient: bool = False) -> Column:
    """A version 4 UUID from the 16 bytes of another."""
    plain = F.lower(F.regexp_replace(c, "-", ""))
    d = F.left(mac_hex(key, F.unhex(plain), domain), F.lit(32))
    part = lambda a, n: F.substring(d, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    out = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
    bad = F.lit(None) if lenient else F.raise_error(F.lit("a value is not a UUID"))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), out).when(c.isNotNull(), bad.cast("string"))


def coarse_date(c: Column, unit: str, data_type: T.DataType) -> Column:
    """First of the year or month; timestamps in the session's time zone, which guarded sessions set to UTC."""
    return F.trunc(c, unit) if isinstance(data_type, T.DateType) else F.date_trunc(unit, c).cast(data_type)


def bucket(c: Column, size: int, data_type: T.DataType, lenient: bool = False) -> Column:
    """The largest multiple of ``size`` that is not above the value."""
    if isinstance(data_type, T.DecimalType):
        return (c - F.pmod(c, F.lit(size).cast("decimal(19,0)"))).cast(data_type)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        v = c.cast("double")
        q = v / F.lit(float(size))
        down = F.when(F.abs(q) < 2.0**53, F.floor(q).cast("double")).otherwise(q) * F.lit(float(size))
        if isinstance(data_type, T.FloatType):
            most = 3.4028234663852886e38
            down = F.greatest(F.least(down, F.lit(most)), F.lit(-most)).cast("float")
        return F.when(F.isnan(v) | (F.abs(v) == float("inf")), c).otherwise(down)
    v = c.cast("long")
    rest = F.pmod(v, F.lit(size).cast("long"))
    if isinstance(data_type, T.LongType):
        return F.when(c.isNotNull(), F.coalesce(F.try_subtract(v, rest), F.lit(-(1 << 63))))
    low = v - rest
    return low.try_cast(data_type) if lenient else low.cast(data_type)


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _v6_prefix(groups: Column) -> Column:
    """The first 48 bits of an IPv6 address in lower case, or null where it is none."""
    side = lambda s: F.filter(F.split(s, ":", -1), lambda g: s != "")
    halves = F.split(groups, "::", -1)

    def parts(h: Column) -> Column:
        return F.struct(F.size(h).alias("n"), side(F.get(h, F.lit(0))).alias("head"), side(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("tail"))

    def fill(p: Column) -> Column:
        gap = F.lit(8) - F.size(p["head"]) - F.size(p["tail"])
        fits = F.when(p["n"] == 2, gap >= 1).otherwise((p["n"] == 1) & (gap == 0))
        return F.when(fits, F.concat(p["head"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), p["tail"]))

    def shorten(every: Column) -> Column:
        first = F.transform(F.slice(every, 1, 3), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
        return F.when(F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")), first)

    def show(first: Column) -> Column:
        used = F.when(first[2] != "0", 3).when(first[1] != "0", 2).when(first[0] != "0", 1).otherwise(0)
        return F.when(first.isNotNull(), F.concat(F.array_join(F.slice(first, F.lit(1), used), ":"), F.lit("::")))

    return let(let(let(let(halves, parts), fill), shorten), show)


def ip_prefix(c: Column) -> Column:
    """IPv4 to 24 bits, IPv6 to 48; zones go; what is no address is all stars."""
    bare = F.regexp_replace(F.regexp_replace(c, "/[0-9]+$", ""), "%.*$", "")
    size = lambda bits: F.when(c.rlike("/[0-9]+$"), bits).otherwise("")

    def cut(b: Column) -> Column:
        v4 = F.concat(F.regexp_extract(b, r"^(.*\.)[0-9]+$", 1), F.lit("0"), size("/24"))
        v6 = F.concat(_v6_prefix(F.lower(F.regexp_replace(b, rf"(?<=:){_V4}$", "0:0"))), size("/48"))
        return F.when(b.rlike(f"^{_V4}$"), v4).when(b.contains(":"), F.coalesce(v6, _stars(F.length(c)))).otherwise(_stars(F.length(c)))

    return let(bare, cut)


def mask(c: Column, spec: MaskSpec, f: T.StructField, key: Key, lenient: bool = False, projection: tuple[str, ...] = (), batches: bool = False) -> Column:
    """``c`` under ``spec``.  A mask that does not support the type is an error, never a pass.

    ``batches``: keyed digests of texts in Arrow batches, with the key in no plan.
    """
    kind, logical, dt = spec.mask, logical_type(f), f.dataType
    if not supports(kind, dt, logical):
        raise MaskError(f"{kind.value} cannot mask {dt.simpleString()}")
    match kind:
        case Mask.NONE:
            return c
        case Mask.NULL:
            return F.lit(None).cast(dt)
        case Mask.REDACT:
            return redact(c)
        case Mask.PARTIAL:
            return partial(c, spec.keep)
        case Mask.INNER:
            return inner(c, spec.keep)
        case Mask.OUTER:
            return outer(c, spec.keep)
        case Mask.RANGE:
            return span(c, spec.start, spec.end)
        case Mask.HASH:
            return digest(c, key, spec.domain, batches)
        case Mask.PSEUDONYM if logical == "uuid":
            return pseudonym_uuid(c, key, spec.domain, lenient)
        case Mask.PSEUDONYM:
            return pseudonym(c, key, spec.domain, spec.keep_domain, batches)
        case Mask.DATE_YEAR:
            return coarse_date(c, "year", dt)
        case Mask.DATE_MONTH:
            return coarse_date(c, "month", dt)
        case Mask.NUMERIC_BUCKET:
            return bucket(c, spec.bucket, dt, lenient)
        case Mask.IP_PREFIX:
            return ip_prefix(c)
        case Mask.SCRUB:
            return scrub(c)
        case Mask.JSON:
            return mask_shaped(c, spec, key, dt, projection, batches) if spec.json_schema else mask_documents(c, spec, key, dt, projection)
    raise MaskError(kind.value)
