"""Keyed digests, in two ways that give the same digits.

As native expressions (:func:`mac_hex`): HMAC-SHA256 from sha2 and two padded keys.  The padded
keys are literals of the plan, so they stand for the key itself:
:func:`redaction_conf` hides them from explain output, and guarded sessions do
not hand out plans.

In Arrow batches (:func:`in_batches`): the key stays in a Python closure, so no plan holds it, its
two padded blocks are hashed once a batch and not once a value, and a value that repeats in a batch is hashed once.
"""

from __future__ import annotations

import hmac
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError

#: Matches the padded keys however a plan prints them.
REDACTION = r"(?i)(X'[0-9a-f]{64,}'|0x[0-9a-f]{64,}|[0-9a-f]{128,}|\[[0-9A-F]{2}( [0-9A-F]{2}){31,}\])"


def redaction_conf() -> dict[str, str]:
    return {"spark.sql.redaction.string.regex": REDACTION}


@dataclass(frozen=True)
class Key:
    """A pseudonym key of at least 16 bytes; it never prints itself."""

    secret: bytes

    def __post_init__(self) -> None:
        if len(self.secret) < 16:
            raise ConfigError("pseudonym_key needs at least 16 bytes")

    def __repr__(self) -> str:
        return "Key(withheld)"

    def pads(self) -> tuple[bytes, bytes]:
        key = sha256(self.secret).digest() if len(self.secret) > 64 else self.secret
        key = key.ljust(64, b"\0")
        return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)

    def digest(self, value: bytes, domain: str | None) -> bytes:
        """The same digest in Python, for tests and small jobs."""
        return hmac.new(self.secret, _prefix(domain) + value, sha256).digest()


def _prefix(domain: str | None) -> bytes:
    return b"" if domain is None else domain.encode() + b"\0"


Texts = Callable[[list[bytes]], list[str]]


def hasher(key: Key, domain: str | None, salt: bytes = b"", digits: int = 64) -> Texts:
    """Hex digits of the digests of values, from states that have taken in the key already."""
    inner, outer = key.pads()
    first, second = sha256(inner + _prefix(domain) + salt).copy, sha256(outer).copy

    def run(values: list[bytes]) -> list[str]:
        out = []
        for value in values:
            a, b = first(), second()
            a.update(value)
            b.update(a.digest())
            out.append(b.hexdigest()[:digits])
        return out

    return run


def in_batches(c: Column, make: Callable[[], Texts]) -> Column:
    """A function over the distinct values of an Arrow batch; ``make`` gives it, once a batch."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        if not len(values):
            return pa.array([], pa.string())
        coded = values.cast(pa.binary()).dictionary_encode()
        return pa.array(make()(coded.dictionary.to_pylist()), pa.string()).take(coded.indices)

    return run(c.cast("string"))


def mac_hex(key: Key, value: Column, domain: str | None, salt: bytes = b"") -> Column:
    """64 hex digits of the digest of domain, 0x00, salt and the value's bytes."""
    inner, outer = key.pads()
    head = inner + _prefix(domain) + salt
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(head), value.cast("binary")), 256))), 256)


def mac_sql(key: Key, value: str, domain: str | None, salt: bytes = b"") -> str:
    """The same digest for DuckDB, from the same pads; ``value`` is a BLOB expression."""
    inner, outer = key.pads()
    head = inner + _prefix(domain) + salt
    return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{head.hex()}') || {value})))"
