"""Mask specifications and which types each mask supports."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import StrEnum

from pyspark.sql import types as T

from .errors import ConfigError


class Mask(StrEnum):
    NONE = "none"
    NULL = "null"
    REDACT = "redact"
    PARTIAL = "partial"
    INNER = "inner"
    OUTER = "outer"
    RANGE = "range"
    HASH = "hash"
    PSEUDONYM = "pseudonym"
    DATE_YEAR = "date-year"
    DATE_MONTH = "date-month"
    NUMERIC_BUCKET = "numeric-bucket"
    IP_PREFIX = "ip-prefix"
    SCRUB = "scrub"
    JSON = "json"


#: How much a mask withholds; of several roles' masks the highest applies.
RESTRICTIVENESS = {
    Mask.NONE: 0,
    Mask.SCRUB: 1,
    Mask.JSON: 1,
    Mask.PARTIAL: 2,
    Mask.INNER: 2,
    Mask.OUTER: 2,
    Mask.RANGE: 2,
    Mask.DATE_MONTH: 3,
    Mask.IP_PREFIX: 3,
    Mask.NUMERIC_BUCKET: 3,
    Mask.DATE_YEAR: 4,
    Mask.PSEUDONYM: 5,
    Mask.HASH: 6,
    Mask.REDACT: 7,
    Mask.NULL: 8,
}

_TEXT = frozenset({Mask.REDACT, Mask.PARTIAL, Mask.INNER, Mask.OUTER, Mask.RANGE, Mask.HASH, Mask.PSEUDONYM, Mask.IP_PREFIX, Mask.SCRUB})
_DATE = frozenset({Mask.DATE_YEAR, Mask.DATE_MONTH})
_LOGICAL = {"uuid": frozenset({Mask.PSEUDONYM}), "inet": frozenset({Mask.IP_PREFIX}), "cidr": frozenset({Mask.IP_PREFIX}), "json": frozenset({Mask.JSON})}
#: Longest output of a pseudonym: 16 digits, @, 8 digits, ".invalid".
PSEUDONYM_WIDTH = 33


def logical_type(f: T.StructField) -> str:
    """Types that Spark keeps as strings: uuid, inet, cidr, json."""
    return f.metadata.get("logical_type", "")


def declared_width(f: T.StructField) -> int | None:
    """n of CHAR(n) and VARCHAR(n)."""
    told = f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")
    if isinstance(f.dataType, (T.CharType, T.VarcharType)):
        return f.dataType.length
    inner = told[told.find("(") + 1 : -1] if told.startswith(("char(", "varchar(")) else ""
    return int(inner) if inner.isdigit() else None


def supports(mask: Mask, data_type: T.DataType, logical: str = "") -> bool:
    """The one table of which mask can be applied to which type."""
    if mask in (Mask.NONE, Mask.NULL):
        return True
    if isinstance(data_type, T.VariantType):
        return mask is Mask.JSON
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return mask in _LOGICAL.get(logical, _TEXT)
    if isinstance(data_type, (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return mask is Mask.NUMERIC_BUCKET
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return mask in _DATE
    return False


@dataclass(frozen=True)
class MaskSpec:
    """A mask with its parameters."""

    mask: Mask = Mask.NONE
    keep: int = 4
    start: int = 0
    end: int = 0
    bucket: int = 1
    keep_domain: bool = False
    domain: str | None = None
    json_unlisted: str = "null"
    json_max_bytes: int = 1 << 20
    json_max_depth: int = 64
    json_schema: str | None = None  #: the declared shape of the documents, as JSON
    json: tuple[tuple[str, MaskSpec], ...] = field(default=())
    json_keys: tuple[tuple[str, MaskSpec], ...] = field(default=())

    @property
    def passes(self) -> bool:
        return self.mask is Mask.NONE

    def supports(self, f: T.StructField) -> bool:
        return supports(self.mask, f.dataType, logical_type(f))

    def with_mask(self, mask: Mask) -> MaskSpec:
        return replace(self, mask=mask)

    def validate(self, where: str) -> MaskSpec:
        if self.mask is Mask.NUMERIC_BUCKET and self.bucket < 2:
            raise ConfigError(f"{where}: numeric-bucket needs a bucket of 2 or more")
        if self.mask is Mask.RANGE and self.end <= self.start:
            raise ConfigError(f"{where}: range needs an end after its start")
        if self.mask is Mask.OUTER and self.keep < 1:
            raise ConfigError(f"{where}: outer needs a keep of 1 or more")
        if min(self.keep, self.start, self.end) < 0:
            raise ConfigError(f"{where}: counts are not negative")
        if not 1 <= self.json_max_depth <= 128 or self.json_max_bytes < 1:
            raise ConfigError(f"{where}: JSON limits are out of range")
        if self.json_unlisted not in ("null", "shape-only", "pass-through"):
            raise ConfigError(f"{where}: json_unlisted is null, shape-only or pass-through")
        if self.mask is not Mask.JSON and (self.json or self.json_keys or self.json_schema):
            raise ConfigError(f"{where}: json rules need the json mask")
        return self


def most_restrictive(specs: list[tuple[str, MaskSpec]]) -> MaskSpec:
    """Of (role, spec): the most restrictive; ties go to the first role by name."""
    return min(specs, key=lambda s: (-RESTRICTIVENESS[s[1].mask], s[0]))[1]


def fallback_for(f: T.StructField, source: str) -> MaskSpec:
    """The mask of an unclassified column: pseudonym, date, IP prefix, or null."""
    wide = declared_width(f)
    if source and supports(Mask.PSEUDONYM, f.dataType, logical_type(f)) and (wide is None or wide >= PSEUDONYM_WIDTH):
        return MaskSpec(Mask.PSEUDONYM, domain=f"unclassified:{source}")
    if supports(Mask.DATE_YEAR, f.dataType, logical_type(f)):
        return MaskSpec(Mask.DATE_YEAR)
    if logical_type(f) in ("inet", "cidr"):
        return MaskSpec(Mask.IP_PREFIX)
    return MaskSpec(Mask.NULL)
