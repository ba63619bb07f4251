"""JSON masking without Python: documents of a declared shape, walked by expressions.

A policy may declare what a column's documents look like (``json_schema``): a table of keys for an
object, a list of one shape for an array, ``{"*" = shape}`` for an object of any keys, and
``integer``, ``number``, ``string`` or ``boolean`` for a leaf.  The rules are then followed down
the shape once, while the statement is planned, and each leaf becomes the native expression of its
mask; rows are parsed as variants and put together again as text, all in the JVM.

Keys may be missing and any value may be null.  A document with a key or type that is not
declared is refused, as one that is too long or no JSON is, with an error that tells nothing of it.
Numbers are printed without an exponent or closing zeros.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, MaskError
from ..spec import Mask, MaskSpec
from .jsonmask import DocumentMask, Trie
from .keyed import Key
from .scrub import let

Shape = "str | list | dict"
LEAVES = ("integer", "number", "string", "boolean")
ANY = "*"
Place = tuple[list[tuple[int, Trie]], "MaskSpec | None"]


def check_shape(shape: object, where: str, most_depth: int, depth: int = 0) -> None:
    """Raise where a declared shape is none."""
    if depth > most_depth:
        raise ConfigError(f"{where}: the declared shape is deeper than json_max_depth")
    if isinstance(shape, str):
        if shape not in LEAVES:
            raise ConfigError(f"{where}: a leaf is one of {', '.join(LEAVES)}, not {shape!r}")
    elif isinstance(shape, list):
        if len(shape) != 1:
            raise ConfigError(f"{where}: an array has one shape")
        check_shape(shape[0], where, most_depth, depth + 1)
    elif isinstance(shape, dict):
        if ANY in shape and len(shape) > 1:
            raise ConfigError(f"{where}: {ANY} stands alone")
        for inner in shape.values():
            check_shape(inner, where, most_depth, depth + 1)
    else:
        raise ConfigError(f"{where}: {shape!r} is no shape")


def below(shape: Shape, path: tuple[str, ...]) -> Shape:
    """The shape at the end of a path."""
    for token in path:
        inner = shape[0] if isinstance(shape, list) and token.isdigit() else shape.get(token, shape.get(ANY)) if isinstance(shape, dict) else None
        if inner is None:
            raise MaskError("an extracted path is not in the declared shape")
        shape = inner
    return shape


def _refused(why: str) -> Column:
    return F.raise_error(F.lit(why)).cast("string")


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _floored(n: Column, bucket: int) -> Column:
    """The bucket of a whole number; decimals hold what a long overflows."""
    whole = n.cast("decimal(38,0)")
    return (whole - F.pmod(whole, F.lit(bucket).cast("decimal(38,0)"))).cast("decimal(38,0)").cast("string")


class ShapeWalk:
    """The rules of one column, followed down its declared shape."""

    def __init__(self, spec: MaskSpec, key: Key, text_mask: Callable[[Column, MaskSpec], Column]) -> None:
        self.spec, self.rules, self.text_mask = spec, DocumentMask(spec, key), text_mask

    def document(self, text: Column, start: tuple[str, ...] = ()) -> Column:
        """The masked text of documents, or of what ``->`` took from under ``start``."""
        place: Place = (self.rules.at, self.rules.inherited)
        for token in start:
            place = self.rules._step(*place, token, token.isdigit())
        shape = below(json.loads(self.spec.json_schema or ""), start)
        masked = let(F.try_parse_json(text), lambda v: F.when(v.isNull(), _refused("a value is not JSON")).otherwise(self.value(v, shape, place)))
        return F.when(F.octet_length(text) > self.spec.json_max_bytes, _refused("a JSON document exceeds its limits")).when(text.isNotNull(), masked)

    def value(self, v: Column, shape: Shape, place: Place) -> Column:
        if isinstance(shape, str):
            return self._leaf(v, shape, place[1])
        inner = self._array if isinstance(shape, list) else self._any_keys if ANY in shape else self._object
        kind = "array<variant>" if isinstance(shape, list) else "map<string,variant>"
        found = let(F.try_variant_get(v, "$", kind), lambda held: F.when(held.isNull(), _other()).otherwise(inner(held, shape, place)))
        return F.when(F.is_variant_null(v), F.lit("null")).otherwise(found)

    def _object(self, held: Column, shape: dict, place: Place) -> Column:
        def part(k: str) -> Column:
            inner = let(F.element_at(held, F.lit(k)), lambda v: self.value(v, shape[k], self.rules._step(*place, k, False)))
            return F.when(F.map_contains_key(held, F.lit(k)), F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), inner))

        parts = [part(k) for k in sorted(shape)]
        more = F.array_except(F.map_keys(held), F.array(*map(F.lit, sorted(shape))).cast("array<string>"))
        return F.when(F.size(more) > 0, _other()).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))

    def _any_keys(self, held: Column, shape: dict, place: Place) -> Column:
        known = sorted({k for _, t in place[0] for k in t.below} | set(self.rules.keys))

        def one(e: Column) -> Column:
            # a key that no rule names goes where any such key does
            text = self.value(e["value"], shape[ANY], self.rules._step(*place, _unnamed(known), False))
            for k in known:
                text = F.when(e["key"] == k, self.value(e["value"], shape[ANY], self.rules._step(*place, k, False))).otherwise(text)
            return F.struct(e["key"].alias("key"), text.alias("text"))

        entries = F.array_sort(F.transform(F.map_entries(held), one))
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["text"])), ","), F.lit("}"))

    def _array(self, held: Column, shape: list, place: Place) -> Column:
        known = sorted({int(k) for _, t in place[0] for k in t.below if k.isdigit() and str(int(k)) == k})

        def one(v: Column, i: Column) -> Column:
            text = self.value(v, shape[0], self.rules._step(*place, str(known[-1] + 1 if known else 0), True))
            for k in known:
                text = F.when(i == k, self.value(v, shape[0], self.rules._step(*place, str(k), True))).otherwise(text)
            return text

        return F.concat(F.lit("["), F.array_join(F.transform(held, one), ","), F.lit("]"))

    def _leaf(self, v: Column, kind: str, rule: MaskSpec | None) -> Column:
        told = F.schema_of_variant(v)
        whole = told == "BIGINT"
        fits = {"integer": whole, "number": whole | told.startswith("DECIMAL"), "string": told == "STRING", "boolean": told == "BOOLEAN"}[kind]
        return F.when(F.is_variant_null(v), F.lit("null")).when(fits, self._printed(v, kind, rule)).otherwise(_other())

    def _printed(self, v: Column, kind: str, rule: MaskSpec | None) -> Column:
        plain = quoted(F.try_variant_get(v, "$", "string")) if kind == "string" else F.to_json(v)
        if rule is None:
            shape_only = {"string": '""', "boolean": "false"}.get(kind, "0")
            return {"null": F.lit("null"), "shape-only": F.lit(shape_only), "pass-through": plain}[self.spec.json_unlisted]
        if rule.mask is Mask.NONE:
            return plain
        if rule.mask is Mask.NULL:
            return F.lit("null")
        if kind == "string" and rule.mask is not Mask.NUMERIC_BUCKET:
            return quoted(self.text_mask(F.try_variant_get(v, "$", "string"), rule))
        if rule.mask is Mask.NUMERIC_BUCKET and kind == "integer":
            return _floored(F.try_variant_get(v, "$", "bigint"), rule.bucket)
        if rule.mask is Mask.NUMERIC_BUCKET and kind == "number":
            # a bucket's edges are whole numbers, so what follows the point never moves a value over one
            text = F.to_json(v)
            cut = F.regexp_extract(text, r"^(-?[0-9]+)", 1).cast("decimal(38,0)")
            below_zero = text.startswith("-") & text.rlike(r"\.[0-9]*[1-9]")
            return _floored(F.when(below_zero, cut - 1).otherwise(cut), rule.bucket)
        raise MaskError("a declared JSON leaf does not fit its mask")


def _other() -> Column:
    return _refused("a JSON document does not have its declared shape")


def _unnamed(known: list[str]) -> str:
    """A key that is none of ``known``."""
    name = "-"
    while name in known:
        name += "-"
    return name


def mask_shaped(c: Column, spec: MaskSpec, key: Key, data_type: T.DataType, start: tuple[str, ...], batches: bool) -> Column:
    from .masks import mask  # it masks documents by this module

    plain = T.StructField("leaf", T.StringType())
    walk = ShapeWalk(spec, key, lambda text, rule: mask(text, rule, plain, key, batches=batches))
    if isinstance(data_type, T.VariantType):
        return F.parse_json(walk.document(F.to_json(c), start))
    return walk.document(c, start)
