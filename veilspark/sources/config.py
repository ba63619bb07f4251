"""Policy files: TOML text to a checked configuration.  Unknown keys are errors."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import ConfigError
from ..functions.jsonmask import validate_rules
from ..functions.jsonshape import check_shape
from ..functions.keyed import Key
from ..spec import Mask, MaskSpec, most_restrictive

#: Keys with the values they may take; the first is the default.
CHOICES = {
    "unclassified": ("mask", "allow"),
    "unclassified_mask": ("type-aware", "null"),
    "opaque": ("reject", "mask"),
    "summaries": ("allow", "refuse"),
    "posture": ("default", "hostile"),
    "system_catalogs": ("refuse", "allow"),
    "lineage": ("refuse", "allow"),
    "digests": ("native", "batches"),
}
_PARAMS = {"keep", "start", "end", "bucket", "keep_domain", "domain", "json_unlisted", "json_max_bytes", "json_max_depth", "json_schema", "json", "json_keys"}
_TYPE_KEYS = {"name", "mask", "by_role"} | _PARAMS
_RULE_KEYS = {"type", "mask", "by_role"} | _PARAMS
#: Settings of the wire protocol, accepted so that a policy file can be shared, and not used here.
_UNUSED = {
    "listen", "backend", "catalog_dsn", "tls_cert", "tls_key", "require_client_tls", "backend_tls", "backend_ca", "catalog_refresh_seconds",
    "catalog_refresh_min_seconds", "metrics_interval_seconds", "metrics_listen", "max_notices_per_exchange",
}
_TOP = set(CHOICES) | _UNUSED | {"pseudonym_key", "column", "columns", "semantic_type", "role", "rate_limit_per_minute", "rate_limit_burst", "unique_keys", "not_null"}


def _known(given: dict, allowed: set[str], where: str) -> None:
    if extra := sorted(set(given) - allowed):
        raise ConfigError(f"{where}: unknown key {extra[0]!r}")


def _kind(name: object, where: str) -> Mask:
    try:
        return Mask(str(name))
    except ValueError:
        raise ConfigError(f"{where}: unknown mask {name!r}") from None


def _rules(given: dict, where: str) -> tuple[tuple[str, MaskSpec], ...]:
    out = []
    for path, rule in given.items():
        rule = {"mask": rule} if isinstance(rule, str) else rule
        _known(rule, {"mask"} | _PARAMS, f"{where} {path}")
        out.append((path, _spec(rule, {}, None, f"{where} {path}")))
    return tuple(out)


def _spec(own: dict, base: dict, domain: str | None, where: str) -> MaskSpec:
    """A spec from a rule's parameters over its type's."""
    got = {k: v for k, v in {**base, **own}.items() if k in _PARAMS}
    kind = _kind(own.get("mask", base.get("mask")), where)
    if kind is not Mask.JSON and any(k.startswith("json") for k in got):
        raise ConfigError(f"{where}: JSON parameters need the json mask")
    for k in ("json", "json_keys"):
        if k in got:
            got[k] = _rules(got[k], where)
    got.setdefault("domain", domain)
    shape = got.pop("json_schema", None)
    spec = MaskSpec(mask=kind, json_schema=None if shape is None else json.dumps(shape), **got).validate(where)
    if kind is Mask.JSON:
        validate_rules(spec, where)
        if shape is not None:
            check_shape(shape, where, spec.json_max_depth)
    return spec


@dataclass(frozen=True)
class Classification:
    """A column's mask, and those that roles have in its place."""

    spec: MaskSpec
    by_role: tuple[tuple[str, MaskSpec], ...] = ()
    semantic_type: str | None = None

    def for_roles(self, roles: frozenset[str]) -> MaskSpec:
        mine = [(r, s) for r, s in self.by_role if r in roles]
        return most_restrictive(mine) if mine else self.spec

    @property
    def releases_all(self) -> bool:
        return self.spec.passes and all(s.passes for _, s in self.by_role)


@dataclass(frozen=True)
class Config:
    key: Key
    rules: dict[tuple[str, str], Classification] = field(default_factory=dict)  #: (relation, column) in lower case
    roles: dict[str, frozenset[str]] = field(default_factory=dict)  #: principal to roles
    unclassified: str = "mask"
    unclassified_mask: str = "type-aware"
    opaque: str = "reject"
    summaries: str = "allow"
    posture: str = "default"
    system_catalogs: str = "refuse"
    lineage: str = "refuse"
    digests: str = "native"  #: where keyed digests are made: native expressions, whose plans hold the key, or Arrow batches
    rate_limit_per_minute: int = 0
    rate_limit_burst: int = 0
    unique_keys: tuple[frozenset[str], ...] = ()  #: bare column names of each declared key
    table_keys: dict[str, tuple[frozenset[str], ...]] = field(default_factory=dict)  #: the same, by table
    not_null: frozenset[tuple[str, str]] = frozenset()

    def roles_of(self, principal: str | None) -> frozenset[str]:
        return self.roles.get(principal or "", frozenset())

    @staticmethod
    def load(path: str | Path) -> Config:
        return Config.parse(Path(path).read_text())

    @staticmethod
    def parse(text: str) -> Config:
        try:
            return Config.build(tomllib.loads(text))
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"not TOML: {e}") from None

    @staticmethod
    def build(given: dict) -> Config:
        _known(given, _TOP, "policy")
        if "pseudonym_key" not in given:
            raise ConfigError("pseudonym_key is required")
        options = {}
        for name, allowed in CHOICES.items():
            options[name] = given.get(name, allowed[0])
            if options[name] not in allowed:
                raise ConfigError(f"{name} is one of {', '.join(allowed)}")
        if options["posture"] == "hostile":
            options["summaries"] = "refuse"
        types: dict[str, dict] = {}
        for t in given.get("semantic_type", []):
            _known(t, _TYPE_KEYS, "semantic_type")
            if t["name"] in types:
                raise ConfigError(f"semantic type {t['name']!r} is given twice")
            types[t["name"]] = t
            _compile({"type": t["name"]}, types, f"semantic_type {t['name']}")
        found: dict[tuple[str, str], Classification] = {}

        def add(relation: str, column: str, rule: dict) -> None:
            where = (relation.lower(), column.lower())
            if where in found:
                raise ConfigError(f"{relation}.{column} has two rules")
            found[where] = _compile(rule, types, f"{relation}.{column}")

        for c in given.get("column", []):
            _known(c, _RULE_KEYS | {"relation", "column"}, "column")
            add(c["relation"], c["column"], {k: v for k, v in c.items() if k not in ("relation", "column")})
        for relation, columns in given.get("columns", {}).items():
            for column, rule in columns.items():
                _known(rule, _RULE_KEYS, f"{relation}.{column}")
                add(relation, column, rule)
        members: dict[str, set[str]] = {}
        names = set()
        for r in given.get("role", []):
            _known(r, {"name", "members"}, "role")
            if r["name"] in names:
                raise ConfigError(f"role {r['name']!r} is given twice")
            names.add(r["name"])
            for m in r.get("members", []):
                members.setdefault(m, set()).add(r["name"])
        rate, burst = given.get("rate_limit_per_minute", 0), given.get("rate_limit_burst", 0)
        if min(rate, burst) < 0 or burst and not rate:
            raise ConfigError("rate limits are not negative, and a burst needs a rate")
        return Config(
            Key(str(given["pseudonym_key"]).encode()), found, {m: frozenset(r) for m, r in members.items()}, rate_limit_per_minute=rate, rate_limit_burst=burst or rate,
            unique_keys=tuple(frozenset(c.lower() for c in k) for keys in given.get("unique_keys", {}).values() for k in keys),
            table_keys={t.lower(): tuple(frozenset(c.lower() for c in k) for k in keys) for t, keys in given.get("unique_keys", {}).items()},
            not_null=frozenset((t.lower(), c.lower()) for t, cs in given.get("not_null", {}).items() for c in cs), **options,
        )


def _compile(rule: dict, types: dict[str, dict], where: str) -> Classification:
    named = rule.get("type")
    if named is not None and named not in types:
        raise ConfigError(f"{where}: unknown type {named!r}")
    base = types.get(named, {})
    if "mask" not in rule and "mask" not in base:
        raise ConfigError(f"{where}: a rule needs a type or a mask")
    spec = _spec(rule, base, named, where)
    by_role = {**base.get("by_role", {}), **rule.get("by_role", {})}
    # a role changes the kind of mask and shares its parameters
    roles = tuple((r, spec.with_mask(_kind(m, where)).validate(where)) for r, m in sorted(by_role.items()))
    return Classification(spec, roles, named)
