"""Propose a policy from schemas and samples, and find where a policy has drifted.

Sampling is one aggregation over at most ``sample`` rows a table, all columns
and detectors at once; values never leave it, only counts.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.masks import _V4, _v6_prefix
from ..functions.scrub import luhn, mod97, only_digits
from ..sources.config import Config
from ..spec import Mask, declared_width, logical_type, supports


class Confidence(StrEnum):
    CLEAR = "clear"
    LIKELY = "likely"
    REVIEW = "needs-review"
    ORDINARY = "ordinary"


def is_email(v: Column) -> Column:
    return F.trim(v).rlike(r"(?s)^[^@]+@(?!\.).*\.")


def is_ip(v: Column) -> Column:
    t = F.trim(v)
    six = F.when(t.contains(":") & ~t.contains("%") & ~t.contains("/"), _v6_prefix(F.lower(F.regexp_replace(t, rf"(?<=:){_V4}$", "0:0"))).isNotNull())
    return t.rlike(f"^{_V4}$") | F.coalesce(six, F.lit(False))


def is_phone(v: Column) -> Column:
    return F.length(only_digits(v)).between(7, 15) & v.rlike(r"^[0-9 ()+.\-]*$")


def is_card(v: Column) -> Column:
    bare = F.regexp_replace(v, "[ -]", "")
    return bare.rlike("^[0-9]{13,19}$") & luhn(v)


def is_iban(v: Column) -> Column:
    bare = F.upper(F.replace(v, F.lit(" "), F.lit("")))
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), mod97(bare) == 1).otherwise(F.lit(False))


def is_ssn(v: Column) -> Column:
    bare = F.regexp_replace(F.trim(v), "[ -]", "")
    return bare.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


#: Shapes that discovery looks for, most specific first.
DETECTORS = (("payment", is_card), ("payment", is_iban), ("national_id", is_ssn), ("email", is_email), ("ip_address", is_ip), ("phone", is_phone))

#: Fixed values: (type, mask, pattern on the lower-case name, detector, what a human must settle), the first match wins.
NAME_RULES = (
    ("secret", "null", r"password|passwd|secret|token|api_key|apikey|private_key|salt$|_hash$", None, ""),
    ("national_id", "null", r"ssn|social_security|passport|national_id|tax_id|nino", None, ""),
    ("payment", "null", r"card_number|cardnum|ccn|iban|bank_account|account_number|routing", None, ""),
    ("email", "pseudonym", r"e_?mail", is_email, ""),
    ("phone", "partial", r"phone|mobile|telephone|^fax", is_phone, ""),
    ("person_name", "redact", r"first_name|last_name|given_name|family_name|surname|full_name|contact_name|person_name|owner_name|customer_name|employee_name", None, ""),
    ("street_address", "redact", r"street|address_line|addr_line|^address$|^addr$", None, ""),
    ("postal_code", "range", r"zip|postal|postcode", None, ""),
    ("birth_date", "date-year", r"birth_date|birth_dt|date_of_birth|^dob$|_dob$|birthday", None, ""),
    ("compensation", "numeric-bucket", r"salary|compensation|wage|income|bonus|commission", None, ""),
    ("ip_address", "ip-prefix", r"(^|_)ip_addr|_ip$|^ip$|client_ip|remote_addr", is_ip, ""),
    ("geo", "numeric-bucket", r"latitude|longitude|^lat$|^lon$|^lng$", None, ""),
    ("free_text", "null", r"notes?$|comment|description|body|message|content|remarks", None, ""),
    ("person_name", "redact", r"^name$|^who$|manager|recipient|^contact$|user_name|login_name|display_name|screen_name", None, "a person or an organisation"),
    ("account_id", "pseudonym", r"_uuid$|^uuid$|_guid$|^guid$|external_id|_ref$|(customer|user|account|member|person|employee|patient)_id", None, "an identifier that joins"),
    ("demographic", "null", r"gender|marital|ethnic|^race$|religio|disabilit|educatio|citizenship|veteran|credit_rating", None, "a special category"),
    ("quasi_identifier", "null", r"birth", None, "part of a birth date"),
    ("birth_date", "date-year", r"^age$|_age$", None, "an age"),
    ("geo", "redact", r"^city$|_city$|^state$|_state$|^province|_province$|^county$|_county$", None, "a coarse place"),
    ("free_text", "null", r"url$|_uri$|link$|referrer|user_agent", None, "a link that can carry identity"),
)
#: The least width that can hold a kind of value.
LEAST_WIDTH = {"email": 6, "phone": 7, "street_address": 3, "person_name": 2, "ip_address": 7, "national_id": 8, "payment": 8}
LEAST_SAMPLE, LEAST_RATE = 20, 0.8


@dataclass(frozen=True)
class Proposal:
    relation: str
    column: str
    data_type: str
    semantic_type: str | None
    mask: str
    confidence: Confidence
    note: str = ""


def _is_text(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))


def by_name(relation: str, f: T.StructField) -> Proposal:
    name = f.name.lower()
    kind = f.dataType.simpleString()
    for semantic, mask, pattern, _, doubt in NAME_RULES:
        if not re.search(pattern, name):
            continue
        wide = declared_width(f)
        if wide is not None and wide < LEAST_WIDTH.get(semantic, 1):
            return Proposal(relation, f.name, kind, None, "none", Confidence.ORDINARY, "too narrow for what its name says")
        fits = supports(Mask(mask), f.dataType, logical_type(f))
        if doubt or not fits:
            return Proposal(relation, f.name, kind, semantic, mask, Confidence.REVIEW, doubt or "the mask does not fit the type")
        return Proposal(relation, f.name, kind, semantic, mask, Confidence.LIKELY)
    return Proposal(relation, f.name, kind, None, "none", Confidence.ORDINARY)


def sample_rates(frame: DataFrame, columns: list[str], sample: int) -> dict[str, tuple[int, list[float]]]:
    """Per column: values seen, and the share of them that each detector takes."""
    if not columns:
        return {}
    some = frame.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).limit(sample)
    aggs = []
    for i in range(len(columns)):
        aggs.append(F.count(f"c{i}").alias(f"n{i}"))
        aggs += [F.avg(F.when(F.col(f"c{i}").isNotNull(), d(F.col(f"c{i}")).cast("int"))).alias(f"r{i}_{k}") for k, (_, d) in enumerate(DETECTORS)]
    row = some.agg(*aggs).first()
    return {c: (row[f"n{i}"], [row[f"r{i}_{k}"] or 0.0 for k in range(len(DETECTORS))]) for i, c in enumerate(columns)}


def propose(tables: dict[str, DataFrame], sample: int = 0) -> list[Proposal]:
    """One proposal a column, by name; with ``sample`` rows also checked and discovered by content."""
    out = []
    for relation, frame in sorted(tables.items()):
        proposals = [by_name(relation, f) for f in frame.schema]
        if sample:
            rates = sample_rates(frame, [f.name for f in frame.schema if _is_text(f)], sample)
            proposals = [_with_sample(p, f, rates.get(p.column)) for p, f in zip(proposals, frame.schema, strict=True)]
        out += proposals
    return out


def _with_sample(p: Proposal, f: T.StructField, seen: tuple[int, list[float]] | None) -> Proposal:
    if seen is None:
        return p
    n, rates = seen
    if p.semantic_type is not None:
        detector = next((d for s, _, pattern, d, _ in NAME_RULES if s == p.semantic_type and d is not None and re.search(pattern, f.name.lower())), None)
        if detector is None or not n:
            return p
        rate = max(r for r, (_, d) in zip(rates, DETECTORS, strict=True) if d is detector)
        sure = rate >= LEAST_RATE and supports(Mask(p.mask), f.dataType, logical_type(f))
        return replace(p, confidence=Confidence.CLEAR if sure else Confidence.REVIEW, note=f"{rate:.0%} of {n} values fit")
    shapes = list(dict.fromkeys(s for r, (s, _) in zip(rates, DETECTORS, strict=True) if r >= LEAST_RATE))
    if n < LEAST_SAMPLE or not shapes:
        return p
    return replace(p, semantic_type="unidentified", mask="null", confidence=Confidence.REVIEW, note=f"values look like {' or '.join(shapes)}")


def check(config: Config, tables: dict[str, DataFrame], sample: int = 0) -> list[tuple[str, str, str]]:
    """(problem, relation, column): missing and stale rules, masks that do not fit, plaintext, and released but sensitive content."""
    known = {(r.lower(), f.name.lower()): f for r, d in tables.items() for f in d.schema}
    if not known:
        return [("empty_schema", "", "")]
    found = []
    for where, rule in config.rules.items():
        if where not in known:
            found.append(("stale_rule", *where))
            continue
        specs = [rule.spec, *(s for _, s in rule.by_role)]
        if not all(s.supports(known[where]) for s in specs):
            found.append(("mask_does_not_fit", *where))
    for where in known:
        if where not in config.rules:
            found.append(("plaintext" if config.unclassified == "allow" else "missing_rule", *where))
    if sample:
        for relation, frame in tables.items():
            open_text = [f.name for f in frame.schema if _is_text(f) and (rule := config.rules.get((relation.lower(), f.name.lower()))) and rule.spec.passes]
            for column, (n, rates) in sample_rates(frame, open_text, sample).items():
                if n >= LEAST_SAMPLE and max(rates) >= LEAST_RATE:
                    found.append(("released_but_sensitive", relation.lower(), column.lower()))
    return sorted(found)


def as_frame(spark: SparkSession, proposals: list[Proposal]) -> DataFrame:
    rows = [(p.relation, p.column, p.data_type, p.semantic_type, p.mask, p.confidence.value) for p in proposals]
    return spark.createDataFrame(rows, "relation string, column_name string, data_type string, semantic_type string, mask string, confidence string")


def emit_toml(proposals: list[Proposal]) -> str:
    """A policy draft that the config source can read once it has a key."""
    extra = {"numeric-bucket": ["bucket = 1000"], "partial": ["keep = 4"], "range": ["start = 2", "end = 64"]}
    lines = ["# A draft: every NEEDS REVIEW line wants a decision; columns that are not listed are masked.", ""]
    named = [p for p in proposals if p.semantic_type]
    for name, mask in sorted({(p.semantic_type or "", p.mask) for p in named}):
        lines += ["[[semantic_type]]", f"name = {json.dumps(_type_name(name, mask, named))}", f"mask = {json.dumps(mask)}", *extra.get(mask, []), ""]
    for relation in sorted({p.relation for p in named}):
        lines.append(f"[columns.{json.dumps(relation)}]")
        for p in named:
            if p.relation == relation:
                flag = "  # NEEDS REVIEW" if p.confidence is Confidence.REVIEW else ""
                lines.append(f"{json.dumps(p.column)} = {{ type = {json.dumps(_type_name(p.semantic_type or '', p.mask, named))} }}{flag}")
        lines.append("")
    return "\n".join(lines)


def _type_name(name: str, mask: str, named: list[Proposal]) -> str:
    """One type has one mask; a second mask of a kind gets a type of its own."""
    first = min(p.mask for p in named if p.semantic_type == name)
    return name if mask == first else f"{name}_{mask.replace('-', '_')}"
