"""Text masks for one value at a time: leaves of JSON documents, and a second opinion in tests."""

from __future__ import annotations

import ipaddress
import re

from ..errors import MaskError
from ..spec import Mask, MaskSpec
from .keyed import Key
from .scrub import py_scrub


def pseudonym(v: str, key: Key, domain: str | None, keep_domain: bool) -> str:
    local = key.digest(v.encode(), domain)[:8].hex()
    name, at, host = v.partition("@")
    if not (name and at and host):
        return local
    return f"{local}@{host}" if keep_domain else f"{local}@{key.digest(b'domain' + bytes(1) + host.encode(), domain)[:4].hex()}.invalid"


def ip_prefix(v: str) -> str:
    sized = re.search("/[0-9]+$", v)
    try:
        ip = ipaddress.ip_address(re.sub("%.*$", "", v[: sized.start()] if sized else v))
    except ValueError:
        return "*" * len(v)
    bits = 24 if ip.version == 4 else 48
    out = str(ipaddress.ip_network(f"{ip}/{bits}", strict=False).network_address)
    return f"{out}/{bits}" if sized else out


def mask_text(v: str, spec: MaskSpec, key: Key) -> str | None:
    n, k = len(v), spec.keep
    match spec.mask:
        case Mask.REDACT:
            return "***"
        case Mask.PARTIAL:
            return "*" * n if n <= k else "*" * (n - k) + v[n - k :]
        case Mask.INNER:
            return "*" * n if n <= 2 * k else v[:k] + "*" * (n - 2 * k) + v[n - k :]
        case Mask.OUTER:
            return "*" * n if not k or n <= 2 * k else "*" * k + v[k : n - k] + "*" * k
        case Mask.RANGE:
            e = min(spec.end, n)
            return "*" * n if n <= spec.start else v[: spec.start] + "*" * (e - spec.start) + v[e:]
        case Mask.HASH:
            return key.digest(v.encode(), spec.domain)[:16].hex()
        case Mask.PSEUDONYM:
            return pseudonym(v, key, spec.domain, spec.keep_domain)
        case Mask.IP_PREFIX:
            return ip_prefix(v)
        case Mask.SCRUB:
            return py_scrub(v)
        case Mask.NONE:
            return v
        case Mask.NULL:
            return None
    raise MaskError(f"{spec.mask.value} cannot mask text")
