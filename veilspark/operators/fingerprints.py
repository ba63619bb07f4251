"""Multisets of rows told apart by sums of hashes: a few numbers a result, whatever its size, and no shuffle of its rows.

Two results with the same rows, each as often, have the same sums; results that differ have other
sums but for a chance of about one in 2**128.  Null is a value of its own.  Sums are of halves of 32 bits, so
they are whole up to 2**31 rows and an error beyond.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF = (1 << 32) - 1


def halves(columns: list[Column]) -> list[Column]:
    """Two 64-bit hashes of a row in halves, one column each (named h0 to h3)."""
    values = [v for c in columns for v in (c.isNull(), c)]
    hashes = [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]
    parts = [p for h in hashes for p in (h.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(h, 32))]
    return [p.alias(f"h{i}") for i, p in enumerate(parts)]


def totals(prefix: str = "h") -> list[Column]:
    """The aggregates over :func:`halves`: rows, then sums."""
    return [F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(f"{prefix}{i}")).alias(f"s{i}") for i in range(4)]]


def told(row) -> tuple[int, ...]:
    """The fingerprint in a row of :func:`totals`; without any rows all zeros."""
    return (row["rows"], *[row[f"s{i}"] or 0 for i in range(4)]) if row is not None else (0,) * 5
