"""Unique-key discovery: the least sets of columns that tell all rows of a table apart.

The search goes level by level, single columns first.  A set of columns is only looked
at where no part of it is a key already, and where its distinct values could be as many as the
rows: by the product of its columns' counts, then by a sketch of its own.  What is
left is settled exactly, by 64-bit hashes of the rows' values: first one hash in ``SLICE``, which finds two equal rows of
most sets that are no keys, then, set by set, all hashes.  Rows that are equal have equal hashes,
so without two equal hashes a set is a key; two equal hashes are looked up in the rows, and where their
values differ the set is grouped by its values.  Sets with a column of a type that does not hash as it groups are
always grouped by values: one ``GROUPING SETS`` (an Expand and one aggregate) for each ``at_once``.

Null is a value like any other, as in GROUP BY.  Sketches only prune: a set is dropped where its estimate is more
than ten standard deviations below the number of rows.

Scale: one pass for the sketches of a level; for each ``at_once`` candidates that survive them one pass that
shuffles one hash in ``SLICE`` and one that looks up what it found; for each that survives this too, keys above all, one shuffle of 8 bytes and
a count a row.  Sets that are far from unique cost a sketch.  Groups are aggregated
where they stand first, so a hot value crosses the network once a task.

Defined results: a table without rows has no keys; one with a single row has each of its columns;
repeated rows leave no key at all; columns of types that cannot be grouped are no part of keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = tuple[frozenset[str], ...]
#: Relative standard deviation of the sketches, and how many of them an estimate may lie low.
SPREAD, MARGIN = 0.02, 10
SKETCHES_AT_ONCE = 64
#: The share of hashes that is looked at first is one in so many.
SLICE = 64
#: Types whose values hash alike where GROUP BY takes them for one.
_HASHED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _can_group(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _can_group(kind.elementType)
    return all(_can_group(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def _batches(items: list, size: int) -> Iterator[list]:
    for a in range(0, len(items), size):
        yield items[a : a + size]


def _together(columns: Iterable[str]) -> Column:
    # a struct is never null, so null counts as a value
    return F.xxhash64(F.struct(*[F.struct(F.col(c)) for c in columns]), *[F.col(c).isNull() for c in columns])


def discover_keys(frame: DataFrame, most_columns: int = 2, at_once: int = 12) -> Keys:
    """All minimal keys of at most ``most_columns`` columns, in lower case; the shortest first, then by name."""
    names = [f.name for f in frame.schema if _can_group(f.dataType)]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("column names repeat")
    # columns get plain names of their own, whatever theirs hold
    data = frame.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    rows, found, distinct = data.count(), [], {}
    if not rows:
        return ()
    for level in range(1, most_columns + 1):
        sets = [s for s in combinations(range(len(names)), level) if not any(set(k) <= set(s) for k in found)]
        if level > 1:
            sets = [s for s in sets if _product(distinct[(i,)] for i in s) >= rows]
        for batch in _batches(sets, SKETCHES_AT_ONCE):
            told = data.agg(*[F.approx_count_distinct(_together(f"c{i}" for i in s), SPREAD).alias(f"n{k}") for k, s in enumerate(batch)]).first()
            distinct |= {s: told[f"n{k}"] / (1 - MARGIN * SPREAD) for k, s in enumerate(batch)}  # no fewer than there are
        for batch in _batches([s for s in sets if distinct[s] >= rows], at_once):
            found += _keys_of(data, batch)
    return tuple(frozenset(names[i].lower() for i in k) for k in sorted(found, key=lambda k: (len(k), [names[i] for i in k])))


def _product(counts: Iterable[float]) -> float:
    out = 1.0
    for n in counts:
        out *= n
    return out


def _hashes_well(kind: T.DataType) -> bool:
    return isinstance(kind, _HASHED) or kind == T.StringType()  # not one of another collation


def _keys_of(data: DataFrame, sets: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Those of ``sets`` without two equal rows: by hashes, and by values where these do not tell."""
    kinds = [f.dataType for f in data.schema]
    by_values = [s for s in sets if not all(_hashes_well(kinds[i]) for i in s)]
    found, left = [], [s for s in sets if s not in by_values]
    if left:
        refuted = _equal_rows(data, _repeated_hashes(data, left, SLICE))
        for s in left:
            if s in refuted:
                continue
            if not (repeated := _repeated_hashes(data, [s], 1)):
                found.append(s)
            elif s not in _equal_rows(data, repeated):
                by_values.append(s)
    return found + (_unique(data, by_values) if by_values else [])


def _repeated_hashes(data: DataFrame, sets: list[tuple[int, ...]], one_in: int) -> dict[tuple[int, ...], int]:
    """Sets with a hash that more than one row has, and the hash; of the hashes that ``one_in`` divides."""
    hashes = F.array(*[F.struct(F.lit(k).alias("which"), _together(f"c{i}" for i in s).alias("h")) for k, s in enumerate(sets)])
    if len(sets) == 1:
        rows = data.select(F.lit(0).alias("which"), _together(f"c{i}" for i in sets[0]).alias("h"))
    else:
        rows = data.select(F.inline(F.filter(hashes, lambda e: F.pmod(e["h"], F.lit(one_in)) == 0)))
    if one_in > 1:
        rows = rows.where(F.pmod("h", F.lit(one_in)) == 0)
    twice = rows.groupBy("which", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return {sets[r["which"]]: r["h"] for r in twice.groupBy("which").agg(F.max_by("h", "n").alias("h")).collect()}  # one row a set


def _equal_rows(data: DataFrame, repeated: dict[tuple[int, ...], int]) -> set[tuple[int, ...]]:
    """Those sets whose rows of the given hash are not all different, by their values."""
    if not repeated:
        return set()
    sets = list(repeated)
    used = sorted({i for s in sets for i in s})
    hit = [_together(f"c{i}" for i in s) == F.lit(h) for s, h in repeated.items()]
    which = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(hit)]), lambda k: k.isNotNull())
    rows = data.select(F.explode(which).alias("which"), *[f"c{i}" for i in used])
    # a column that is no part of the row's set counts for nothing
    part = {i: F.col("which").isin([k for k, s in enumerate(sets) if i in s]) for i in used}
    groups = rows.groupBy("which", *[F.when(part[i], F.col(f"c{i}")).alias(f"c{i}") for i in used]).count().where("count > 1")
    return {sets[r["which"]] for r in groups.select("which").distinct().collect()}


def _unique(data: DataFrame, sets: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Those of ``sets`` without two equal rows, exactly."""
    used = sorted({i for s in sets for i in s})
    columns = [f"c{i}" for i in used]
    grouped = data.groupingSets([[F.col(f"c{i}") for i in s] for s in sets], *map(F.col, columns)).agg(F.grouping_id().alias("which"), F.count(F.lit(1)).alias("n"))
    most = {r["which"]: r["most"] for r in grouped.groupBy("which").agg(F.max("n").alias("most")).collect()}  # one row a set
    bit = {i: 1 << (len(used) - 1 - k) for k, i in enumerate(used)}
    everything = sum(bit.values())
    return [s for s in sets if most.get(everything - sum(bit[i] for i in s)) == 1]
