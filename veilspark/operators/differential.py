"""A second engine beside the guarded session: served statements run twice and are compared.

Each generated statement that a session serves is also run by DuckDB over the same files, without
any policy, in a task of its own; the masks that the session decided on are then put on its values in plain
Python, batch by batch, and the two results are compared as multisets of rows, by their fingerprints.  So a mask on the wrong field, a
mask done wrong, a filter that ran over masked values or a lost row all show.
"""

from __future__ import annotations

import datetime as dt
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from tempfile import TemporaryDirectory
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PolicyRejection
from ..functions.keyed import Key
from ..functions.scalars import mask_text
from ..plans.planner import FieldPlan
from ..spec import Mask
from .fingerprints import halves, told, totals
from .session import GuardedSession

#: Tables with their unique column, joins to others, and columns by kind.
TABLES = {
    "region": ("r_regionkey", {}, {"text": ["r_name"], "number": ["r_regionkey"]}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}, {"text": ["n_name"], "number": ["n_nationkey", "n_regionkey"]}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}, {"text": ["s_name"], "number": ["s_suppkey", "s_nationkey", "s_acctbal"]}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}, {"text": ["c_name", "c_mktsegment"], "number": ["c_custkey", "c_nationkey", "c_acctbal"]}),
    "part": ("p_partkey", {}, {"text": ["p_name", "p_brand", "p_type"], "number": ["p_partkey", "p_size"]}),
}


@dataclass
class Portable:
    """Statements that both engines read alike, by seed."""

    seed: int

    def __post_init__(self) -> None:
        self.rng = random.Random(self.seed)

    def statement(self) -> str:
        r = self.rng
        table = r.choice(list(TABLES))
        key, joins, kinds = TABLES[table]
        source, columns = f"demo.{table}", [c for cs in kinds.values() for c in cs]
        while joins and r.random() < 0.5:
            own, other = r.choice(sorted(joins.items()))
            there, joins, more = TABLES[other]
            source = f"{source} {r.choice(('JOIN', 'LEFT JOIN', 'JOIN', 'FULL JOIN'))} demo.{other} ON {own} = {there}"
            kinds = {k: kinds.get(k, []) + more.get(k, []) for k in ("text", "number")}
            columns = [c for cs in kinds.values() for c in cs]
        where = f" WHERE {self.predicate(kinds)}" if r.random() < 0.6 else ""
        shape = r.random()
        if shape < 0.35:
            picked = r.sample(columns, min(len(columns), r.randint(1, 4)))
            if r.random() < 0.4:
                return f"SELECT {', '.join(f'{c} AS f{i}' for i, c in enumerate(picked))} FROM {source}{where}"
            return f"SELECT {r.choice(('', 'DISTINCT '))}{', '.join(picked)} FROM {source}{where}"
        if shape < 0.5:
            n = r.randint(1, 40)
            return f"SELECT {', '.join(dict.fromkeys([key, *r.sample(columns, min(3, len(columns)))]))} FROM {source}{where}{' AND ' if where else ' WHERE '}{key} IS NOT NULL ORDER BY {key} {r.choice(('', 'DESC '))}LIMIT {n}" if "JOIN" not in source else f"SELECT {key} FROM {source}{where}"
        if shape < 0.65:
            group = r.choice(columns)
            return f"SELECT {group}, count(*) AS n, count(DISTINCT {r.choice(columns)}) AS d FROM {source}{where} GROUP BY {group}{r.choice(('', ' HAVING count(*) > 1'))}"
        if shape < 0.75:
            inner = f"SELECT {', '.join(f'{c} AS g{i}' for i, c in enumerate(columns))} FROM {source}{where}"
            picked = r.sample(range(len(columns)), min(len(columns), 2))
            return f"WITH w AS ({inner}) SELECT {', '.join(f'g{i}' for i in picked)} FROM w" if r.random() < 0.5 else f"SELECT {', '.join(f'q.g{i}' for i in picked)} FROM ({inner}) q"
        if shape < 0.85 and "JOIN" not in source:
            return f"SELECT {r.choice(columns)}, row_number() OVER (ORDER BY {key}) AS place, count(*) OVER () AS everyone FROM {source}{where}"
        if shape < 0.93:
            other = r.choice(list(TABLES))
            return f"SELECT {r.choice(columns)} FROM {source} WHERE {key} {r.choice(('', 'NOT '))}IN (SELECT {TABLES[other][0]} FROM demo.{other} WHERE {self.predicate(TABLES[other][2])})"
        return f"SELECT {r.choice(columns)}, CASE WHEN {self.predicate(kinds)} THEN 'yes' ELSE 'no' END AS said FROM {source}{where}"

    def predicate(self, kinds: dict[str, list[str]]) -> str:
        r = self.rng
        text, number = r.choice(kinds["text"]), r.choice(kinds["number"])
        return r.choice((
            f"{number} > {r.randint(0, 30)}", f"{number} BETWEEN {r.randint(0, 9)} AND {r.randint(9, 500)}", f"{number} IN ({r.randint(0, 9)}, {r.randint(0, 99)}, 7)", f"{text} IS NOT NULL", f"{text} LIKE '%{r.choice('aeiou0123456789')}%'", f"length({text}) > {r.randint(3, 20)}",
            f"upper({text}) < 'M'", f"{number} + 1 < {r.randint(5, 900)} OR {text} IS NULL", f"NOT ({number} = {r.randint(0, 9)})",
        ))


def masked(value, plan: FieldPlan, key: Key):
    """A value under a decided mask, in plain Python."""
    kind = plan.spec.mask
    if value is None or kind is Mask.NULL:
        return None
    if kind is Mask.NONE:
        return value
    if kind in (Mask.DATE_YEAR, Mask.DATE_MONTH):
        return value.replace(**{"day": 1, "month": 1 if kind is Mask.DATE_YEAR else value.month} | ({"hour": 0, "minute": 0, "second": 0, "microsecond": 0} if isinstance(value, dt.datetime) else {}))
    if kind is Mask.NUMERIC_BUCKET:
        return math.floor(value / plan.spec.bucket) * plan.spec.bucket
    return mask_text(value, plan.spec, key)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_WHOLE_BESIDE = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT", "UTINYINT", "USMALLINT", "UINTEGER"}
#: Kinds of values that both engines tell alike: Spark's name and Arrow's type.
_KINDS = {"whole": ("long", pa.int64()), "number": ("double", pa.float64()), "date": ("date", pa.date32()), "time": ("timestamp_ntz", pa.timestamp("us")), "text": ("string", pa.string())}
#: Statements whose results are compared in one job.
AT_ONCE = 20


def _kind(served: T.DataType, beside: str) -> str:
    if isinstance(served, _WHOLE) and beside in _WHOLE_BESIDE:
        return "whole"
    if isinstance(served, T.NumericType):
        return "number"
    return "date" if isinstance(served, T.DateType) else "time" if isinstance(served, (T.TimestampType, T.TimestampNTZType)) else "text"


def _told(c: Column, kind: str) -> Column:
    """A value as both engines tell it; numbers to ten digits."""
    return F.format_string("%.9e", c.cast("double")) if kind == "number" else c.cast(_KINDS[kind][0])


def _views(connection, files: dict[str, list[str]]) -> None:
    for t, paths in files.items():
        listed = ", ".join("'" + p.replace("'", "''") + "'" for p in paths)
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet([{listed}])")


def _masked_column(values: pa.Array, plan: FieldPlan, key: Key, kind: str) -> pa.Array:
    """A column under its decided mask; each value that repeats in a batch is masked once."""
    if not plan.spec.passes:
        coded = values.dictionary_encode()
        done = [masked(v, plan, key) for v in coded.dictionary.to_pylist()]
        if kind == "number":
            done = [None if v is None else float(v) for v in done]
        values = pa.array(done, _KINDS[kind][1] if kind != "text" else None).take(coded.indices)
    return values.cast(_KINDS[kind][1])


def _beside(spark: SparkSession, files: dict[str, list[str]], text: str, plans: list[FieldPlan], key: Key, kinds: list[str]) -> DataFrame:
    """A statement's rows by the second engine, which runs in a task and hands on batches, under the masks in plain Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        for _ in batches:  # one row, which says: run
            with TemporaryDirectory() as spill:
                beside = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": spill, "preserve_insertion_order": False})
                _views(beside, files)
                for found in beside.sql(text).to_arrow_reader(65_536):
                    columns = [_masked_column(c, p, key, k) for c, p, k in zip(found.columns, plans, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
                beside.close()

    return spark.range(0, 1, 1, 1).mapInArrow(run, ", ".join(f"c{i} {_KINDS[k][0]}" for i, k in enumerate(kinds)))


def _hashed(frame: DataFrame, kinds: list[str], once: bool, number: int, side: str) -> DataFrame:
    rows = frame.toDF(*[f"c{i}" for i in range(len(kinds))]).select(*[_told(F.col(f"c{i}"), k).alias(f"c{i}") for i, k in enumerate(kinds)])
    rows = rows.distinct() if once else rows
    return rows.select(F.lit(number).alias("statement"), F.lit(side).alias("side"), *halves([F.col(f"c{i}") for i in range(len(kinds))]))


@dataclass
class Differences:
    statements: int = 0
    served: int = 0
    rows: int = 0
    different: list[str] = field(default_factory=list)


def compare(guard: GuardedSession, sf_dir: str, seed: int, n: int, principal: str | None = None, tamper: Callable | None = None) -> Differences:
    """``n`` statements of one seed.  ``tamper`` changes the served frames, to see that a difference is noticed.

    Rows of either engine stay in tasks; the driver gets a fingerprint of each result.  The second engine reads and
    runs a statement in one task, within 512 MB and its own spill files.
    """
    import duckdb

    spark = guard.spark
    files = {t: sorted(unquote(urlparse(f).path) for f in spark.read.parquet(f"{sf_dir}/{t}.parquet").inputFiles()) for t in TABLES}
    beside = duckdb.connect()
    _views(beside, files)
    made, out, key = Portable(seed), Differences(), guard.policy.config.key
    held: list[tuple[str, list[DataFrame]]] = []

    def flush() -> None:
        sides = [s for _, both in held for s in both]
        if not sides:
            return
        found = {(r["statement"], r["side"]): told(r) for r in reduce(DataFrame.unionAll, sides).groupBy("statement", "side").agg(*totals()).collect()}
        for i, (text, _) in enumerate(held):
            got, want = (found.get((i, s), told(None)) for s in ("served", "beside"))
            out.rows += want[0]
            if got != want:
                out.different.append(text)
        held.clear()

    for _ in range(n):
        text = made.statement()
        out.statements += 1
        try:
            plans, frame = guard.decisions(text, principal), guard.sql(text, principal)
        except PolicyRejection:
            continue
        out.served += 1
        frame = tamper(frame) if tamper else frame
        plain = text.replace("demo.", "")
        kinds = [_kind(f.dataType, row[1]) for f, row in zip(frame.schema.fields, beside.execute(f"DESCRIBE {plain}").fetchall(), strict=True)]
        once = "DISTINCT" in text[:20] and any(not p.spec.passes for p in plans)
        held.append((text, [_hashed(frame, kinds, once, len(held), "served"), _hashed(_beside(spark, files, plain, plans, key, kinds), kinds, once, len(held), "beside")]))
        if len(held) == AT_ONCE:
            flush()
    flush()
    beside.close()
    return out
