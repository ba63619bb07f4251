"""A seeded campaign of generated statements that looks for masked values in what is served.

Tables hold canaries: texts, dates and numbers that can be known again wherever they turn
up.  Statements are put together from all shapes that the gates let through and some that
they must not.  What is served is run, and every value is held against the
canaries; a served canary is a leak.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PolicyRejection
from ..sources.config import Config
from .session import GuardedSession

#: A canary however it is printed: a text, a day in May 2033, or a number that ends in 123.
CANARY = re.compile(r"CANARY|2033-05|7\d{3}123(?!\d)|7\.\d{3}123E6")
#: Columns of both tables with their kinds; x and y texts, d a date and n a number are masked.
COLUMNS = (("id", "number"), ("r", "text"), ("m", "number"), ("x", "text"), ("y", "text"), ("d", "date"), ("n", "number"))
TABLES = ("fz.t", "fz.u")
OWN = {c for c, _ in COLUMNS}
_NONE, _STAR = {"mask": "none"}, {"mask": "redact"}
RULES = {"id": _NONE, "r": _NONE, "m": _NONE, "x": _STAR, "y": _STAR, "d": {"mask": "date-year"}, "n": {"mask": "numeric-bucket", "bucket": 1000}}


#: Given tables of which fz.t and fz.u are copies: key and name.
COPIED = {"fz.t": ("supplier", "s_suppkey", "s_name"), "fz.u": ("nation", "n_nationkey", "n_name")}


def guard(spark: SparkSession, sf_dir: str, rules: dict | None = None, **overlay: object) -> GuardedSession:
    """A session over copies of given tables, with canaries planted in every row."""
    given = {"pseudonym_key": "0123456789abcdef", "unique_keys": {t: [["id"]] for t in TABLES}, "columns": {t: RULES | (rules or {}) for t in TABLES}}
    g = GuardedSession(spark, Config.build(given | overlay))
    for k, t in enumerate(TABLES):
        table, key, name = COPIED[t]
        i = F.col(key).cast("long")
        canary = lambda n, i=i, name=name: F.concat(F.col(name), F.lit(" CANARY"), (i + n).cast("string"))
        day = F.expr(f"timestampadd(DAY, CAST({key} % 20 AS INT), TIMESTAMP '2033-05-0{2 + k} 00:00:00')")
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        planted = rows.select(i.alias("id"), F.concat(F.lit("r"), F.floor(i / 3)).alias("r"), F.floor(i / 5).alias("m"), canary(100 * k).alias("x"), canary(100 * k + 50).alias("y"), day.alias("d"), (7_000_123 + 1000 * (i % 1000)).alias("n"))
        g.add_table(t, planted)
    return g


@dataclass
class Generator:
    """Statements by seed: relations of some depth, then expressions over their columns."""

    seed: int
    names: int = 0
    ctes: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rng = random.Random(self.seed)

    def name(self) -> str:
        self.names += 1
        return f"q{self.names}"

    def statement(self) -> str:
        self.ctes = []
        source, columns = self.relation(self.rng.choice((0, 1, 1, 2, 3)))
        body = self.select(source, columns)
        if self.rng.random() < 0.08:
            other, more = self.relation(1)
            body = f"{body} {self.rng.choice(('UNION', 'UNION ALL', 'EXCEPT', 'INTERSECT'))} {self.select(other, more)}"
        return (f"WITH {', '.join(self.ctes)} " if self.ctes else "") + body

    # ------------------------------------------------------------- relations
    def relation(self, depth: int) -> tuple[str, list[tuple[str, str]]]:
        pick = self.rng.random()
        if depth <= 0 or pick < 0.12:
            return self.base()
        if pick < 0.30:
            inner, columns = self.relation(depth - 1)
            items, out = self.items(columns, plain=self.rng.random() < 0.6)
            tail = self.rng.choice(("", "", " LIMIT 9", " ORDER BY 1 LIMIT 5", " OFFSET 2"))
            return f"(SELECT {self.rng.choice(('', '', 'DISTINCT '))}{items} FROM {inner}{self.where(columns)}{tail}) {self.name()}", out
        if pick < 0.42:
            inner, columns = self.relation(depth - 1)
            fresh = [(self.name(), kind) for _, kind in columns]
            return f"(SELECT * FROM {inner}) AS {self.name()}({', '.join(c for c, _ in fresh)})", fresh
        if pick < 0.52:
            inner, columns = self.relation(depth - 1)
            name, fresh = self.name(), [(self.name(), kind) for _, kind in columns]
            self.ctes.append(f"{name}({', '.join(c for c, _ in fresh)}) AS (SELECT * FROM {inner})")
            return name, fresh
        if pick < 0.64:
            (a, left), (b, right) = self.aliased(depth - 1), self.aliased(0)
            kind = self.rng.choice(("JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN", "LEFT SEMI JOIN", "LEFT ANTI JOIN", "CROSS JOIN"))
            if kind == "CROSS JOIN":  # all pairs with a few rows, however large the copies are
                b, right = f"(SELECT id AS {right[0][0]}, x AS {right[1][0]} FROM {self.rng.choice(TABLES)} WHERE id < 12) {self.name()}", right[:2]
            on = "" if kind == "CROSS JOIN" else f" ON {self.rng.choice(left)[0]} = {self.rng.choice(right)[0]}"
            out = left if "SEMI" in kind or "ANTI" in kind else left + right
            return f"{a} {kind} {b}{on}", out
        if pick < 0.72:
            inner, columns = self.relation(depth - 1)
            texts = [c for c, k in columns if k == "text"] or [columns[0][0]]
            two = self.rng.sample(texts, min(2, len(texts)))
            v, n = self.name(), self.name()
            keep = [(v, "text"), (n, "text")]
            return f"(SELECT {v}, {n} FROM {inner} UNPIVOT ({v} FOR {n} IN ({', '.join(two)}))) {self.name()}", keep
        if pick < 0.80:
            (a, left), (b, right) = self.relation(depth - 1), self.base()
            one, two = self.rng.choice(left), self.rng.choice(right)
            op = self.rng.choice(("UNION", "UNION ALL", "EXCEPT", "INTERSECT"))
            return f"(SELECT {one[0]} FROM {a} {op} SELECT {two[0]} FROM {b}) {self.name()}", [one]
        if pick < 0.88:
            inner, columns = self.relation(depth - 1)
            key, value, g, s = self.rng.choice(columns), self.rng.choice(columns), self.name(), self.name()
            by = self.rng.choice((key[0], key[0], f"ROLLUP ({key[0]})", f"CUBE ({key[0]})", f"GROUPING SETS (({key[0]}), ())"))
            function = self.rng.choice(("count", "sum", "avg", "max", "min", "count(DISTINCT"))
            call = f"{function} {value[0]})" if function.endswith("DISTINCT") else f"{function}({value[0]})"
            return f"(SELECT {key[0]} AS {g}, {call} AS {s} FROM {inner} GROUP BY {by}) {self.name()}", [(g, key[1]), (s, "number")]
        if pick < 0.94:
            inner, columns = self.relation(depth - 1)
            w = self.name()
            order = self.rng.choice(columns)[0]
            function = self.rng.choice(("row_number()", "rank()", "ntile(3)", "count(*)", f"sum({order})", f"lag({order})", f"first_value({order})"))
            return f"(SELECT *, {function} OVER (ORDER BY {order}) AS {w} FROM {inner}) {self.name()}", [*columns, (w, "number")]
        t, out = self.name(), self.name()
        inner, columns = self.aliased(0)
        return f"{inner}, LATERAL (SELECT {self.rng.choice(columns)[0]} AS {out}) {t}", [*columns, (out, "text")]

    def base(self) -> tuple[str, list[tuple[str, str]]]:
        pick, t = self.rng.random(), self.rng.choice(TABLES)
        if pick < 0.55:
            return t, list(COLUMNS)
        if pick < 0.75:
            fresh = [(self.name(), kind) for _, kind in COLUMNS]
            return f"{t} AS {self.name()}({', '.join(c for c, _ in fresh)})", fresh
        if pick < 0.82:
            return f"{t} TABLESAMPLE (60 PERCENT)", list(COLUMNS)
        if pick < 0.87:
            a, b = self.name(), self.name()
            return f"(VALUES (1, 'one'), (2, 'two')) AS {self.name()}({a}, {b})", [(a, "number"), (b, "text")]
        if pick < 0.91:
            return f"IDENTIFIER('{t}')", list(COLUMNS)
        return f"(SELECT * FROM {t} WHERE id < 20) {self.name()}", list(COLUMNS)

    def aliased(self, depth: int) -> tuple[str, list[tuple[str, str]]]:
        inner, columns = self.relation(depth)
        fresh = [(self.name(), kind) for _, kind in columns]
        return f"(SELECT * FROM {inner}) AS {self.name()}({', '.join(c for c, _ in fresh)})", fresh

    # ----------------------------------------------------------- expressions
    def select(self, source: str, columns: list[tuple[str, str]]) -> str:
        pick = self.rng.random()
        if pick < 0.2:
            return f"SELECT * FROM {source}{self.where(columns)}"
        if pick < 0.3:
            return f"SELECT {self.expression(columns)} AS v FROM {source}{self.where(columns)} ORDER BY 1 LIMIT 7"
        if pick < 0.4:
            c = self.rng.choice(columns)[0]
            return f"SELECT {c}, {self.rng.choice(('count(*)', f'avg({c})', f'max({c})', f'corr({c}, {c})'))} AS s FROM {source} GROUP BY {c}{self.rng.choice(('', ' + 0', ' HAVING count(*) > 0'))}"
        items, _ = self.items(columns)
        return f"SELECT {items} FROM {source}{self.where(columns)}"

    def items(self, columns: list[tuple[str, str]], plain: bool = False) -> tuple[str, list[tuple[str, str]]]:
        out, parts = [], []
        for _ in range(self.rng.randint(1, 3)):
            name = self.name()
            c = self.rng.choice(columns)
            parts.append(f"{c[0] if plain or self.rng.random() < 0.4 else self.expression(columns)} AS {name}")
            out.append((name, c[1]))
        return ", ".join(parts), out

    def expression(self, columns: list[tuple[str, str]]) -> str:
        r = self.rng
        a, b = r.choice(columns)[0], r.choice(columns)[0]
        dates = [c for c, k in columns if k == "date"] or [a]
        d, unit = r.choice(dates), r.choice(("day", "week", "month", "quarter", "year", "decade"))
        return r.choice((
            a, a, f"upper({a})", f"{a} || ''", f"concat({a}, {b})", f"coalesce({a}, {b})", f"nullif({a}, {b})", f"CASE WHEN {a} IS NULL THEN 'n' ELSE 'v' END", f"CASE WHEN true THEN {a} ELSE {b} END",
            f"if(true, {a}, {b})", f"CAST({a} AS STRING)", f"CAST({a} AS INT)", f"try_cast({a} AS INT)", f"substring({a}, 1, 50)", f"{a} = {b}", f"{a} IS NULL", f"date_trunc('{unit}', {d})", f"trunc({d}, 'MM')",
            f"date_trunc('{unit}', {d}) = TIMESTAMP '2033-05-07 00:00:00'", f"length({a})", f"{a} + 0", f"abs({a})", f"round({a})", f"greatest({a}, {b})", f"struct({a}).col1", f"array({a})[0]", f"map('k', {a})['k']",
            f"(SELECT max({a}))", f"(SELECT x FROM {r.choice(TABLES)} LIMIT 1)", f"EXISTS (SELECT 1 FROM fz.t WHERE id = 1)", f"{a} IN (SELECT id FROM fz.u)", f"count(*) OVER (ORDER BY {a})", f"max({a}) OVER ()",
            f"parse_json({a}) IS NOT NULL", f"try_parse_json({a}) IS NULL", f"variant_get(parse_json({a}), '$.k', 'string')", f"variant_get(parse_json({a}), '$.k', 'int')", f"format_string({a}, {b})", f"format_string('%s', {a})", f"encode('v', {a})",
            f"'v' LIKE {a}", f"{a} BETWEEN {b} AND {a}", f"to_json(struct({a}))", f"get_json_object({a}, '$.k')", f"md5({a})", f"reverse({a})", f"IDENTIFIER('{a}')", f"IDENTIFIER('upper')({a})", f"element_at(array({a}), 1)", f"extract(DAY FROM {d})", "1", "'text'", "current_date()",
        ))

    def where(self, columns: list[tuple[str, str]]) -> str:
        if self.rng.random() < 0.6:
            return ""
        a = self.rng.choice(columns)[0]
        # a name that fz.t has not is the outer row's: Spark pairs its values with all rows below, so there is one row wherever fz.t has any
        below = "fz.t" if a in OWN else "(SELECT DISTINCT 1 FROM fz.t) below"
        return self.rng.choice((f" WHERE {a} IS NOT NULL", f" WHERE {a} = {a}", f" WHERE {a} IN (SELECT {a} FROM {below})", f" WHERE CAST({a} AS INT) = 1", f" WHERE IDENTIFIER('{a}') IS NOT NULL", f" WHERE parse_json({a}) IS NOT NULL", f" WHERE variant_get(parse_json({a}), '$.k', 'int') = 1", f" WHERE 'v' LIKE {a}", " WHERE 1 = 1"))


@dataclass
class Report:
    statements: int = 0
    served: int = 0
    leaks: list[str] = field(default_factory=list)
    causes: Counter[str] = field(default_factory=Counter)


#: What a caller may make of a result before running it; the last two fail by naming a value where there is one.
CHAINS = (
    lambda f: f, lambda f: f, lambda f: f.distinct(), lambda f: f.limit(3), lambda f: f.sample(0.5), lambda f: f.groupBy(f"`{f.columns[0]}`").count(), lambda f: f.agg(F.count("*").alias("n")), lambda f: f.dropna(), lambda f: f.describe(),
    lambda f: f.withColumns({"more": F.lit(1)}), lambda f: f.select(F.col(f"`{f.columns[0]}`").cast("string").cast("date").alias("v")), lambda f: f.groupBy(F.col(f"`{f.columns[-1]}`").cast("string").cast("int").alias("v")).count(),
)


def run(g: GuardedSession, seed: int, n: int, batch: int = 40, chained: float = 0.2) -> Report:
    """``n`` statements of one seed; served results are run ``batch`` at a time, some of them after more steps, one by one."""
    made, report, held = Generator(seed), Report(), []
    after = random.Random(seed + 1)

    def flush() -> None:
        found = _canaries([f for _, f in held]) if held else False
        if found is None or found:  # a failure hides what the others gave: one by one
            report.leaks += [t for t, frame in held if _canaries([frame])]
        held.clear()

    for _ in range(n):
        text = made.statement()
        report.statements += 1
        try:
            frame = g.sql(text)
        except PolicyRejection as e:
            report.causes[e.cause.value] += 1
            if CANARY.search(f"{e} {e.hint}"):
                report.leaks.append(text)
            continue
        report.served += 1
        if frame.columns and len(set(frame.columns)) == len(frame.columns) and after.random() < chained:
            try:
                leaked = _canaries([after.choice(CHAINS)(frame)])
            except PolicyRejection as e:
                leaked = bool(CANARY.search(f"{e} {e.hint}"))
            if leaked:
                report.leaks.append(text)
            continue
        held.append((text, frame))
        if len(held) == batch:
            flush()
    flush()
    return report


def _canaries(frames: list[DataFrame]) -> bool | None:
    """Whether any value of the frames prints a canary; None where running them failed without one in the message."""
    printed = None
    for f in frames:
        places = f.toDF(*[f"c{i}" for i in range(len(f.columns))])
        one = places.select(F.concat_ws("|", *[F.col(c).cast("string") for c in places.columns]).alias("v"))
        printed = one if printed is None else printed.unionAll(one)
    if printed is None:
        return False
    try:
        # every value is printed and searched where it stands; the driver gets one flag
        return bool(printed.agg(F.max(F.col("v").rlike(CANARY.pattern)).alias("leaked")).first()["leaked"])
    except PolicyRejection as e:
        return True if CANARY.search(str(e)) else None
