"""Several principals at once while the policy is swapped: does anybody get another's view?

Every generation of the policy masks a text so that its mask tells the generation and the role it was made for.
Principals ask in threads on one session while another thread reloads.  Each result
must be of one generation, one that was in force while it was asked for, and of the role of
whoever asked.  Results stay in tasks: their fingerprints are held against those of the views that
each role may have, which are made once, in one pass over the people.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Event, Thread

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import Config
from .fingerprints import halves, told, totals
from .session import GuardedSession

#: What each role sees of a text of 60 characters: its first ``keep`` are shown, from ``shift`` on.
ROLES = {"ann": "analyst", "sam": "support", "bob": "builder", "eve": None}
MASKS = {"analyst": "inner", "support": "partial", "builder": "range", None: "outer"}


def policy(generation: int) -> Config:
    """The ``generation``-th policy: how many characters it keeps tells which."""
    keep = generation % 23 + 1
    rule = {"mask": "outer", "keep": keep, "start": keep, "end": 59, "by_role": {r: m for r, m in MASKS.items() if r}}
    return Config.build({"pseudonym_key": "0123456789abcdef", "role": [{"name": r, "members": [p]} for p, r in ROLES.items() if r], "columns": {"who.people": {"id": {"mask": "none"}, "name": rule, "again": rule}}})


def expected(name: str, role: str | None, generation: int) -> str:
    keep, n = generation % 23 + 1, len(name)
    return {
        "analyst": name[:keep] + "*" * (n - 2 * keep) + name[n - keep :], "support": "*" * (n - keep) + name[n - keep :], "builder": name[:keep] + "*" * (59 - keep) + name[59:], None: "*" * keep + name[keep : n - keep] + "*" * keep,
    }[role]


def expected_column(name: Column, role: str | None, generation: int) -> Column:
    """:func:`expected`, by Spark's functions for texts."""
    keep, n = generation % 23 + 1, F.length(name)
    stars = lambda k: F.repeat(F.lit("*"), k if isinstance(k, Column) else F.lit(k))
    head, tail = F.substring(name, 1, keep), F.right(name, F.lit(keep))
    return {
        "analyst": F.concat(head, stars(n - 2 * keep), tail), "support": F.concat(stars(n - keep), tail),
        "builder": F.concat(head, stars(59 - keep), F.substring(name, F.lit(60), n)), None: F.concat(stars(keep), F.substring(name, F.lit(keep + 1), n - 2 * keep), stars(keep)),
    }[role]


def fingerprints_of(people: DataFrame) -> dict[tuple[str | None, int, bool], tuple[int, ...]]:
    """The fingerprint of each role's view at each number of kept characters: of all rows, and of those with an id from 0 on."""
    views = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(g % 23 + 1).alias("keep"), expected_column(F.col("name"), r, g).alias("e")) for r, m in MASKS.items() for g in range(23)])
    rows = people.select("id", F.inline(views)).select("id", "mask", "keep", *halves([F.col("id"), F.col("e"), F.col("e")]))
    roles = {m: r for r, m in MASKS.items()}
    out = {}
    for some, part in ((False, rows), (True, rows.where("id >= 0"))):
        out |= {(roles[r["mask"]], r["keep"], some): told(r) for r in part.groupBy("mask", "keep").agg(*totals()).collect()}  # one row a view
    return out


#: What principals ask for.
TEXTS = ("SELECT id, name, again FROM who.people", "SELECT id, again AS name, name AS again FROM who.people WHERE id >= 0", "SELECT p.id, p.name, q.again FROM who.people p JOIN who.people q ON p.id = q.id ORDER BY p.id LIMIT 3")


@dataclass
class Witness:
    statements: int = 0
    generations: int = 0
    mixed: list[str] = field(default_factory=list)


def names_of(frame: DataFrame, column: str) -> DataFrame:
    """Texts of 60 characters, all different, made from a table's own."""
    return frame.select(F.col(column).cast("long").alias("id"), F.rpad(F.concat(F.col(column).cast("string"), F.lit("-"), F.sha2(F.col(column).cast("string"), 256)), 60, "x").alias("name")).withColumn("again", F.col("name"))


def campaign(spark: SparkSession, people: DataFrame, statements: int, threads: int = 8, seed: int = 3, session: Callable[..., GuardedSession] = GuardedSession) -> Witness:
    """people: id (no two alike), name, again (equal to name).  ``session`` makes the session under test."""
    guard = session(spark, policy(1))
    guard.add_table("who.people", people.hint("merge"))  # a broadcast would pass through the driver, once a statement
    views, none = fingerprints_of(people), told(None)
    first_three = people.where("id IS NOT NULL").orderBy("id").limit(3).collect()
    out, done = Witness(), Event()

    def swap() -> None:
        while not done.wait(0.05):
            out.generations = guard.reload(policy(guard.policy.generation + 1))

    def ask(n: int) -> None:
        rng = random.Random(seed * 100_003 + n)
        who = rng.choice(list(ROLES))
        text = rng.choice(TEXTS)
        first = guard.policy.generation
        frame = guard.sql(text, who)
        last, role = guard.policy.generation, ROLES[who]
        if "LIMIT" in text:
            rows = [tuple(r) for r in frame.collect()]
            right = bool(rows) and any(rows == [(r.id, *2 * [expected(r.name, role, g)]) for r in first_three] for g in range(first, last + 1))
        else:
            seen = told(frame.select(*halves([F.col(c) for c in frame.columns])).agg(*totals()).first())
            right = seen != none and any(seen == views.get((role, g % 23 + 1, "WHERE" in text), none) for g in range(first, last + 1))
        out.statements += 1
        if not right:
            out.mixed.append(f"{who}: {text}")

    swapper = Thread(target=swap)
    swapper.start()
    try:
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(ask, range(statements)))
    finally:
        done.set()
        swapper.join()
    return out


class SharedPlans(GuardedSession):
    """A session with a fault: it keeps plans by statement, whoever asks.  The campaign must notice."""

    def _decide(self, statement: str, policy, principal: str | None, metadata: bool = True):
        kept = self.__dict__.setdefault("kept", {})
        if statement not in kept:
            kept[statement] = super()._decide(statement, policy, principal, metadata)
        return kept[statement]
