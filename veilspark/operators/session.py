"""Guarded sessions: SQL in, a masked DataFrame or a refusal out.

In-process Python can read the files behind a table, so a guarded session is
policy correctness, not a security boundary; put it behind a service to make
it one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from hashlib import sha256
from pathlib import Path
from uuid import uuid4

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Cause, ConfigError, MaskError, PolicyRejection, withheld
from ..functions.keyed import redaction_conf
from ..functions.masks import mask
from ..plans import gates
from ..plans.cache import Shapes, shape_of
from .results import RUNNING, MaskedFrame
from ..plans.flow import SET_OPERATIONS
from ..plans.planner import FieldPlan, Planner
from ..plans.trees import Node, analyzed, identifiers, join_names, parsed
from ..sources.config import Config
from ..sources.tables import GuardedTable, read, register
from ..spec import Mask
from .keys import Keys, discover_keys
from .limits import RateLimiter
from .metrics import ROWS, Metrics, StreamCounter


@dataclass(frozen=True)
class Decided:
    """Decisions on the fields of one shape of statement, and the plain result of the text that they were made on."""

    plans: tuple[FieldPlan, ...]
    types: tuple[str, ...]
    text: str
    frame: DataFrame

    def named(self, frame: DataFrame) -> list[FieldPlan]:
        """The same decisions for a result whose fields have other names."""
        return [p if p.name == f.name else replace(p, name=f.name) for p, f in zip(self.plans, frame.schema.fields, strict=True)]


@dataclass(frozen=True)
class Policy:
    """One generation of the policy; it is swapped whole."""

    config: Config
    generation: int


class GuardedSession:
    """Registers tables under a policy and serves queries over them."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark = spark
        self.tables: dict[str, GuardedTable] = {}
        self.never_null: set[tuple[str, str]] = set()  #: columns that a catalog says are not null
        self.shapes: Shapes[Decided] = Shapes()
        self._counter: StreamCounter | None = None
        self.found_keys: dict[str, Keys] = {}  #: unique keys that were found in the tables' rows
        self.metrics = Metrics()
        self.policy = Policy(config, 1)
        self.limiter = RateLimiter(config.rate_limit_per_minute, config.rate_limit_burst)
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # dates are coarsened in UTC
        for k, v in redaction_conf().items():
            spark.conf.set(k, v)

    # --------------------------------------------------------------- tables
    def add_table(self, name: str, frame: DataFrame, opaque: bool = False) -> None:
        """``opaque``: a view whose columns mix sources; a set operation in its plan makes it so too."""
        opaque = opaque or any(n.kind in SET_OPERATIONS for n in analyzed(frame).walk())
        table = register(frame, name, opaque)
        self.tables[table.name] = table
        self.shapes.clear()

    def read_table(self, name: str, path: str, format: str = "parquet", **options: str) -> None:
        self.add_table(name, read(self.spark, path, format, **options))

    def add_catalog(self, database: str) -> list[str]:
        """Register every table of a database of the session's catalog as database.table; columns that may not be null are remembered."""
        found = sorted(t.name for t in self.spark.catalog.listTables(database) if not t.isTemporary)
        for name in found:
            self.add_table(f"{database}.{name}", self.spark.table(f"`{database}`.`{name}`"))
            told = self.spark.catalog.listColumns(f"`{database}`.`{name}`")
            self.never_null |= {(f"{database}.{name}".lower(), c.name.lower()) for c in told if not c.nullable}
        return [f"{database}.{name}".lower() for name in found]

    def planner(self, config: Config) -> Planner:
        """Plans under ``config``, with what the catalog and the tables say of NULL."""
        told = {(t.name, f.name.lower()) for t in self.tables.values() for f in t.frame.schema if not f.nullable}
        keys = {t: tuple(dict.fromkeys((*config.table_keys.get(t, ()), *self.found_keys.get(t, ())))) for t in self.tables}
        return Planner(replace(config, not_null=config.not_null | self.never_null | told), self.tables, {t: k for t, k in keys.items() if k})

    def discover_keys(self, most_columns: int = 2) -> dict[str, Keys]:
        """Find the keys of all registered tables in their rows; from now on no grouping that pins a row down by them gives a summary of it."""
        self.found_keys = {name: discover_keys(t.frame, most_columns) for name, t in self.tables.items()}
        self.shapes.clear()
        return self.found_keys

    def check_rules(self) -> None:
        """Every rule must name a column of a registered table."""
        known = {(t.name, c) for t in self.tables.values() for c in t.columns}
        if missing := sorted(set(self.policy.config.rules) - known):
            raise ConfigError(f"no such column: {'.'.join(missing[0])}")

    def reload(self, source: Config | str | Path) -> int:
        """Swap the policy; where the new one is wrong the old one stays."""
        config = source if isinstance(source, Config) else Config.load(source)
        self.policy = Policy(config, self.policy.generation + 1)
        self.shapes.clear()
        self.limiter = RateLimiter(config.rate_limit_per_minute, config.rate_limit_burst, self.limiter.clock)
        self.metrics.add("reloads")
        return self.policy.generation

    # -------------------------------------------------------------- queries
    def sql(self, statement: str, principal: str | None = None) -> DataFrame:
        """The masked result, planned under one generation of the policy."""
        return self._served(statement, principal)[0]

    def _served(self, statement: str, principal: str | None) -> tuple[DataFrame, list[FieldPlan]]:
        policy = self.policy
        self.metrics.add("statements")
        try:
            self.limiter.take(principal or "")
            found = self._decide(statement, policy, principal)
            if isinstance(found, DataFrame):
                return found, []
            frame, plans = found
            self.metrics.add("fields", len(plans))
            self.metrics.add("fields_masked", sum(not p.spec.passes for p in plans))
            self.metrics.add("fields_nulled", sum(p.spec.mask is Mask.NULL for p in plans))
            self.metrics.add("rescued", sum(p.why in ("releasable", "lineage") for p in plans))
            out = MaskedFrame.over(apply_plans(frame, plans, policy.config), tags_of(principal))
        except PolicyRejection as e:
            self.metrics.reject(e.cause)
            raise
        self.metrics.add("served")
        return out, plans

    def cancel(self, principal: str | None, frame: DataFrame | None = None) -> int:
        """End the principal's running statements, or only the one that gave ``frame``; the number of actions that were running.

        A statement of somebody else is left alone, whoever holds its frame.
        """
        own = tags_of(principal)[0]
        tags = getattr(frame, "_tags", ()) if frame is not None else (own,)
        if own not in tags:
            return 0
        running = RUNNING[tags[-1]]
        self.spark.sparkContext.cancelJobsWithTag(tags[-1])
        return running

    def _decide(self, statement: str, policy: Policy, principal: str | None, metadata: bool = True) -> tuple[DataFrame, list[FieldPlan]] | DataFrame:
        """A statement's plain result and what to do with its fields; for SHOW and DESCRIBE what they tell."""
        roles = policy.config.roles_of(principal)
        text = join_names(statement, set(self.tables))
        key = (shape_of(text), roles, policy.generation)
        known = self.shapes.get(key)
        if known is not None:
            frame = known.frame if known.text == text else self._analysed(text)
            if known.frame is frame or known.types == _types(frame):
                return frame, known.named(frame)
        tree = parsed(self.spark, text)
        if metadata and gates.is_metadata(tree):
            self.metrics.add("metadata")
            return self._metadata(tree)
        gates.check(tree, set(self.tables), system_catalogs=policy.config.system_catalogs)
        frame = self._analysed(text)
        plans = self.planner(policy.config).plan(frame, roles, identifiers(statement), own_rows=True)
        if policy.generation == self.policy.generation:
            self.shapes.put(key, Decided(tuple(plans), _types(frame), text, frame))
        return frame, plans

    def _analysed(self, text: str) -> DataFrame:
        """The statement's plain result; errors tell nothing of tables or values."""
        try:
            return self.spark.sql(text)
        except PySparkException as e:
            raise withheld(e, "the statement cannot be analysed") from None

    def decisions(self, statement: str, principal: str | None = None) -> list[FieldPlan]:
        """What would be done with each field.  Spark's own plans hold key material and are not shown."""
        policy = self.policy
        self.limiter.take(principal or "")
        return self._decide(statement, policy, principal, metadata=False)[1]

    def collect(self, statement: str, principal: str | None = None) -> list[Row]:
        """Rows of a statement; an error while it runs never quotes values."""
        return self.sql(statement, principal).collect()

    def table(self, name: str, principal: str | None = None) -> DataFrame:
        return self.sql(f"SELECT * FROM `{name.lower()}`", principal)

    def mask_frame(self, frame: DataFrame, principal: str | None = None, words: set[str] | None = None) -> DataFrame:
        """Mask a DataFrame (batch or stream) made from registered tables' views."""
        policy = self.policy
        config = policy.config
        named = {w.lower() for w in frame.columns} if words is None else words
        return MaskedFrame.over(apply_plans(frame, self._planned(frame, policy, config.roles_of(principal), named), config))

    def mask_rows_of(self, name: str, frame: DataFrame, principal: str | None = None, count: bool = False) -> DataFrame:
        """Mask a batch or stream that has the columns of a registered table.

        ``count``: of a stream, add the masked values of each micro-batch to the metrics once it is done.
        """
        policy, table = self.policy, self.tables[name.lower()]
        planner, roles = self.planner(policy.config), policy.config.roles_of(principal)
        fields = {f.name.lower(): f for f in table.frame.schema}
        if unknown := [c for c in frame.columns if c.lower() not in fields]:
            raise PolicyRejection(Cause.OPAQUE_ANONYMOUS, f"{unknown[0]!r} is no column of the table")
        # the table's columns know their logical types, a stream's do not
        typed = [T.StructField(f.name, f.dataType, metadata={**fields[f.name.lower()].metadata, **f.metadata}) for f in frame.schema]
        plans = [planner.known(f, (table.name, f.name.lower()), roles) for f in typed]
        for p, f in zip(plans, typed, strict=True):
            if not p.spec.supports(f):
                raise PolicyRejection(Cause.MASK_TYPE_MISMATCH, f"the mask of {p.name!r} cannot be applied to its type")
        out = apply_plans(frame, plans, policy.config, typed)
        if count and frame.isStreaming:
            out = self._observed(out, plans)
        return MaskedFrame.over(out, tags_of(principal))

    def _observed(self, stream: DataFrame, plans: list[FieldPlan]) -> DataFrame:
        if self._counter is None:
            self._counter = StreamCounter(self.metrics)
            self.spark.streams.addListener(self._counter)
        return stream.observe(f"{StreamCounter.PREFIX}{uuid4().hex}", F.count(F.lit(1)).alias(ROWS), *_masked_counts(plans))

    def counted(self, statement: str, principal: str | None = None) -> tuple[DataFrame, Observation]:
        """The masked result, and how many values of each masked field an action on it gives out (no job of its own)."""
        frame, plans = self._served(statement, principal)
        seen = Observation()
        return frame.observe(seen, F.count(F.lit(1)).alias(ROWS), *_masked_counts(plans)), seen

    def count_values(self, seen: Observation) -> int:
        """Add what a finished action gave out to the metrics."""
        n = sum(v for k, v in seen.get.items() if k != ROWS)
        self.metrics.add("values_masked", n)
        return n

    def _planned(self, frame: DataFrame, policy: Policy, roles: frozenset[str], words: set[str], own_rows: bool = False) -> list[FieldPlan]:
        plans = self.planner(policy.config).plan(frame, roles, words, self.metrics.add, own_rows)
        self.metrics.add("fields", len(plans))
        self.metrics.add("fields_masked", sum(not p.spec.passes for p in plans))
        self.metrics.add("fields_nulled", sum(p.spec.mask is Mask.NULL for p in plans))
        return plans

    def _metadata(self, tree: Node) -> DataFrame:
        """SHOW TABLES, SHOW COLUMNS and DESCRIBE tell of guarded tables only."""
        named = [n for n in tree.walk() if n.kind in ("UnresolvedTableOrView", "UnresolvedTable", "UnresolvedRelation", "UnresolvedIdentifier")]
        parts = named[0].parts("multipartIdentifier" if "multipartIdentifier" in named[0].fields else "nameParts") if named else []
        wanted = ".".join(parts).lower()
        if tree.kind.startswith("ShowTables"):
            return self.spark.createDataFrame([(t,) for t in sorted(self.tables)], "table string")
        if wanted not in self.tables or tree.fields.get("isExtended"):
            raise PolicyRejection(Cause.LEAKY_CATALOG, "only guarded tables are described, without statistics")
        schema = self.tables[wanted].frame.schema
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "column string, type string")


def _masked_counts(plans: list[FieldPlan]) -> list:
    return [F.count(F.col(f"`{p.name}`")).alias(p.name) for p in plans if not p.spec.passes]


def tags_of(principal: str | None) -> tuple[str, str]:
    """Job tags of a principal and of a new statement."""
    who = sha256((principal or "").encode()).hexdigest()[:32]
    return f"principal-{who}", f"statement-{uuid4().hex}"


def _types(frame: DataFrame) -> tuple[str, ...]:
    return tuple(f"{f.dataType.simpleString()}{f.metadata or ''}" for f in frame.schema)


def apply_plans(frame: DataFrame, plans: list[FieldPlan], config: Config, fields: list[T.StructField] | None = None) -> DataFrame:
    """One outermost projection; passed columns stay plain attributes.  ``fields``: the schema with its logical types."""
    places = [f"_{i}" for i in range(len(plans))]  # names may repeat in a result
    named = frame.toDF(*places) if len(set(frame.columns)) < len(plans) else frame
    names = places if named is not frame else frame.columns
    cols = []
    for p, f, place in zip(plans, fields or frame.schema.fields, names, strict=True):
        c = F.col(f"`{place}`")
        bare = T.StructField(f.name, f.dataType, metadata=f.metadata)
        try:
            cols.append(c.alias(p.name) if p.spec.passes and place != p.name else c if p.spec.passes else mask(c, p.spec, bare, config.key, p.lenient, p.projection, config.digests == "batches").alias(p.name, metadata={}))
        except MaskError as e:
            raise PolicyRejection(Cause.MASK_TYPE_MISMATCH, str(e)) from None
    return named.select(*cols)
