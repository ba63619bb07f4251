"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target number of words: its weight's part of the budget,
never more than ``cap`` times what it has, the excess going to the other
sources by weight.  Each source's documents are put in a hashed order; a copy
of a document finishes at the virtual time

    (words of its source before and with it, over all passes) / target

and the mix is the global order by finish time, cut where the words reach the
total budget.  At time 1 every source has given just its target, so the cut
falls there.

Scale: the texts are read once, for their sizes; only (doc_id, source, size) is shuffled.  Running sums
are two-level: sums of hash chunks, then rows within a chunk, so a source that
holds a third of all rows is spread over chunks whose number follows the rows (about
``CHUNK_ROWS`` each).  The global order is cut
the same way over fixed buckets of virtual time.

Defined results: null text has size 0; a null source is a source of its own,
last in order; very long texts count whole, and the one that would go over the budget is left out;
ties in finish time go by source, hashed key, doc_id and size; repeated rows (equal in doc_id, source and size) share one fate; a null
doc_id takes part; an empty table gives an empty mix.  Other columns are never
read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise

#: Buckets per unit of virtual time, and the time from which all is cut.
TICKS, LAST = 4096, 2
#: Rows in a chunk of a source that holds all rows.
CHUNK_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class SourceMixer:
    """``weights`` repeat over the sources in code-point order."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: int = 2
    seed: str = "17"

    def targets(self, units: DataFrame) -> DataFrame:
        """Per source: skey, source_size, target.  One row per source is small."""
        sizes = units.groupBy("skey").agg(F.sum("tokens").alias("source_size"))
        everyone = W.partitionBy(F.lit(0))
        weight = F.element_at(F.array(*map(F.lit, self.weights)), (F.col("rank") % len(self.weights) + 1).cast("int"))
        ranked = (
            sizes.withColumn("rank", F.row_number().over(everyone.orderBy(F.col("skey").startswith("n"), "skey")) - 1)
            .withColumn("weight", weight)
            .withColumn("most", F.col("source_size") * self.cap)
        )
        by_fill = everyone.orderBy(F.col("most") / F.col("weight"), "skey")
        level = (
            ranked.withColumn("budget", F.sum("source_size").over(everyone) * self.share)
            .withColumn("full", F.coalesce(F.sum("most").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("rest", F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        )
        # filling sources in this order, the first one that its cap doesn't stop fixes the level of all after it
        free = level.withColumn("open", F.col("weight") * (F.col("budget") - F.col("full")) / F.col("rest") <= F.col("most"))
        first = lambda c: F.min(F.when(F.col("open"), F.col(c))).over(everyone)
        share = F.col("weight") * (F.col("budget") - first("full")) / F.max(F.when(F.col("open"), F.col("rest"))).over(everyone)
        return free.select("skey", "source_size", F.when(F.col("open"), share).otherwise(F.col("most")).cast("double").alias("target"))

    def decide(self, docs: DataFrame) -> DataFrame:
        """One row per distinct (doc_id, source, size): how many copies the mix takes.

        Columns: doc_id, source, size, rows, source_size, target, copies.
        """
        return self.placed(self.measured(docs))

    def measured(self, docs: DataFrame) -> DataFrame:
        """doc_id, source, size of each row, as a table in the shared folder: the texts are read once."""
        return materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")

    def placed(self, sizes: DataFrame) -> DataFrame:
        skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
        units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
        digits = min(8, max(2, len(f"{max(sizes.count(), 1) // CHUNK_ROWS:x}")))  # of the key, so that a chunk stays small
        units = (
            units.withColumn("skey", skey)
            .withColumn("tokens", F.col("size") * F.col("rows"))
            .withColumn("key", F.md5(F.concat(F.lit(self.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
            .withColumn("chunk", F.substring("key", 1, digits))
        )
        targets = materialise(self.targets(units), "targets")  # one row a source
        chunks = units.groupBy("skey", "chunk").agg(F.sum("tokens").alias("in_chunk"))
        before = W.partitionBy("skey").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        chunks = chunks.withColumn("before", F.coalesce(F.sum("in_chunk").over(before), F.lit(0))).join(targets, "skey")
        inside = W.partitionBy("skey", "chunk").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
        placed = units.join(chunks, ["skey", "chunk"]).withColumn("upto", F.col("before") + F.sum("tokens").over(inside))

        passes = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(self.cap) - 1))).alias("pass")
        copies = placed.select("*", passes).filter(F.col("target") > 0)
        copies = copies.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target"))
        copies = copies.withColumn("tick", F.least(F.floor(F.col("finish") * TICKS), F.lit(TICKS * LAST)).cast("int"))
        # at most TICKS * LAST + 1 rows, whatever the input
        ticks = copies.groupBy("tick").agg(F.sum("tokens").alias("in_tick"))
        upto_tick = W.partitionBy(F.lit(0)).orderBy("tick").rowsBetween(W.unboundedPreceding, -1)
        ticks = ticks.withColumn("tick_before", F.coalesce(F.sum("in_tick").over(upto_tick), F.lit(0)))
        total = targets.agg(F.sum("target").alias("budget"))
        ticks = ticks.crossJoin(F.broadcast(total))  # one row
        ticks = ticks.filter(F.col("tick_before") <= F.col("budget"))
        in_order = W.partitionBy("tick").orderBy("finish", "skey", "key", F.col("doc_id").asc_nulls_first(), "size", "pass").rowsBetween(W.unboundedPreceding, 0)
        taken = (
            copies.join(F.broadcast(ticks), "tick")
            .withColumn("cum", F.col("tick_before") + F.sum("tokens").over(in_order))
            .filter(F.col("cum") <= F.col("budget"))
            .groupBy("skey", "chunk", "doc_id", "size")
            .agg(F.count(F.lit(1)).alias("copies"))
        )
        same = (F.col("p.skey") == F.col("t.skey")) & (F.col("p.chunk") == F.col("t.chunk")) & F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.size") == F.col("t.size"))
        return placed.alias("p").join(taken.alias("t"), same, "left").select(
            "p.doc_id", "p.source", "p.size", "p.rows", "p.source_size", "p.target", F.coalesce("t.copies", F.lit(0)).alias("copies")
        )

    def report(self, docs: DataFrame) -> DataFrame:
        """One row per input row: doc_id, size, source_size, target, taken."""
        each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
        return self.decide(docs).withColumn("row", each).select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
        )

    def mix(self, docs: DataFrame) -> DataFrame:
        """The documents of the mix, with all their columns, repeated where taken twice."""
        plan = self.decide(docs).filter("copies > 0").select("doc_id", "source", "size", "copies")
        # the columns travel in one struct, whatever they are called
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        rows = docs.select(own, F.col("doc_id").alias("d"), F.col("source").alias("s"), word_count(F.col("text")).alias("n"))
        same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
        chosen = rows.join(plan.hint("shuffle_hash"), same)
        copies = chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        return copies.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: The same mix in DuckDB, for the registered query's default parameters.
SQL = r"""
WITH u AS (
  SELECT doc_id, source, size, count(*) AS n, size * count(*) AS tokens,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)
  GROUP BY doc_id, source, size
), s AS (
  SELECT skey, sum(tokens)::BIGINT AS source_size FROM u GROUP BY skey
), r AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY skey[1:1] = 'n', skey) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS most FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget,
         coalesce(sum(most) OVER (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_,
         (sum(weight) OVER (ORDER BY most / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM r
), o AS (
  SELECT *, weight * (budget - full_) / rest <= most AS open FROM l
), t AS (
  SELECT skey, source_size, CASE WHEN open THEN weight * (budget - (min(full_) FILTER (open) OVER ())) / (max(rest) FILTER (open) OVER ()) ELSE most END::DOUBLE AS target FROM o
), p AS (
  SELECT u.*, source_size, target, (sum(tokens) OVER (PARTITION BY u.skey ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM u JOIN t USING (skey)
), c AS (
  SELECT p.*, pass, (pass * source_size + upto)::DOUBLE / target AS finish FROM p, (VALUES (0), (1)) v(pass) WHERE target > 0
), g AS (
  SELECT *, (sum(tokens) OVER (ORDER BY finish, skey, k, doc_id NULLS FIRST, size, pass ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM c
), k AS (
  SELECT skey, doc_id, size, count(*) AS copies FROM g WHERE cum <= (SELECT sum(target ORDER BY skey) FROM t) GROUP BY skey, doc_id, size
)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(k.copies, 0))::BIGINT AS taken
FROM (SELECT *, unnest(range(n)) FROM p) p LEFT JOIN k ON p.skey = k.skey AND p.size = k.size AND p.doc_id IS NOT DISTINCT FROM k.doc_id
"""
