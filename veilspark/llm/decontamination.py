"""Benchmark decontamination, in DataFrame expressions only.

Words are lower-cased (A-Z) runs of digits, letters and all that is not ASCII.
A window of an item is ``window`` (10) consecutive words of it, or all its
words where it has fewer.  A document word inside any occurrence of a window is
hit.

1. The windows of all items become a hash set: a 64-bit key, the words, the
   items that have them.  The bytes that this set can take are computed from
   the benchmark first; up to ``broadcast_bytes`` it is broadcast.
2. Each text is cut into words once, each word hashed once, and its windows are
   scanned: one generated row a start and a length, whose key is looked up in
   the set.  Only a start whose key is found is verified, word by word.
3. Hits are gathered by row and merged into the words that they cover.

Scale: the scan reads each document once and moves no text; what is shuffled is
one short row a document and one a hit, dealt by row, so that a window that a
third of all documents hold is spread.  Only the lengths that items have are
scanned (ten at most).  Beyond ``broadcast_bytes`` the windows of documents and
items are joined by a shuffle on the key, which adaptive execution splits where
a key is hot.  A task holds the words of one text, about ten times its bytes.

Defined results: null and empty texts have no words and no hits; an item
without words has no windows; an item with a null id has windows that hit, but
no name to list; items with the same id are one item; ties do not arise, as hits
are sets; repeated documents and null doc_ids are rows of their own; very long
texts are scanned whole; an empty benchmark hits nothing, an empty table gives no
rows; other columns are never read by ``report`` and come back as they were from
``clean``, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words, once A-Z are made small.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
APART_ANY_CASE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words_in(text: Column) -> Column:
    """The words of a text as an array of strings; null counts as empty."""
    small = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.split(small, APART, -1)


def _trimmed(parts: Column) -> Column:
    """``parts`` without the empty strings that a split leaves at both ends."""
    head = (F.get(parts, F.lit(0)) == "").cast("int")
    tail = (F.get(parts, F.size(parts) - 1) == "").cast("int")
    return F.slice(parts, head + 1, F.greatest(F.size(parts) - head - tail, F.lit(0)))


def _worded(df: DataFrame, *others: str) -> DataFrame:
    """``others`` (item_id by default) and ``words`` of ``df``'s text."""
    keep = others or ("item_id",)
    return df.select(*keep, words_in(F.col("text")).alias("parts")).select(*keep, _trimmed(F.col("parts")).alias("words"))


@dataclass(frozen=True)
class Decontaminator:
    """Words in a window, and the most bytes that a broadcast set may take."""

    window: int = 10
    broadcast_bytes: int = 64 << 20

    def windows(self, benchmark: DataFrame) -> tuple[DataFrame, list[int], int]:
        """Rows (item_id, gram) of all windows, the lengths that occur, and a bound of the set's bytes."""
        items = _worded(benchmark.select(F.col("item_id"), F.col("text"))).select("item_id", "words", F.size("words").alias("n")).where("n > 0")
        span = F.least(F.col("n"), F.lit(self.window))
        # a window keeps each of its words again: at most ``window`` copies of every word and an entry's overhead
        cost = F.sum(self.window * F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16) + 96 * F.col("n"))
        said = items.agg(F.sort_array(F.collect_set(span)).alias("lengths"), F.coalesce(cost, F.lit(0)).alias("cost")).first()
        starts = F.explode(F.sequence(F.lit(1), F.col("n") - span + 1)).alias("at")
        grams = items.select("item_id", "words", span.alias("span"), starts).select("item_id", F.slice("words", F.col("at"), F.col("span")).alias("gram"))
        return grams, said.lengths or [self.window], said.cost

    def _lookup(self, benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
        """(wanted, gram, items): the set of windows, marked for broadcast where its size allows."""
        grams, lengths, cost = self.windows(benchmark)
        key = F.xxhash64(F.transform("gram", lambda w: F.xxhash64(w))).alias("wanted")
        if cost <= self.broadcast_bytes:
            return F.broadcast(grams.groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(key, "gram", "items")), lengths
        # one row an item: no item list of a common window is gathered in one task
        one = F.when(F.col("item_id").isNull(), F.array().cast(f"array<{grams.schema['item_id'].dataType.simpleString()}>")).otherwise(F.array("item_id"))
        return grams.distinct().select(key, "gram", one.alias("items")), lengths

    def hits(self, docs: DataFrame, benchmark: DataFrame, carry: bool = False) -> DataFrame:
        """Per document row: at (its number), doc_id, n_words, hits (start and length, by start), items; with ``carry`` also ``row``."""
        lookup, lengths = self._lookup(benchmark)
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.lit(None).alias("row")
        read = _worded(docs.select("doc_id", "text", whole), "doc_id", "row")
        read = read.select(F.monotonically_increasing_id().alias("number"), "doc_id", "row", "words", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
        # start 0 stands for the document itself, so that one without hits has a row too
        seen = read.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - min(lengths) + 1, F.lit(0)))).alias("start"))
        if len(lengths) > 1:
            length = F.explode(F.when(F.col("start") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, lengths)))).alias("length")
            seen = seen.select("*", length).where("start = 0 OR start + length - 1 <= n")
        else:
            seen = seen.select("*", F.when(F.col("start") == 0, 0).otherwise(lengths[0]).alias("length"))
        scanned = seen.select(
            "number", "doc_id", F.col("n").cast("long").alias("n_words"), F.when(F.col("start") == 0, F.col("row")).alias("row"), "start", "length",
            F.slice("words", F.greatest("start", F.lit(1)), F.col("length")).alias("said"),
            F.when(F.col("start") == 0, F.xxhash64("number")).otherwise(F.xxhash64(F.slice("codes", F.greatest("start", F.lit(1)), F.col("length")))).alias("key"),
        )
        found = scanned.join(lookup, (scanned["key"] == lookup["wanted"]) & (scanned["start"] > 0) & (scanned["said"] == lookup["gram"]), "left")
        kept = found.where((F.col("start") == 0) | F.col("gram").isNotNull())
        place = F.when(F.col("start") > 0, F.struct((F.col("start") - 1).alias("start"), F.col("length").alias("length")))
        return kept.groupBy("number", "doc_id", "n_words").agg(
            F.array_sort(F.collect_set(place)).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("start") > 0, F.col("items")))))).alias("items"),
            F.first("row", ignorenulls=True).alias("row"),
        )

    def report(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """Per document: doc_id, n_words, n_hit, items (ids whose windows occur), spans (merged: start word, length)."""
        found = self.hits(docs, benchmark)
        return found.select("doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), "items", spans(F.col("hits")).alias("spans"))

    def clean(self, docs: DataFrame, benchmark: DataFrame, remove: str = "spans") -> DataFrame:
        """``docs`` without what is hit: the words (``remove="spans"``), or whole documents (``"documents"``).

        A text without hits stays as it is, byte by byte.  A word goes with what stands before it; what
        stands behind the last word stays.  A text that is all hits is left with what stands behind it.
        """
        if remove not in ("spans", "documents"):
            raise ValueError(f"remove: spans or documents, not {remove!r}")
        found = self.hits(docs, benchmark, carry=True)
        if remove == "documents":
            return found.where(F.size("hits") == 0).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
        gone = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))
        left = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), gone)
        text = F.when(F.size("hits") == 0, F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("pieces"), i)), ""))
        pieces = F.regexp_extract_all(F.col("row.text"), F.lit(f"[{APART_ANY_CASE}]*[^{APART_ANY_CASE}]+|[{APART_ANY_CASE}]+$"), F.lit(0))
        cut = found.withColumn("pieces", pieces).select(text.alias("text"), "row")
        return cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def covered(hits: Column) -> Column:
    """Words under hits that are sorted by start."""
    end = lambda h: h["start"] + h["length"]
    first = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))
    step = lambda a, h: F.struct(F.greatest(a["end"], end(h)).alias("end"), (a["words"] + F.greatest(end(h) - F.greatest(a["end"], h["start"]), F.lit(0))).alias("words"))
    return F.aggregate(hits, first, step, lambda a: a["words"])


def spans(hits: Column) -> Column:
    """The same words as disjoint spans that do not touch: a head is a word without a hit word before it, a tail one without any behind."""
    words = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    heads = F.array_sort(F.array_except(words, F.transform(words, lambda w: w + 1)))
    tails = F.array_sort(F.array_except(words, F.transform(words, lambda w: w - 1)))
    return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
