"""Periodic runs of words: maximal stretches that repeat with a smallest period.

A run is a stretch with smallest period q (words q apart are equal), at least
twice as long as q, that no neighbouring word extends.  By the runs theorem
each run has, under an order of the words or under its reverse, a Lyndon root
that is the longest Lyndon word at its own start.  So for both orders

1. the suffixes are sorted (prefix doubling; only groups that are still tied
   are sorted again), which gives the inverse suffix array;
2. the longest Lyndon word at i ends at the next smaller value of it;
3. each Lyndon word [i, j) is extended to the right by the longest common
   prefix of the suffixes i and j and to the left by that of the reversed text,
   both range minima over LCP arrays: a sparse table over blocks, and running minima
   inside them.  What is then long enough is a run, found once or more; each is
   kept once.

All texts of a block are one sequence for the sorting: a word of one text never
equals one of another, and the texts stand in an order in which the end of a text is less
than all its words.

Scale: one pass over the documents, no shuffle, no state; a copied or periodic text costs
what any other does (suffixes of one text are tied with their own text only).  A
task's memory follows the blocks (2 MB of text), or the longest text: about
250 bytes a word.

Defined results: null and empty texts have no words and no runs; ties of equal length
are runs of their own, in order of start, then period; repeated rows and null
doc_ids are rows of their own; very long texts are worked on whole; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_blocks, words_of

#: Words by which neighbouring suffixes are compared at once, before the rest goes one by one.
AT_ONCE = 16
#: Values in a block of the range minima.
BLOCK = 16

Order = Callable[["int | None", int], "np.ndarray | None"]


def inverse_suffix_array(s: np.ndarray) -> np.ndarray:
    """The rank of each suffix of ``s``; a suffix that begins another is the smaller."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = _ranked(order, s[order], np.zeros(n, np.int64), np.empty(n, np.int64))
    tied, k = _still_tied(order, s[order]), 1
    while len(tied):
        behind = np.full(len(tied), -1, np.int64)
        inside = tied + k < n
        behind[inside] = rank[tied[inside] + k]
        key = rank[tied] * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        rank = _ranked(tied, key, rank[tied], rank)
        tied, k = _still_tied(tied, key), 2 * k
    return rank


def _ranked(at: np.ndarray, key: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``rank`` after the members ``at`` of some groups (by least rank) were sorted by ``key``."""
    if not len(at):
        return rank
    place = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, place, 0))
    equal = np.maximum.accumulate(np.where(np.diff(key, prepend=key[0] - 1) != 0, place, 0))
    rank[at] = group + equal - first
    return rank


def _still_tied(at: np.ndarray, key: np.ndarray) -> np.ndarray:
    same = key[1:] == key[:-1]
    return at[np.append(same, False) | np.insert(same, 0, False)] if len(at) else at


def common_prefixes(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: words that the suffixes of rank r - 1 and r have in common."""
    n = len(s)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    padded = np.append(s, np.full(AT_ONCE + 1, -1, s.dtype))
    open_ = np.arange(1, n)
    for k in range(AT_ONCE):
        open_ = open_[padded[suffixes[open_] + k] == padded[suffixes[open_ - 1] + k]]
        lcp[open_] = k + 1
    # long ones in order of text: the next suffix has at most one word less in common
    later = np.sort(suffixes[open_])
    before = suffixes[rank[later] - 1].tolist()
    words, found, last, h = padded.tolist(), [], -2, 0
    for i, j in zip(later.tolist(), before, strict=True):
        h = max(h - 1, AT_ONCE) if i == last + 1 else AT_ONCE
        while words[i + h] == words[j + h]:
            h += 1
            if i + h >= n or j + h >= n:
                break
        found.append(h)
        last = i
    lcp[rank[later]] = found
    return lcp


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place, the first one behind it with a smaller value; their number where there is none."""
    values = values.tolist()
    out, open_ = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


class RangeMinimum:
    """Minima of values[a..b]: a sparse table over block minima, running minima inside the blocks."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.values = values
        whole = np.full(-(-max(n, 1) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        whole[:n] = values
        blocks = whole.reshape(-1, BLOCK)
        self.up_to = np.minimum.accumulate(blocks, 1).ravel()
        self.from_ = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [blocks.min(1)]
        while 2 * (1 << len(self.table) - 1) <= len(self.table[0]):
            t, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(t[:-half], t[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self.from_[a], self.up_to[b])
        near = np.flatnonzero(x == y)
        if len(near):
            left, right = a[near], b[near]
            least = self.values[left]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(left + k, right)])
            out[near] = least
        far = np.flatnonzero(y - x > 1)
        if len(far):
            left, right = x[far] + 1, y[far] - 1
            level = np.frexp(right - left + 1)[1] - 1
            for k in np.unique(level).tolist():
                own = level == k
                t = self.table[k]
                out[far[own]] = np.minimum(out[far[own]], np.minimum(t[left[own]], t[right[own] - (1 << k) + 1]))
        return out


class _Common:
    """Longest common prefixes of any two suffixes."""

    def __init__(self, s: np.ndarray, rank: np.ndarray) -> None:
        self.rank, self.least = rank, RangeMinimum(common_prefixes(s, rank))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b)) if len(i) else np.zeros(0, np.int64)


def runs_of(word: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least ``least`` words, by start, then period.

    word: numbers of the words; text: the number of the text of each, ascending.
    """
    n = len(word)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    different = int(word.max()) + 1
    block = (int(text[-1]) - text) * different
    up, down = block + word, block + different - 1 - word
    rank = inverse_suffix_array(up)
    right = _Common(up, rank)
    back = up[::-1].copy()
    left = _Common(back, inverse_suffix_array(back))
    found = []
    for order in (rank, inverse_suffix_array(down)):
        i = np.arange(n)
        j = next_smaller(order)
        more = np.zeros(n, np.int64)
        at = np.flatnonzero(j < n)
        at = at[up[at] == up[j[at]]]
        more[at] = right(at, j[at])
        less = np.zeros(n, np.int64)
        at = np.flatnonzero(i > 0)
        at = at[up[at - 1] == up[j[at] - 1]]
        less[at] = left(n - at, n - j[at])
        period, length = j - i, j + more - i + less
        yes = length >= np.maximum(least, 2 * period)
        found.append(np.stack([(i - less)[yes], (j + more)[yes], period[yes]], 1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Periods planted in a tenth of the documents: which word stands at each place (null ids: none)."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _find(least: int, order: Order | None):
    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(batch.column("text"))
        raw = w.data.tobytes()
        ids = batch.column("doc_id").to_pylist()
        at, turned = np.arange(len(w.start)), set()
        if order is not None:
            for i, doc_id in enumerate(ids):
                a, b = int(w.first[i]), int(w.first[i + 1])
                moved = order(doc_id, b - a)
                if moved is not None:
                    at[a:b] = a + moved
                    turned.add(i)
        # words are numbered by their bytes
        ends = np.cumsum(w.end - w.start)
        ink = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(ink, w.start, 1)
        np.add.at(ink, w.end, -1)
        packed = w.data[np.cumsum(ink[:-1]).astype(bool)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes()), pa.py_buffer(packed.tobytes())])
        number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[at] if len(at) else np.zeros(0, np.int64)
        runs = runs_of(number, w.doc(), least)
        text = np.searchsorted(w.first, runs[:, 0], side="right") - 1
        step = np.zeros(len(at) + 1, np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 1], -1)
        gone = np.cumsum(step)[:-1] > 0
        dropped = np.diff(np.append(0, np.cumsum(gone))[w.first])
        collapsed = []
        for i in range(batch.num_rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            own = raw[int(w.offsets[i]) : int(w.offsets[i + 1])].split()
            if i in turned:
                own = [own[k] for k in (at[a:b] - a).tolist()]
            if dropped[i]:
                own = compress(own, (~gone[a:b]).tolist())
            collapsed.append(b" ".join(own))
        lists = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        parts = [runs[:, 0] - w.first[text], runs[:, 1] - runs[:, 0], runs[:, 2]]
        structs = pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], ["start", "length", "period"])
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "n_words": pa.array(w.counts),
            "runs": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), structs),
            "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_blocks(batch):
                yield block(part)

    return run


@dataclass(frozen=True)
class PeriodicRuns:
    """Runs of at least ``least`` words."""

    least: int = 12

    def run(self, docs: DataFrame, order: Order | None = None) -> DataFrame:
        """Per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

        collapsed: the words joined by one space, less those that any run holds after its first period.
        order: which word of a document stands at each place, by doc_id and number of words, where that
        is not as the text has it.
        """
        read = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return read.mapInArrow(_find(self.least, order), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def report(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: least start, then period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n"))))
    found = runs.select("doc_id", "runs", "collapsed", best.alias("best"))
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.short")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
