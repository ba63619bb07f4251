"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``window`` ids.  Bins are planned on
the histogram of piece lengths, which has at most ``window`` rows however
large the corpus is: for each bin the longest length left is taken, a bitset
subset-sum dynamic program over the lengths still available finds the fullest
combination that fits beside it, and that combination is removed as often as
the counts allow.  A planned combination is a recipe; the k-th piece of a
length then knows its bin and offset by a search in the recipes' rank
intervals, so no bin is ever gathered in one task.

Scale: tokenising is one pass with no shuffle of text.  Ranks within a length
are two-level (hash chunks, then rows in a chunk), so a length that a third of
the pieces share is spread.

Defined results: null text is an empty text, packed as its end id alone; texts
longer than a window, and only these, are cut into whole windows and a rest;
ties within a length go by doc_id, piece and checksum;
repeated rows are packed each; null doc_ids are kept; an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, materialise, text_blocks, word_hashes, words_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of texts, word by word, for a block of texts at once.

    A tokenizer that lower-cases and whose pre-tokenizer never joins across
    white space gives a text the ids of its words in turn.  So words (ASCII
    capitals made small, unless a text may hold special tokens) are hashed in
    numpy, looked up in a sorted table of hashes, and only new ones are
    encoded; the ids of a block are one gather.  The table is emptied when it
    has ``most`` words (some 30 bytes each): memory is bounded and the ids are
    the same.

    Where the model marks word ends, words of letters only (and the marks
    behind them) need no splitting rules: they go through the same model and
    normalizer as one string parted by blanks.  All others take the tokenizer
    as it is.
    """

    MARKS = b".,!?;:*$%&#|"

    def __init__(self, path: str, most: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.marks: dict[bytes, bytes] = {}
        self.quick = None
        self._empty()
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        steps = [n for n in (spec["normalizer"] or {}).get("normalizers", []) if n["type"] != "Replace"]
        if suffix and [n["type"] for n in steps] == ["NFC", "Lowercase"]:
            blanks = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            quick = spec | {"normalizer": {"type": "Sequence", "normalizers": steps}, "pre_tokenizer": blanks, "added_tokens": [], "post_processor": None}
            self.quick = Tokenizer.from_str(json.dumps(quick))
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _empty(self) -> None:
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def _slow(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words; whole lists are worked on at once, not word by word."""
        if self.quick is None or not words:
            return list(map(self._slow, words))
        cores = [w.rstrip(self.MARKS) for w in words]
        texts = b"\n".join(cores).decode("utf-8", "replace").split("\n")
        lower = "\n".join(texts).lower().split("\n")
        plain = [a and b for a, b in zip(map(str.isalpha, texts), map(str.isalpha, lower), strict=True)]
        todo = {c: t for c, t, p in zip(cores, texts, plain, strict=True) if p}
        keys, strings, known = list(todo), list(todo.values()), {}
        for a in range(0, len(keys), 4096):
            ids = np.array(self.quick.encode_batch_fast([" ".join(strings[a : a + 4096])], add_special_tokens=False)[0].ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            known.update(zip(keys[a : a + 4096], (raw[p:q] for p, q in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))
        if len(self.marks) > 10_000:
            self.marks.clear()
        out = []
        for w, c, p in zip(words, cores, plain, strict=True):
            if not p:
                out.append(self._slow(w))
            elif len(w) > len(c):
                mark = w[len(c) :]
                out.append(known[c] + (self.marks.get(mark) or self.marks.setdefault(mark, self._slow(mark))))
            else:
                out.append(known[c])
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """hashes: sorted, none in the table."""
        ids = self.encode(words)
        length = np.array([len(x) for x in ids], np.int64) // 4
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.start = np.insert(self.start, at, len(self.pool) + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])

    def __call__(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow array, as little-endian 32-bit bytes."""
        w = words_of(texts)
        data = _SMALL[w.data]
        raw = w.data.tobytes()
        at = raw.find(b"<|")
        while at >= 0:  # rare: these texts keep their capitals
            k = int(np.searchsorted(w.offsets, at, side="right")) - 1
            a, b = int(w.offsets[k]), int(w.offsets[k + 1])
            data[a:b] = w.data[a:b]
            at = raw.find(b"<|", b)
        h, first, where = np.unique(word_hashes(w, data), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._empty()
        at = np.searchsorted(self.keys, h)
        new = np.ones(len(h), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != h
        if new.any():
            raw = data.tobytes()
            spans = zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)
            self._learn(h[new], [raw[a:b] for a, b in spans])
            at = np.searchsorted(self.keys, h)
        length = self.length[at][where]
        ends = np.zeros(len(where) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        out = self.pool[np.arange(ends[-1]) + np.repeat(self.start[at][where] - ends[:-1], length)].tobytes()
        cuts = (ends[w.first] * 4).tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32

#: One per Python worker and tokenizer, so that tasks of a worker share a table.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str, most: int) -> WordEncoder:
    if path not in _ENCODERS or _ENCODERS[path].most != most:
        _ENCODERS[path] = WordEncoder(path, most)
    return _ENCODERS[path]


def _tokenise(path: str, window: int, end: int, with_ids: bool, most: int):
    tail = np.array([end], "<u4").tobytes()
    step = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder_for(path, most)
        for batch in batches:
            for block in text_blocks(batch):
                rows: list[tuple] = []
                for doc, ids in zip(block.column("doc_id").to_pylist(), encode(block.column("text")), strict=True):
                    ids += tail
                    for k, a in enumerate(range(0, len(ids), step)):
                        part = ids[a : a + step]
                        rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows, strict=True))
                out = [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    ids = np.frombuffer(b"".join(cols[5]), "<u4").astype(np.int32)
                    out.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32), ids))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def fullest(space: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``space``.

    Bit i of a bitset says that sum i can be reached.  Lengths come in falling
    order and counts are split into powers of two; the sets before each step
    are kept to read the combination back.
    """
    full = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left = min(counts[length], space // length) if length <= space else 0
        size = 1
        while left > 0:
            take = min(size, left)
            grown = reach | (reach << take * length) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            size *= 2
        if reach >> space & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def plan_bins(histogram: dict[int, int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Recipes (number of bins, [(length, pieces a bin)]) that use up the histogram.

    A recipe is repeated while the counts allow, so there are few recipes
    however many pieces there are.
    """
    counts = {k: v for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    recipes = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        chosen = fullest(window - longest, lengths, counts)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in chosen.items())
        recipes.append((times, sorted(chosen.items(), reverse=True)))
        for k, m in chosen.items():
            counts[k] -= times * m
        lengths = [k for k in lengths if counts[k]]
    return recipes


def _intervals(recipes) -> dict[str, np.ndarray]:
    """For each (length, first rank): the recipe's first bin, pieces a bin, offset in the bin."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, items in recipes:
        offset = 0
        for length, m in items:
            rank = used.get(length, 0)
            rows.append((length << 40 | rank, rank, base, m, offset))
            used[length] = rank + times * m
            offset += m * length
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("key", "rank", "base", "per", "offset"), cols, strict=True))


def _place(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(table["key"], length << 40 | rank, side="right") - 1
            within = rank - table["rank"][at]
            per = table["per"][at]
            cols = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "rank"]
            names = [name for name in batch.schema.names if name != "rank"]
            cols += [pa.array(table["base"][at] + within // per), pa.array(table["offset"][at] + within % per * length)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    return run


@dataclass(frozen=True)
class Packer:
    """``table_words``: words a Python worker remembers (about 30 bytes a word)."""

    tokenizer: str
    window: int = 2048
    end: int = 0
    rows_per_chunk: int = 2_000
    table_words: int = 2_000_000

    def pieces(self, docs: DataFrame, with_ids: bool = False) -> DataFrame:
        schema = PIECES + (", ids array<int>" if with_ids else "")
        return bound_batches(docs).select("doc_id", "text").mapInArrow(_tokenise(self.tokenizer, self.window, self.end, with_ids, self.table_words), schema)

    def pack(self, docs: DataFrame, with_ids: bool = False) -> DataFrame:
        """Pieces with sequence_id and offset; ``with_ids`` adds the token ids."""
        pieces = materialise(self.pieces(docs, with_ids), "pieces")
        # at most ``window`` rows
        histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
        table = _intervals(plan_bins(histogram, self.window))
        chunks = max(1, min(1 << 16, sum(histogram.values()) // self.rows_per_chunk))
        pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
        counts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
        before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        inside = W.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
        ranked = pieces.join(counts, ["length", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
        names = [f.name for f in pieces.schema if f.name != "chunk"]
        schema = PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
        return ranked.select(*names, "rank").mapInArrow(_place(table), schema)
