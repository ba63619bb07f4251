"""Cross-tokenizer alignment: which tokens of A stand for which tokens of B.

A text is encoded by both tokenizers; where a token of A and one of B end at the
same byte the text is cut, so each piece is a group of some A and some B
tokens.  Tokens that end together are linked.  No token is empty, so a group
links its last A token with its last B token, and these only.

1. Encoding.  A block of texts (``BLOCK_BYTES``) is cut at single spaces
   before something visible, where neither tokenizer ever joins; each distinct stretch is encoded once, and its groups
   are interned by their ids, byte by byte.  Documents (their stretches by
   number), the block's stretches (their groups by number) and its groups with
   frequencies are written to the shared folder once.
2. Group dictionary.  Groups go to a bucket by hash; there a distinct group is
   interned once, its links are expanded once and multiplied by its frequency in all
   blocks.  Sums over buckets give the count of each linked pair, and the
   highest count of each B id.
3. Back.  A bucket gets the figures of its own pairs, answers each block for the
   groups that it sent, in the order sent, and a block sums over its documents.

Scale: text is read once and never shuffled; what moves is four bytes a stretch
and, once a block, each distinct group.  A group or pair that a third of all
tokens belong to moves once a block, and a pair once a bucket.  A B id has no
more pairs than A has ids.  A task holds one block of texts or the longest text, and one
bucket of groups.

Defined results: null and empty texts, and texts that the tokens of A or of B do not
give back byte by byte (compared stretch by stretch), have no tokens: zeros and the digest column ''; ties for the
highest count are all highest; repeated rows and null doc_ids are rows of their
own; very long texts are encoded whole; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, bound_batches, bucket_cuts, cells_for, joined, materialise, mix, pack, power_of_two, text_blocks, word_hashes

BLOCK_BYTES = 4 << 20
#: Distinct stretches handed to the tokenizers at once.
AT_ONCE = 4096
DOCUMENT, STRETCHES, GROUPS = 0, 1, 2

_BLOCKS = "kind int, block long, bucket long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, parts binary, sizes binary, freq binary"

#: Bytes that begin something visible, whatever follows: printable ASCII and leads without any white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


def byte_level() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary: printable ones stand for themselves, the others for 256 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """The bytes of each id in one buffer."""

    def __init__(self, tokens: list[bytes]) -> None:
        if b"" in tokens:
            raise ValueError("a token is empty")
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        return self.bytes[at + np.arange(len(at))]


class Encoders:
    """Both tokenizers, in a worker."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_level()
        entries = self.a.get_vocab()
        tokens = [b"?"] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            tokens[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        self.a_words = Vocabulary(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_words = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        #: whether B never joins over a space: no piece has one behind anything else
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for k in range(0, len(texts), AT_ONCE) for e in self.a.encode_batch_fast([" " + t for t in texts[k : k + AT_ONCE]], add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1) if texts else []


def stretches(data: np.ndarray, offsets: np.ndarray, cut: bool) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Stretches of all texts and, for each text, how many end before it (one more at the end).

    A stretch begins with the text or behind a single space; empty texts have none.
    """
    split = np.zeros(len(data) + 1, bool)
    if cut and len(data) > 2:
        inner = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & (data[:-2] != 0x81) & _VISIBLE[data[2:]]
        split[1:-2] = inner
        split[offsets] = False  # a space at the start of a text, or at its end
        split[np.maximum(offsets[1:] - 1, 0)] = False
    split = split[:-1]
    full = offsets[1:] > offsets[:-1]
    # where each stretch begins once the spaces between are taken out
    gone = np.append(0, np.cumsum(split))
    heads = np.concatenate([offsets[:-1][full], np.flatnonzero(split) + 1])
    heads.sort()
    begins = np.append(heads - gone[heads], len(data) - gone[-1]).astype(np.int64)
    packed = data[~split]
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(begins.tobytes()), pa.py_buffer(packed.tobytes())])
    return values, np.searchsorted(heads, offsets)


def groups_of(encoders: Encoders, texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of each stretch, one after the other: their packed ids, how many a stretch has, A and B tokens of a
    stretch, and whether both give its bytes back (one that does not has no groups).

    A packed group is its number of A ids, the A ids, the B ids, four bytes each.
    """
    a, b = encoders.encode([t.decode("utf-8", "replace") for t in texts])
    want = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    good = np.ones(len(texts), bool)
    flat, count = [], []
    for ids, words in ((a, encoders.a_words), (b, encoders.b_words)):
        n = np.array([len(x) for x in ids], np.int64)
        x = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
        said = words.spelled(x)
        length = np.diff(np.append(0, np.cumsum(words.size[x]))[np.append(0, np.cumsum(n))])
        if not (np.array_equal(length, size) and np.array_equal(said, want)):
            cuts, own = np.append(0, np.cumsum(length)).tolist(), said.tobytes()
            good &= [own[p:q] == b" " + t for (p, q), t in zip(pairwise(cuts), texts, strict=True)]
        flat.append(x)
        count.append(n)
    if not good.all():
        flat = [x[np.repeat(good, n)] for x, n in zip(flat, count, strict=True)]
    ends = [np.cumsum(words.size[x]) for x, words in zip(flat, (encoders.a_words, encoders.b_words), strict=True)]
    common = np.intersect1d(*ends, assume_unique=True)
    in_a, in_b = (np.searchsorted(common, e) for e in ends)
    n_a, n_b = np.bincount(in_a, minlength=len(common)), np.bincount(in_b, minlength=len(common))
    begin = np.cumsum(1 + n_a + n_b) - (1 + n_a + n_b)
    out = np.empty(len(common) + len(flat[0]) + len(flat[1]), "<u4")
    out[begin] = n_a
    out[(begin + 1 - (np.cumsum(n_a) - n_a))[in_a] + np.arange(len(in_a))] = flat[0]
    out[(begin + 1 + n_a - (np.cumsum(n_b) - n_b))[in_b] + np.arange(len(in_b))] = flat[1]
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(common), [None, pa.py_buffer((4 * np.append(begin, len(out))).astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])
    last = np.where(good, size, 0).cumsum()
    per = np.diff(np.append(0, np.searchsorted(common, last, side="right")))
    return packed, per, np.where(good, count[0], 0), np.where(good, count[1], 0), good


def spelled_out(group: bytes) -> str:
    ids = np.frombuffer(group, "<u4").tolist()
    n = ids[0] + 1
    return ",".join(map(str, ids[1:n])) + "|" + ",".join(map(str, ids[n:]))


def links_of(packed: pa.LargeBinaryArray) -> np.ndarray:
    """The link of each group as one number: its last A id, then its last B id (32 bits each)."""
    offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // 4
    ids = np.frombuffer(packed.buffers()[2], "<u4") if len(packed) else np.zeros(0, "<u4")
    begin = offsets[:-1]
    return ids[begin + ids[begin]].astype(np.int64) << 32 | ids[offsets[1:] - 1]


def _interned(packed: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    if not len(packed):
        return np.zeros(0, np.int64), packed
    coded = packed.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _flat(packed: pa.LargeBinaryArray) -> tuple[np.ndarray, bytes]:
    data, offsets = joined(packed)
    return np.diff(offsets), data.tobytes()


class _Block:
    """A block of texts, encoded."""

    def __init__(self, encoders: Encoders, batch: pa.RecordBatch) -> None:
        data, offsets = joined(batch.column("text"))
        values, self.first = stretches(data, offsets, encoders.cuts)
        self.stretch, distinct = _interned(values)
        self.groups, self.per, n_a, n_b, good = groups_of(encoders, distinct.to_pylist())
        number, self.distinct = _interned(self.groups)
        self.number, cuts = number, np.append(0, np.cumsum(self.per))
        self.cuts = cuts
        total = lambda x: np.diff(np.append(0, np.cumsum(x[self.stretch]))[self.first])
        whole = (total(~good) == 0) & (np.diff(self.first) > 0)
        self.whole = whole
        self.counts = [np.where(whole, total(x), 0) for x in (n_a, n_b, self.per)]
        self.doc = np.repeat(np.arange(len(whole)), np.diff(self.first))

    def texts(self) -> list[str]:
        """Groups of each document, spelled out."""
        said = [spelled_out(g) for g in self.distinct.to_pylist()]
        number, cuts = self.number.tolist(), self.cuts.tolist()
        lines = [";".join([said[k] for k in number[p:q]]) for p, q in zip(cuts, cuts[1:])]
        stretch, first = self.stretch.tolist(), self.first.tolist()
        return [";".join([lines[s] for s in stretch[p:q]]) if ok else "" for ok, p, q in zip(self.whole.tolist(), first, first[1:])]

    def weights(self, weight: str) -> np.ndarray:
        """Occurrences of each distinct group in the block's documents, or documents with it."""
        inside = self.whole[self.doc]
        if weight == "links":
            times = np.bincount(self.stretch[inside], minlength=len(self.per))
            freq = np.zeros(len(self.distinct), np.int64)
            np.add.at(freq, self.number, np.repeat(times, self.per))
            return freq
        pairs = np.unique(self.doc[inside] * (len(self.per) + 1) + self.stretch[inside])
        doc, stretch = np.divmod(pairs, len(self.per) + 1)
        n = self.per[stretch]
        at = np.repeat(self.cuts[stretch] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        held = np.unique(np.repeat(doc, n) * (len(self.distinct) + 1) + self.number[at])
        return np.bincount(held % (len(self.distinct) + 1), minlength=len(self.distinct)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BLOCK_BYTES`` of text: small ones put together, large ones cut."""
    held, size = [], 0
    for batch in batches:
        for part in text_blocks(batch, limit=BLOCK_BYTES):
            held.append(part)
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _encode(a_path: str, b_path: str, bits: int, weight: str):
    schema = pa.schema([(k, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for k, t in (c.split() for c in _BLOCKS.split(", "))])

    def rows(block: int, found: _Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def batch_of(kind: int, n: int, **columns):
            columns |= {"kind": pa.array([kind] * n, pa.int32()), "block": pa.array([block] * n, pa.int64())}
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        sha = [hashlib.sha256(t.encode()).hexdigest() if ok else "" for ok, t in zip(found.whole.tolist(), found.texts(), strict=True)]
        stretch = found.stretch.astype("<u4")
        parts = [pack(stretch[p:q]) if ok else b"" for ok, p, q in zip(found.whole.tolist(), found.first.tolist(), found.first[1:].tolist())]
        counts = [pa.array(c) for c in found.counts]
        yield batch_of(DOCUMENT, batch.num_rows, doc_id=batch.column("doc_id"), n_a=counts[0], n_b=counts[1], n_groups=counts[2], groups_sha256=pa.array(sha), parts=pa.array(parts, pa.binary()))
        # groups in order of bucket, and of hash within
        data, offsets = joined(found.distinct)
        h = mix(word_hashes(Words(data, offsets, offsets[:-1], offsets[1:], offsets)))
        order = np.argsort(h, kind="stable")
        buckets, cuts = bucket_cuts(h[order], bits)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield batch_of(STRETCHES, 1, parts=pa.array([pack(place[found.number].astype("<u4"))], pa.binary()), sizes=pa.array([pack(found.per.astype("<u4"))], pa.binary()))
        freq = found.weights(weight)[order]
        packed = found.distinct.take(pa.array(order))
        sizes, keys = _flat(packed)
        ends = np.append(0, np.cumsum(sizes)).tolist()
        cuts = cuts.tolist()
        yield batch_of(
            GROUPS, len(buckets), bucket=pa.array(buckets),
            parts=pa.array([keys[ends[p] : ends[q]] for p, q in zip(cuts, cuts[1:])], pa.binary()),
            sizes=pa.array([pack(sizes[p:q].astype("<u4")) for p, q in zip(cuts, cuts[1:])], pa.binary()),
            freq=pa.array([pack(freq[p:q]) for p, q in zip(cuts, cuts[1:])], pa.binary()),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(a_path, b_path)
        for k, batch in enumerate(_gathered(batches)):
            yield from rows(TaskContext.get().partitionId() << 32 | k, _Block(encoders, batch), batch)

    return run


def _spell(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(a_path, b_path)
        for batch in _gathered(batches):
            found = _Block(encoders, batch)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_a": pa.array(found.counts[0]), "n_b": pa.array(found.counts[1]), "groups": pa.array(found.texts(), pa.string())})

    return run


def _sent(table: pa.Table) -> pa.LargeBinaryArray:
    """All packed groups of a bucket's rows, one after the other."""
    sizes = np.frombuffer(b"".join(table.column("sizes").to_pylist()), "<u4").astype(np.int64)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(table.column("parts").to_pylist()))])


def _expand_links(table: pa.Table) -> pa.Table:
    number, groups = _interned(_sent(table))
    freq = np.zeros(len(groups), np.int64)
    np.add.at(freq, number, np.frombuffer(b"".join(table.column("freq").to_pylist()), np.int64))
    links, where = np.unique(links_of(groups), return_inverse=True)
    count = np.zeros(len(links), np.int64)
    np.add.at(count, where, freq)
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(links), pa.int64()), "link": pa.array(links), "links": pa.array(count)})


def _answer(sent: pa.Table, figures: pa.Table) -> pa.Table:
    blocks, sizes = sent.column("block").to_pylist(), [len(s) // 4 for s in sent.column("sizes").to_pylist()]
    link = figures.column("link").to_numpy()
    order = np.argsort(link)
    at = order[np.searchsorted(link[order], links_of(_sent(sent)))] if len(link) else np.zeros(0, np.int64)
    best, count = figures.column("best").to_numpy()[at].astype(np.uint8), figures.column("count").to_numpy()[at]
    cuts = np.cumsum([0, *sizes]).tolist()
    return pa.table({
        "block": pa.array(blocks, pa.int64()),
        "bucket": sent.column("bucket"),
        "best": pa.array([pack(best[p:q]) for p, q in zip(cuts, cuts[1:])], pa.binary()),
        "count": pa.array([pack(count[p:q]) for p, q in zip(cuts, cuts[1:])], pa.binary()),
    })


def _sum_up(block: pa.Table, answers: pa.Table) -> pa.Table:
    kind = block.column("kind").to_numpy()
    docs, table = block.filter(pa.array(kind == DOCUMENT)), block.filter(pa.array(kind == STRETCHES))
    answers = answers.take(pa.array(np.argsort(answers.column("bucket").to_numpy())))
    figures = [np.frombuffer(b"".join(answers.column(k).to_pylist()), t).astype(np.int64) for k, t in (("best", np.uint8), ("count", np.int64))]
    groups = np.frombuffer(b"".join(table.column("parts").to_pylist()), "<u4")
    stretch_cuts = np.append(0, np.cumsum(np.frombuffer(b"".join(table.column("sizes").to_pylist()), "<u4").astype(np.int64)))
    parts = docs.column("parts").to_pylist()
    stretch = np.frombuffer(b"".join(parts), "<u4")
    doc_cuts = np.append(0, np.cumsum([len(p) // 4 for p in parts])).astype(np.int64)
    sums = lambda x, cuts: np.diff(np.append(0, np.cumsum(x))[cuts])
    best, count = (sums(sums(f[groups], stretch_cuts)[stretch], doc_cuts) for f in figures)
    return pa.table({k: docs.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups")} | {"n_links": docs.column("n_groups"), "n_best": pa.array(best, pa.int64()), "count_sum": pa.array(count, pa.int64()), "groups_sha256": docs.column("groups_sha256")})


@dataclass(frozen=True)
class Aligner:
    """Paths of a byte-level tokenizer (A) and a sentencepiece model that adds a space (B).

    weight: what a pair's count counts, ``links`` (occurrences) or, group by group, ``documents``.
    """

    a_path: str
    b_path: str
    weight: str = "links"

    def __post_init__(self) -> None:
        if self.weight not in ("links", "documents"):
            raise ValueError(f"weight: links or documents, not {self.weight!r}")

    def _read(self, docs: DataFrame) -> DataFrame:
        return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def groups(self, docs: DataFrame) -> DataFrame:
        """Per document: doc_id, n_a, n_b, groups (``a1,a2|b1;a3|b2,b3``)."""
        return self._read(docs).mapInArrow(_spell(self.a_path, self.b_path), "doc_id long, n_a long, n_b long, groups string")

    def _encoded(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The written blocks, and the links of each bucket's groups."""
        bits = power_of_two(cells_for(docs) / 4)
        blocks = materialise(self._read(docs).mapInArrow(_encode(self.a_path, self.b_path, bits, self.weight), _BLOCKS), "alignment", "zstd")
        links = blocks.where(F.col("kind") == GROUPS).select("bucket", "block", "parts", "sizes", "freq").groupBy("bucket").applyInArrow(_expand_links, "bucket long, link long, links long")
        return blocks, materialise(links, "links")

    def _figures(self, links: DataFrame) -> DataFrame:
        counts = links.groupBy("link").agg(F.sum("links").alias("count"))
        b = F.col("link").bitwiseAND(0xFFFFFFFF)
        return counts.select("link", "count", (F.col("count") == F.max("count").over(W.partitionBy(b))).alias("best"))

    def pairs(self, docs: DataFrame) -> DataFrame:
        """The corpus' linked pairs: a, b, count, best (the count is its B id's highest)."""
        figures = self._figures(self._encoded(docs)[1]).where("count > 0")
        return figures.select(F.shiftright("link", 32).cast("int").alias("a"), F.col("link").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count", "best")

    def report(self, docs: DataFrame) -> DataFrame:
        """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        blocks, links = self._encoded(docs)
        figures = links.select("bucket", "link").join(self._figures(links), "link")
        groups = blocks.where(F.col("kind") == GROUPS).select("bucket", "block", "parts", "sizes")
        answers = groups.groupBy("bucket").cogroup(figures.groupBy("bucket")).applyInArrow(_answer, "block long, bucket long, best binary, count binary")
        docs_and_stretches = blocks.where(F.col("kind") != GROUPS).select("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "parts", "sizes")
        return docs_and_stretches.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sum_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
