"""Substring dedup with repeated-phrase automata.

A window is ``span`` (20) consecutive words of one document; windows whose
word sequence starts earlier too are repeats, and the words they cover go.

1. Anchors.  Among the phrases of 8 words inside a window the one with the
   least hash is its anchor, so equal windows have equal anchors, and only one
   phrase in seven is an anchor.  Each cell (a hash part of the documents)
   sends its distinct anchors with counts, packed by hash bucket; a bucket
   answers each cell which of its anchors occur twice or more anywhere.
2. Passages.  A cell cuts out the runs of windows with a recurring anchor and
   sends each distinct passage once, with its first place, to the bucket of
   the anchor; the places of its other copies in the cell are repeats already.
   Anchors with more than ``hot`` occurrences are routed by whole window
   instead, so a phrase that a third of all documents hold is spread by what
   stands around it, and a window that they all hold is sent once a cell.
3. Automata.  Each bucket is a shard: windows that occur twice are confirmed
   and compiled into an Aho-Corasick automaton over word numbers
   (pyahocorasick), all passages of the shard stream through it, and every
   occurrence but the first (least doc_id, then start) is reported.
4. The reports go back to the cells and the covered words are dropped.

Every document passes 1, 2 and 4; nothing is capped or sampled.  The text is
shuffled once (one exchange by cell, reused by the three passes).  Words and
windows are compared by 64-bit hashes.

Defined results: null text has no words; a null doc_id is less than all
others; ties (rows with the same doc_id) are taken one after the other in order of
text, and of repeated rows the first stays; very long texts are one row of a cell and pass whole; an empty table gives no rows; extra columns never reach the passes but
packed in one struct.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, bucket_cuts, cell_of, cells_for, gram_hashes, joined, mix, pack, power_of_two, powers, sliding, word_hashes, words_of

PHRASE = 8
LEAST = -(1 << 63)


def _docs(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table.column("doc_id"), LEAST).to_numpy()


def _turns(docs: np.ndarray, table: pa.Table) -> np.ndarray:
    """For rows with the same doc_id: their place in order of text."""
    turn = np.zeros(len(docs), np.int64)
    order = np.argsort(docs, kind="stable")
    same = np.flatnonzero(np.diff(docs[order]) == 0)
    if len(same):
        rows = defaultdict(list)
        for i in np.union1d(order[same], order[same + 1]).tolist():
            rows[docs[i]].append(i)
        texts = table.column("text")
        for own in rows.values():
            for k, i in enumerate(sorted(own, key=lambda i: texts[i].as_py() or "")):
                turn[i] = k
    return turn


@dataclass
class _Cell:
    """Windows of a cell: ``key`` of each word that starts one (else ``valid`` is false)."""

    span: int

    def read(self, table: pa.Table) -> _Cell:
        self.words = w = words_of(table.column("text"))
        self.hashes = word_hashes(w)
        self.doc = w.doc()
        n = len(w.start)
        left = w.first[1:][self.doc] - np.arange(n)  # words up to the end of the document
        self.valid = left >= self.span
        reach = self.span - PHRASE + 1
        self.least = np.zeros(n, np.uint64)
        grams = gram_hashes(self.hashes, PHRASE)
        if len(grams) >= reach:
            found = sliding(np.minimum, grams, reach)
            self.least[: len(found)] = found
        self.least[~self.valid] = 0
        self.grams, self.reach = grams, reach
        return self

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and how many places have each."""
        if not self.valid.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        most = sliding(np.maximum, np.concatenate([np.zeros(self.reach - 1, np.uint64), self.least]), self.reach)
        chosen = self.grams[most[: len(self.grams)] == self.grams]
        return np.unique(mix(chosen), return_counts=True)


def _count_anchors(span: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _Cell(span).read(table).anchors()
        buckets, cuts = bucket_cuts(keys, bits)
        counts = np.minimum(counts, 65535).astype(np.uint16)
        cell = table.column("cell")[0].as_py()
        return pa.table({
            "bucket": pa.array(buckets),
            "cell": pa.array([cell] * len(buckets), pa.int32()),
            "keys": pa.array([pack(keys[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
            "counts": pa.array([pack(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
        })

    return run


def _find_recurring(hot: int):
    def run(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()]
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16)
        keys, where = np.unique(np.concatenate(blocks), return_inverse=True)
        total = np.bincount(where, counts, len(keys))
        answer = (total >= 2).astype(np.uint8) + (total > hot)
        cells, out, flags, a = [], [], [], 0
        for cell, block in zip(table.column("cell").to_pylist(), blocks, strict=True):
            said = answer[where[a : a + len(block)]]
            a += len(block)
            if (yes := said > 0).any():
                cells.append(cell)
                out.append(pack(block[yes]))
                flags.append(pack(said[yes]))
        return pa.table({"cell": pa.array(cells, pa.int32()), "keys": pa.array(out, pa.binary()), "flags": pa.array(flags, pa.binary())})

    return run


_SENT = ("bucket", "cell", "doc", "place", "windows", "bounds", "text", "known")


def _cut_passages(span: int, bits: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        nothing = pa.table({k: pa.array([], pa.int64() if k == "bucket" else pa.int32() if k == "cell" else pa.binary()) for k in _SENT})
        if not docs.num_rows or not answers.num_rows:
            return nothing
        c = _Cell(span).read(docs)
        known = np.frombuffer(b"".join(answers.column("keys").to_pylist()), np.uint64)
        flags = np.frombuffer(b"".join(answers.column("flags").to_pylist()), np.uint8)
        order = np.argsort(known)
        known, flags = known[order], flags[order]
        at = np.flatnonzero(c.valid)
        key = mix(c.least[at])
        found = np.minimum(np.searchsorted(known, key), len(known) - 1)
        recurring = known[found] == key
        at, key, flag = at[recurring], key[recurring], flags[found[recurring]]
        if not len(at):
            return nothing
        hot = flag == 2
        if hot.any():  # routed by the whole window
            key = key.copy()
            key[hot] = mix(gram_hashes(c.hashes, span)[at[hot]])
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (np.diff(at) != 1) | (key[1:] != key[:-1]) | hot[1:] | hot[:-1] | (c.doc[at[1:]] != c.doc[at[:-1]])
        begin = np.flatnonzero(new)
        start, key = at[begin], key[begin]
        windows = np.diff(np.append(begin, len(at)))
        last = start + windows + span - 2
        # distinct passages: a hash of all their words
        up, down = powers(len(c.hashes) + 1)
        sums = np.zeros(len(c.hashes) + 1, np.uint64)
        np.cumsum(c.hashes * up[: len(c.hashes)], out=sums[1:])
        content = mix((sums[last + 1] - sums[start]) * down[start] + windows.astype(np.uint64)) ^ key
        ids = _docs(docs)
        row = c.doc[start]
        doc, place = ids[row], (_turns(ids, docs)[row] << 32) + start - c.words.first[row]
        order = np.lexsort((place, doc, content))
        content = content[order]
        lead = np.ones(len(order), bool)
        lead[1:] = content[1:] != content[:-1]
        copies, firsts = order[~lead], order[lead]
        firsts = firsts[np.argsort(key[firsts], kind="stable")]
        buckets, cuts = bucket_cuts(key[firsts], bits)
        raw = c.words.data.tobytes()
        a, b = c.words.start[start[firsts]].tolist(), c.words.end[last[firsts]].tolist()
        rows: dict[str, list] = {k: [] for k in _SENT}
        cell = docs.column("cell")[0].as_py()
        for bucket, p, q in zip(buckets.tolist(), cuts.tolist(), cuts[1:].tolist()):
            own = firsts[p:q]
            texts = [raw[x:y] for x, y in zip(a[p:q], b[p:q], strict=True)]
            sent = (bucket, cell, pack(doc[own]), pack(place[own]), pack(windows[own]), pack(np.cumsum([len(t) for t in texts])), b"".join(texts), b"")
            for k, v in zip(_SENT, sent, strict=True):
                rows[k].append(v)
        if len(copies):
            known_repeats = pack(np.stack([doc[copies], place[copies], windows[copies]], 1).astype(np.int64))
            for k, v in zip(_SENT, (cell % (1 << bits), cell, b"", b"", b"", b"", b"", known_repeats), strict=True):
                rows[k].append(v)
        return pa.table({k: pa.array(v, nothing.schema.field(k).type) for k, v in rows.items()})

    return run


def _run_automaton(span: int):
    def run(table: pa.Table) -> pa.Table:
        import ahocorasick

        col = {k: table.column(k).to_pylist() for k in table.column_names}
        out: list[tuple[int, bytes]] = [(cell, k) for cell, k in zip(col["cell"], col["known"], strict=True) if k]
        whole = lambda k: np.frombuffer(b"".join(col[k]), np.int64)
        doc, place, windows = whole("doc"), whole("place"), whole("windows")
        cell = np.repeat(np.array(col["cell"], np.int64), [len(x) // 8 for x in col["doc"]])
        ends = [np.frombuffer(b, np.int64) for b in col["bounds"]]
        sizes = np.concatenate([np.diff(e, prepend=0) for e in ends]) if ends else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(col["text"]))])
        if len(sizes):
            w = words_of(texts)
            h = word_hashes(w)
            number = np.unique(h, return_inverse=True)[1] + 1
            begins = w.first[:-1]
            every = np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            _, where, times = np.unique(gram_hashes(h, span)[every], return_index=True, return_counts=True)
            confirmed = every[where[times > 1]].tolist()
            if confirmed:
                # a stream of word numbers; 0 parts the passages
                numbers = number.tolist()
                automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
                for k, s in enumerate(confirmed):
                    automaton.add_word(tuple(numbers[s : s + span]), k)
                automaton.make_automaton()
                stream = np.zeros(len(number) + len(sizes), np.int64)
                shift = np.arange(len(number)) + w.doc()
                stream[shift] = number
                hits = np.fromiter(chain.from_iterable(automaton.iter(tuple(stream.tolist()))), np.int64).reshape(-1, 2)
                begin = hits[:, 0] - span + 1
                heads = begins + np.arange(len(sizes))
                passage = np.searchsorted(heads, begin, side="right") - 1
                d, p, phrase = doc[passage], place[passage] + begin - heads[passage], hits[:, 1]
                order = np.lexsort((p, d, phrase))
                again = np.zeros(len(order), bool)
                again[1:] = phrase[order][1:] == phrase[order][:-1]
                order = order[again]
                d, p, c = d[order], p[order], cell[passage[order]]
                order = np.lexsort((p, d, c))
                d, p, c = d[order], p[order], c[order]
                new = np.ones(len(d), bool)
                new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (np.diff(p) != 1)
                begin = np.flatnonzero(new)
                runs = np.stack([d[begin], p[begin], np.diff(np.append(begin, len(d)))], 1).astype(np.int64)
                c = c[begin]
                cuts = np.append(np.flatnonzero(np.diff(c, prepend=-1)), len(c))
                out += [(int(c[a]), pack(runs[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
        return pa.table({"cell": pa.array([x[0] for x in out], pa.int32()), "repeats": pa.array([x[1] for x in out], pa.binary())})

    return run


def _drop_repeats(span: int):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        words = words_of(docs.column("text"))
        n = len(words.start)
        gone = np.zeros(n, bool)
        if docs.num_rows and repeats.num_rows:
            runs = np.frombuffer(b"".join(repeats.column("repeats").to_pylist()), np.int64).reshape(-1, 3)
            ids = _docs(docs)
            rows = {pair: i for i, pair in enumerate(zip(ids.tolist(), _turns(ids, docs).tolist(), strict=True))}
            at = np.array([rows[pair] for pair in zip(runs[:, 0].tolist(), (runs[:, 1] >> 32).tolist(), strict=True)], np.int64)
            begin = words.first[at] + (runs[:, 1] & 0xFFFFFFFF)
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, begin + runs[:, 2] + span - 1, -1)
            gone = np.cumsum(step)[:n] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        data, offs = joined(docs.column("text"))
        raw = data.tobytes()
        kept = []
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            own = raw[a:b].split()
            if removed[i]:
                own = compress(own, ~gone[words.first[i] : words.first[i + 1]])
            kept.append(b" ".join(own))
        out = {"doc_id": docs.column("doc_id"), "n_words": pa.array(words.counts), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        if "row" in docs.column_names:
            out |= {"text": docs.column("text"), "row": docs.column("row")}
        return pa.table(out)

    return run


@dataclass(frozen=True)
class SubstringDedup:
    span: int = 20
    hot: int = 256

    def run(self, docs: DataFrame, carry: bool = False) -> DataFrame:
        """doc_id, n_words, n_removed, kept (text); with ``carry`` also ``text`` as it was, and ``row``, a struct of all other input columns."""
        rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if carry else []
        cells = cells_for(docs)
        cell = cell_of(F.coalesce(F.col("doc_id"), F.lit(LEAST)), cells).alias("cell")
        keyed = bound_batches(docs).select(cell, F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *rows)
        fields = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string")
        if carry:
            fields = fields.add("text", T.StringType()).add("row", keyed.schema["row"].dataType)
        by_cell = keyed.groupBy("cell")
        anchors = by_cell.applyInArrow(_count_anchors(self.span, power_of_two(cells / 8)), "bucket long, cell int, keys binary, counts binary")
        answers = anchors.groupBy("bucket").applyInArrow(_find_recurring(self.hot), "cell int, keys binary, flags binary")
        sent = "bucket long, cell int, doc binary, place binary, windows binary, bounds binary, text binary, known binary"
        passages = by_cell.cogroup(answers.groupBy("cell")).applyInArrow(_cut_passages(self.span, power_of_two(2 * cells)), sent)
        repeats = passages.groupBy("bucket").applyInArrow(_run_automaton(self.span), "cell int, repeats binary")
        return by_cell.cogroup(repeats.groupBy("cell")).applyInArrow(_drop_repeats(self.span), fields)
