"""n-gram Jaccard join through a MinHash LSH forest.

Documents are sets of five-word shingles (a document of one to four words is
one shingle).  Two documents are linked when their Jaccard similarity is at
least ``threshold``.

1. Signatures.  Texts with the same words are one node, told by a 128-bit BLAKE2
   digest of the words.  Each node has ``trees`` sequences of ``most_depth``
   MinHash values of 16 bits.
2. Forest.  A tree is the prefix trie of its sequences, kept as a sorted
   array: all sequences are range-sorted by (tree, values), and beside each stands
   the length of the prefix that it shares with the one before.  The nodes below a
   trie node of depth d are a run in which these lengths are d or more, and each run
   links its members to its first: a star, never all pairs.  Runs that go
   over the end of a partition are joined by its first and last sequences.
3. Prefixes are shortened until the recall is reached.  Beginning with whole
   sequences, stars are merged into candidate groups by connected components
   and verified.  A true pair of similarity s meets at depth d with probability
   p_d(s) = 1 - (1 - s^d)^trees, so every pair found stands for 1 / p_d(s) pairs, and the
   similarities of all pairs found tell which part of all pairs has been found (with one
   more pair right at the threshold counted as missed in part, so that few pairs prove
   little).  Below ``recall`` the prefixes are cut to the greatest length that the same
   similarities say is enough, and groups that have grown are verified anew.
4. Exact verification.  Every pair of texts in a candidate group is compared
   by its shingle sets.  A group with more texts or shingles than one task
   should hold is dealt into blocks, and each pair of blocks is a task of its
   own, so nothing is capped.  Only link counts, one root a text and a histogram of
   similarities leave a task, not pairs.

Scale: rows with sequences and node numbers are shuffled; texts are shuffled once
to fetch the shingles of those below some trie node.  A group of copies that holds a third of
all rows is one node after the first aggregation; a run that holds a third of all nodes
is split by the range sort.  Counting the links in a group of n different near copies
takes n^2 comparisons, and its texts are sent n / ``block_texts`` times.

Defined results: texts without words (null, empty, blank) link to nothing and
are their own class; very long texts are whole sets of shingles, in blocks of their own; repeated rows
link to each other as copies do; a class with several least doc_ids keeps any one of the rows
that are equal in doc_id and text; a null
doc_id counts as less than all others; an empty table gives no rows; other
columns are never read.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, bound_batches, gram_hashes, materialise, pack, text_blocks, word_hashes, words_of
from .graphs import connected_components

LEAST = -(1 << 63)
#: Values of 16 bits in each of the two numbers that hold a sequence.
HALF = 4
#: Steps from the threshold to 1 in which similarities are counted.
STEPS = 200


def met(similarity, depth: int, trees: int):
    """The probability that a pair shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def recalls(counts: np.ndarray, threshold: float, depth: int, least: int, trees: int) -> dict[int, float]:
    """The part of all pairs that prefixes of each length down to ``least`` find.

    ``counts``: pairs found at ``depth`` by similarity, in equal steps from the
    threshold.  One pair at the threshold is added.
    """
    s = threshold + (1 - threshold) * np.arange(len(counts)) / len(counts)
    n = counts.astype(float)
    n[0] += met(threshold, depth, trees)
    all_ = n / met(s, depth, trees)
    return {d: float((all_ * met(s, d, trees)).sum() / all_.sum()) for d in range(least, depth + 1)}


def digests(w: Words) -> list[bytes]:
    """128 bits for each text: a digest of its words, joined by one space."""
    gap = np.zeros(len(w.data) + 1, bool)
    gap[w.end] = True
    last = w.first[1:][w.counts > 0] - 1
    gap[w.end[last]] = False
    ink = np.zeros(len(w.data) + 1, np.int8)
    ink[w.start] += 1
    ink[w.end] -= 1  # a word never begins where another ends, but a text may
    ink = np.cumsum(ink)[:-1] > 0 if len(w.start) else np.zeros(len(w.data), bool)
    take = ink | gap[:-1]
    data = w.data.copy()
    data[gap[:-1] & ~ink] = 0x20
    at = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(take, out=at[1:])
    kept, cuts = data[take], at[w.offsets].tolist()
    return [hashlib.blake2b(kept[a:b], digest_size=16).digest() for a, b in zip(cuts, cuts[1:])]


def shingles_of(w: Words, size: int, of_text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in turn and how many each has; ``of_text``: digests."""
    h = word_hashes(w)
    counts = w.counts
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.empty(number.sum(), np.uint64)
    at = np.cumsum(number) - number
    long = counts >= size
    left = w.first[1:][w.doc()] - np.arange(len(h))
    grams = gram_hashes(h, size)
    mask = np.repeat(long, number)
    if len(grams):
        out[mask] = grams[left[: len(grams)] >= size]
    short = np.flatnonzero(~long & (counts > 0))
    out[at[short]] = np.frombuffer(b"".join(of_text[i][:8] for i in short.tolist()), np.uint64)
    return out, number


def _sign(size: int, trees: int, depth: int):
    rng = np.random.default_rng(8)
    times = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                w = words_of(block.column("text"))
                node = digests(w)
                shingles, number = shingles_of(w, size, node)
                some = np.flatnonzero(number)
                keys = np.zeros((2, len(some), trees), np.uint64)
                if len(some):
                    x = (shingles >> np.uint64(32)).astype(np.uint32)
                    starts = (np.cumsum(number) - number)[some]
                    y = np.empty_like(x)
                    for t in range(trees):
                        for i in range(depth):
                            np.multiply(x, times[t * depth + i], out=y)
                            np.add(y, plus[t * depth + i], out=y)
                            value = (np.minimum.reduceat(y, starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
                            keys[i // HALF, :, t] |= value.astype(np.uint64) << np.uint64(16 * (HALF - 1 - i % HALF))
                at = np.zeros(len(number) + 1, np.int32)
                np.cumsum(np.where(number > 0, trees, 0), out=at[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        block.column("print"),
                        pa.array(node, pa.binary(), mask=number == 0),
                        pa.array(number.astype(np.int64)),
                        *(pa.ListArray.from_arrays(at, k.view(np.int64).ravel()) for k in keys),
                    ],
                    ["doc_id", "print", "node", "shingles", "hi", "lo"],
                )

    return run


# -------------------------------------------------------------------- forest
def shared_prefix(tree: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """How many values each sequence shares with the one before: 0, or ``HALF`` to twice that."""
    same = np.zeros(len(tree), bool)
    same[1:] = (tree[1:] == tree[:-1]) & (hi[1:] == hi[:-1])
    other = np.full(len(tree), (1 << 64) - 1, np.uint64)
    other[1:] = (lo[1:] ^ lo[:-1]).view(np.uint64)
    more = sum((other >> np.uint64(16 * i) == 0).astype(np.int64) for i in range(HALF))
    return np.where(same, HALF + more, 0)


def _runs(most: int):
    """Sorted sequences to links: each to the first of its run, for every prefix length.

    The first and last sequences of a partition come with its number (``part``).
    """
    depths = range(HALF, most + 1)
    names = ["id", "prefix", "hubs", "part", "turn", "tree", "hi", "lo"]

    def ends(part: int, turn: int, tree: int, hi: int, lo: int, own: int) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((own, None, None, part, turn, tree, hi, lo), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple | None = None
        hubs = np.zeros(len(depths), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, hi, lo, own = (batch.column(c).to_numpy() for c in ("tree", "hi", "lo", "id"))
            if last is None:
                yield ends(part, 0, tree[0], hi[0], lo[0], own[0])
                hubs[:] = own[0]
                before = (tree[0] - 1, hi[0], lo[0], own[0])
            else:
                before = last
            tree, hi, lo, own = (np.concatenate([[b], a]).astype(a.dtype) for b, a in zip(before, (tree, hi, lo, own), strict=True))
            prefix = shared_prefix(tree, hi, lo)
            at, first = np.arange(len(own)), np.empty((len(own), len(depths)), np.int64)
            for j, d in enumerate(depths):
                start = np.maximum.accumulate(np.where(prefix < d, at, 0))
                first[:, j] = np.where(start == 0, hubs[j], own[start])
            hubs = first[-1].copy()
            last = (tree[-1], hi[-1], lo[-1], own[-1])
            linked_ = np.flatnonzero(prefix >= HALF)
            n = len(linked_)
            none = lambda t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own[linked_]),
                    pa.array(prefix[linked_].astype(np.int32)),
                    pa.ListArray.from_arrays(np.arange(0, n * len(depths) + 1, len(depths), dtype=np.int32), first[linked_].ravel()),
                    none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int64()),
                ],
                names,
            )
        if last is not None:
            yield ends(part, 1, *last)

    return run


RUNS = "id long, prefix int, hubs array<long>, part int, turn int, tree int, hi long, lo long"


def forest(sequences: DataFrame, most: int) -> DataFrame:
    """sequences: id, hi, lo (arrays, a place for each tree).  Gives id, prefix, hubs.

    ``hubs[d - HALF]`` is the node to which ``id`` is linked by prefixes of d values.
    """
    rows = sequences.select("id", F.posexplode(F.arrays_zip("hi", "lo")).alias("tree", "key")).select("tree", "key.hi", "key.lo", "id")
    order = ["tree", "hi", "lo", "id"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = materialise(sorted_.mapInArrow(_runs(most), RUNS), "runs")
    inside = runs.filter("part is null").select("id", "prefix", "hubs")
    # two rows a partition: the last of one beside the first of the next
    ends = runs.filter("part is not null")
    by = W.partitionBy(F.lit(0)).orderBy("part", "turn")
    before = lambda c: F.lag(c).over(by).alias(f"its_{c}")
    pairs = ends.select(*order, "turn", *map(before, order)).filter("turn = 0 and its_tree = tree and its_hi = hi")
    longest = F.greatest(*[F.when(F.shiftrightunsigned(F.expr("lo ^ its_lo"), 16 * i) == 0, HALF * 2 - i).otherwise(HALF) for i in range(HALF)])
    across = pairs.select("id", F.least(longest, F.lit(most)).cast("int").alias("prefix"), "its_id")
    hubs = F.array(*[F.when(F.col("prefix") >= d, F.col("its_id")).otherwise(F.col("id")) for d in range(HALF, most + 1)])
    return inside.unionByName(across.select("id", "prefix", hubs.alias("hubs")))


def shorter(runs: DataFrame, depth: int, before: tuple[int, DataFrame] | None) -> DataFrame:
    """The links by prefixes of ``depth`` values, as edges u, v.

    ``before``: a greater length and its components (node, root).  These stand for the links that it has too: the
    first of each of its runs is linked to the first of the longer run by a prefix below that length.
    """
    links = lambda rows: rows.select(F.col("id").alias("u"), F.col("hubs")[depth - HALF].alias("v"))
    new = runs.filter(F.col("prefix") >= depth)
    if before is None:
        return links(new)
    length, stars = before
    return links(new.filter(F.col("prefix") < length)).unionByName(stars.select(F.col("node").alias("u"), F.col("root").alias("v")))


def _sets(size: int):
    """Distinct shingles of each text, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                w = words_of(block.column("text"))
                shingles, number = shingles_of(w, size, digests(w))
                ends = np.cumsum(number)
                sets = [np.unique(shingles[e - k : e]) for e, k in zip(ends.tolist(), number.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([block.column("id"), block.column("copies"), pa.array([len(s) for s in sets], pa.int64()), pa.array([pack(s) for s in sets], pa.binary())], ["id", "copies", "shingles", "set"])

    return run


# -------------------------------------------------------------- verification
def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets shares."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    values, doc = np.concatenate(sets)[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    holders = np.diff(np.append(starts, len(values)))
    shared = np.zeros((n, n), np.int64)
    many = np.flatnonzero(holders > 24)
    for a in range(0, len(many), 2048):  # common shingles: a product of incidence matrices
        part = many[a : a + 2048]
        here = np.zeros((n, len(part)), np.float32)
        rows = np.concatenate([doc[s : s + k] for s, k in zip(starts[part].tolist(), holders[part].tolist(), strict=True)])
        here[rows, np.repeat(np.arange(len(part)), holders[part])] = 1
        shared += np.rint(here @ here.T).astype(np.int64)
    for k in np.unique(holders[(holders > 1) & (holders <= 24)]).tolist():  # rarer ones: the pairs in each list
        at = starts[holders == k]
        i, j = np.triu_indices(k, 1)
        for a in range(0, len(at), max(1, 2_000_000 // len(i))):
            lists = doc[at[a : a + max(1, 2_000_000 // len(i)), None] + np.arange(k)]
            shared += np.bincount((lists[:, i] * n + lists[:, j]).ravel(), minlength=n * n).reshape(n, n)
    return np.maximum(shared, shared.T)


def jaccard(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of the intersections and of the unions of all pairs of sets."""
    size = np.array([len(s) for s in sets])
    shared = _overlaps(sets)
    return shared, size[:, None] + size[None, :] - shared


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, as a symmetric matrix."""
    shared, union = jaccard(sets)
    out = shared >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        node = table.column("id").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("set").to_pylist()]
        shared, union = jaccard(sets)
        near = shared >= threshold * union - 1e-9
        np.fill_diagonal(near, False)
        block, left, right = (table.column(k).to_numpy() for k in ("block", "left", "right"))
        if left[0] != right[0]:  # pairs inside a block are another task's
            near &= block[:, None] != block[None, :]
        links = near.astype(np.int64) @ table.column("copies").to_numpy()
        i, j = np.nonzero(np.triu(near, 1))
        step = np.clip(((shared[i, j] / union[i, j] - threshold) / (1 - threshold) * STEPS).astype(np.int64), 0, STEPS - 1) if threshold < 1 else np.full(len(i), STEPS - 1)
        root, seen = np.arange(len(node)), np.zeros(len(node), bool)
        for a in range(len(node)):  # nodes are sorted, so each tree is found from its least
            if seen[a]:
                continue
            seen[a], front = True, [a]
            while front:
                new = near[front].any(axis=0) & ~seen
                root[new], seen[new] = a, True
                front = np.flatnonzero(new).tolist()
        out = np.flatnonzero(links > 0)
        told = [np.bincount(step, minlength=STEPS).tolist(), *[None] * (len(out) - 1)] if len(out) else []
        return pa.table({
            "candidate": table.column("candidate").take(pa.array(out)), "id": pa.array(node[out]), "root": pa.array(node[root[out]]), "links": pa.array(links[out]),
            "dealt": pa.array(table.column("blocks").to_numpy()[out] > 1), "similar": pa.array(told, pa.list_(pa.int64())),
        })

    return run


FOUND = "candidate long, id long, root long, links long, dealt boolean, similar array<long>"


@dataclass(frozen=True)
class NearCopies:
    """``report`` tells the prefix length and the recall of the last run."""

    threshold: float = 0.8
    shingle: int = 5
    trees: int = 24
    most_depth: int = 2 * HALF
    least_depth: int = HALF
    recall: float = 0.9999
    block_texts: int = 1024
    block_shingles: int = 1_000_000
    spread_texts: int = 256
    spread_blocks: int = 8
    hot_share: int = 1000
    report: dict = field(default_factory=dict, compare=False)

    def _deal(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """Link counts and roots of the texts of candidate groups (candidate, id, copies, texts, all)."""
        needed = F.greatest(F.ceil(F.col("texts") / self.block_texts), F.ceil(F.col("all") / self.block_shingles))
        spread = F.least(F.ceil(F.col("texts") / self.spread_texts), F.lit(self.spread_blocks))  # groups of some size become several tasks
        member = groups.withColumn("blocks", F.greatest(needed, spread).cast("int")).withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = member.join(sets.select("id", "set"), "id").select("candidate", "id", "copies", "blocks", "block", "set", other).select(
            "candidate", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "id", "copies", "blocks", "block", "set"
        )
        return dealt.groupBy("candidate", "left", "right").applyInArrow(_verify(self.threshold), FOUND)

    def links(self, nodes: DataFrame, sequences: DataFrame, texts: DataFrame) -> DataFrame:
        """candidate, id, root, links, dealt of all linked nodes.

        nodes: id, doc_id, print, copies; sequences: id, hi, lo; texts: doc_id, print, text.
        """
        runs = materialise(forest(sequences, self.most_depth), "forest")
        some = runs.select(F.explode(F.array("id", F.col("hubs")[0])).alias("id")).distinct()
        wanted = nodes.join(some, "id", "left_semi").select("id", "doc_id", "print", "copies")
        fetched = texts.join(wanted.hint("shuffle_hash"), ["doc_id", "print"]).select("id", "copies", "text")
        sets = fetched.mapInArrow(_sets(self.shingle), "id long, copies long, shingles long, set binary").dropDuplicates(["id"])  # a text comes twice where rows repeat
        sets = materialise(sets, "sets")
        weight = sets.select("id", "copies", "shingles")
        depth, before = self.most_depth, None
        while True:
            stars = connected_components(shorter(runs, depth, before[2] if before else None))
            member = stars.select(F.col("node").alias("id"), F.col("root").alias("candidate")).join(weight, "id")
            member = materialise(member, "members")
            sizes = member.groupBy("candidate").agg(F.count(F.lit(1)).alias("texts"), F.sum("shingles").alias("all"))
            if before is None:
                sizes = materialise(sizes.withColumn("same", F.lit(False)), "sizes")
                found = materialise(self._deal(member.join(sizes, "candidate"), sets), "links")
            else:  # a group only grows, so one with as many texts as before is the same
                known = before[0].select("candidate", F.col("texts").alias("its_texts"))
                sizes = sizes.join(known, "candidate", "left").withColumn("same", F.coalesce(F.col("texts") == F.col("its_texts"), F.lit(False))).drop("its_texts")
                sizes = materialise(sizes, "sizes")
                found = before[1].join(sizes.filter("same").select("candidate"), "candidate", "left_semi")
                found = materialise(found.unionByName(self._deal(member.join(sizes.filter("NOT same"), "candidate"), sets)), "links")
            told = found.filter("similar is not null").select(F.posexplode("similar").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n")).collect()
            counts = np.zeros(STEPS)
            for r in told:
                counts[r["step"]] = r["n"]
            reach = recalls(counts, self.threshold, depth, self.least_depth, self.trees)
            self.report.update(depth=depth, recall=reach[depth], pairs=int(counts.sum()))
            if reach[depth] >= self.recall or depth <= self.least_depth:
                return found
            before = (sizes, found, (depth, stars))
            depth = max((d for d in reach if d < depth and reach[d] >= self.recall), default=self.least_depth)

    def classes(self, docs: DataFrame) -> DataFrame:
        """Per row: doc_id, print (hash of its text), class_id, class_print, copy_of, n_links.

        ``class_id`` is the least doc_id that can be reached over links,
        ``copy_of`` the least with the same words, ``n_links`` the number of
        other rows linked to this one.
        """
        source = bound_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), F.xxhash64("text").alias("print"), F.col("text"))
        signed = source.mapInArrow(_sign(self.shingle, self.trees, self.most_depth), "doc_id long, print long, node binary, shingles long, hi array<long>, lo array<long>")
        signed = materialise(signed, "signatures")
        row = F.struct("doc_id", "print")
        nodes = signed.filter("node is not null").groupBy("node").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"))
        nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
        flat = nodes.select("id", "node", F.col("first.doc_id").alias("doc_id"), F.col("first.print").alias("print"), "copies")
        # one row of each node stands for it in the forest
        sequences = signed.join(flat.drop("copies"), ["node", "doc_id", "print"]).select("id", "hi", "lo")
        sequences = materialise(sequences.dropDuplicates(["id"]), "sequences")
        found = self.links(flat, sequences, source)
        roots = found.filter("not dealt").select(F.col("id").alias("node"), "root")
        if not found.filter("dealt").select(F.lit(1)).limit(1).isEmpty():
            merged = connected_components(found.filter("dealt").select(F.col("id").alias("u"), F.col("root").alias("v")))
            roots = roots.unionByName(merged)
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        rooted = roots.withColumnRenamed("node", "id").join(nodes.select("id", "first"), "id")
        least = rooted.groupBy("root").agg(F.min("first").alias("class"))
        linked_nodes = rooted.join(least, "root").join(links, "id").select("id", "class", "links")
        known = nodes.join(linked_nodes, "id", "left").select(
            "node", "copies", "first", F.coalesce("class", "first").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        )
        known = materialise(known, "known")
        # texts that more than a thousandth of the rows share are at most a thousand: these go by broadcast
        total = nodes.agg(F.sum("copies")).first()[0] or 0
        often = nodes.filter(F.col("copies") > total / self.hot_share).select("node", F.lit(True).alias("often"))
        known = known.drop("copies").join(F.broadcast(often), "node", "left")
        rows = signed.select("doc_id", "print", "node")
        hot = rows.join(F.broadcast(known.filter("often")), "node")
        cold = rows.join(F.broadcast(often), "node", "left_anti").join(known.filter("often IS NULL"), "node", "left")
        out = hot.unionByName(cold)
        of = lambda c, k: F.coalesce(F.col(c)[k], F.col(k))
        return out.select("doc_id", "print", of("class", "doc_id").alias("class_id"), of("class", "print").alias("class_print"), of("first", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def join(self, docs: DataFrame) -> DataFrame:
        """One row per document: doc_id, class_id, copy_of, n_links, and the prefix length and recall of the forest."""
        back = lambda c: F.when(F.col(c) != LEAST, F.col(c)).alias(c)
        out = self.classes(docs)
        return out.select(back("doc_id"), back("class_id"), back("copy_of"), "n_links", F.lit(self.report["depth"]).alias("prefix"), F.lit(self.report["recall"]).alias("recall"))

    def keep_one(self, docs: DataFrame) -> DataFrame:
        """The documents with one left of each class: the one with the least doc_id."""
        stay = self.classes(docs).filter("doc_id = class_id and print = class_print").select(F.col("doc_id").alias("k"), F.col("print").alias("p"))
        # rows without words all stay; of equal rows one does; the columns travel in one struct, whatever they are called
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        rows = docs.select(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"), F.xxhash64("text").alias("print"))
        rows = rows.join(stay.distinct().hint("shuffle_hash"), (F.col("key") == F.col("k")) & (F.col("print") == F.col("p")), "left_semi")
        turn = F.row_number().over(W.partitionBy("key", "print").orderBy(F.lit(0)))
        return rows.withColumn("turn", turn).filter(F.col("turn") == 1).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
