"""Approximate nearest neighbours: 2-stable projections searched in kd-trees.

Inner products become distances within a range of norms.  A range holds the
vectors whose norm lies in (M / 2, M], M a power of two; there u = q / |q| and
y = x / M give |u - y|^2 = 1 + |y|^2 - 2 q.x / (|q| M), and no vector far longer
than the usual one sets the scale of the others.  A Gaussian projection to
``dims`` coordinates keeps a distance as itself times a chi variable.  So with
p the projected distance of a vector and s the query's k-th best product so
far, the vector would have been met with probability ``sure`` or more, were it
better than s, once

    p^2 >= c (1 + |y|^2 - 2 s / (|q| M)),        c = chi2_dims^-1(sure)

Vectors are verified by exact products in double precision in the order of
p^2 - c |y|^2, and a query stops at the first for which the test holds.  A kd-tree
finds them: a query goes down to its nearest leaf for a first s, then
through all nodes whose boxes the test doesn't rule out, and the vectors of the
leaves that remain are verified nearest first, in rounds that each
tighten s.

Scale: shards are the leaves of a kd-tree above (one for each range of norms),
whose splits come from at most ``sample_rows`` vectors; every vector is put
into its shard.  A directory holds the box, longest norm and number of rows of
each shard, and there are at most ``most_shards`` of these.  A query is sent to the
most promising shard first, and with the k-th best found there to those other
shards that the test on their boxes doesn't rule out.  A task holds one shard and
up to ``query_rows`` of its queries, so a shard is copied only where more queries
than that need it.

Defined results: rows whose vec_id or vector is null, and vectors that are empty, zero, or
with null or non-finite components take no part; vectors of different widths
are never compared (an inner product needs equal widths), so each width is
searched by itself; rows that repeat a vec_id are queries and candidates of
their own, but no row with a query's vec_id is its candidate; ties go to the
smaller vec_id; very long vectors are verified in smaller blocks; fewer candidates than k give all
of them; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Numbers held at once where vectors are gathered pair by pair.
HELD = 1 << 22
#: Where more than one of so many products of a block is wanted, all are computed as one matrix product.
DENSE = 64


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees."""
    half = np.asarray(x, float) / 2
    term = total = np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(np.isfinite(half), 1 - np.exp(-half) * np.where(np.isfinite(total), total, 0), 1.0)


def chi_square_at(sure: float, dims: int) -> float:
    """Where the distribution function reaches ``sure``, by bisection."""
    low, high = 0.0, 64.0 * dims
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), dims) < sure else (low, mid)
    return high


def norms_of(x: np.ndarray) -> np.ndarray:
    """Lengths of rows that are not zero, without squares that overflow or vanish."""
    top = np.abs(x).max(1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def plane_of(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, dims))


def range_of(length: np.ndarray) -> np.ndarray:
    """The exponent e of the least power of two that is at least a length."""
    part, e = np.frexp(length)
    return np.where(part == 0.5, e - 1, e)


def scaled(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """x / 2^e, row by row, in two steps so that neither power overflows."""
    half = e // 2
    return np.ldexp(np.ldexp(x, -half[:, None]), -(e - half)[:, None])


# ---------------------------------------------------------------------- tree
@dataclass
class Tree:
    """A kd-tree over points, with a box and the largest |y|^2 for each node."""

    order: np.ndarray  #: rows, leaf by leaf
    low: np.ndarray  #: [nodes, dims]
    high: np.ndarray
    most: np.ndarray  #: [nodes]
    child: np.ndarray  #: [nodes, 2], -1 at leaves
    span: np.ndarray  #: [nodes, 2]: rows order[a:b]

    @staticmethod
    def build(points: np.ndarray, square: np.ndarray, leaf: int) -> Tree:
        order = np.arange(len(points))
        spans, child, todo = [(0, len(points))], [[-1, -1]], [0]
        while todo:
            i = todo.pop()
            a, b = spans[i]
            if b - a <= leaf:
                continue
            own = points[order[a:b]]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            m = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], m)]
            child[i] = [len(spans), len(spans) + 1]
            spans += [(a, a + m), (a + m, b)]
            child += [[-1, -1], [-1, -1]]
            todo += child[i]
        got = points[order]
        low = np.stack([got[a:b].min(0) for a, b in spans])
        high = np.stack([got[a:b].max(0) for a, b in spans])
        most = np.array([square[order[a:b]].max() for a, b in spans])
        return Tree(order, low, high, most, np.array(child), np.array(spans))

    def gaps(self, low_q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of points to boxes, pair by pair."""
        d = np.maximum(np.maximum(self.low[nodes] - low_q, low_q - self.high[nodes]), 0)
        return np.einsum("ij,ij->i", d, d)

    def nearest_leaf(self, low_q: np.ndarray) -> np.ndarray:
        at = np.zeros(len(low_q), np.int64)
        while (inner := np.flatnonzero(self.child[at, 0] >= 0)).size:
            two = self.child[at[inner]]
            left, right = self.gaps(low_q[inner], two[:, 0]), self.gaps(low_q[inner], two[:, 1])
            at[inner] = np.where(left <= right, two[:, 0], two[:, 1])
        return at

    def leaves_within(self, low_q: np.ndarray, stop: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs that the test leaves in, from the root down."""
        q, node = np.arange(len(low_q)), np.zeros(len(low_q), np.int64)
        out_q, out_leaf = [], []
        while len(q):
            stay = self.gaps(low_q[q], node) - c * self.most[node] < stop[q]
            q, node = q[stay], node[stay]
            end = self.child[node, 0] < 0
            out_q.append(q[end])
            out_leaf.append(node[end])
            q, node = np.repeat(q[~end], 2), self.child[node[~end]].ravel()
        return np.concatenate(out_q), np.concatenate(out_leaf)


@dataclass
class Shard:
    """The vectors of one shard, all of one range of norms, ready to be searched."""

    ids: np.ndarray
    x: np.ndarray
    scale: int  #: the range's exponent
    plane: np.ndarray
    sure: float
    leaf: int
    verified: int = field(default=0)  #: products computed so far

    def __post_init__(self) -> None:
        y = scaled(self.x, np.full(len(self.x), self.scale))
        points, square = y @ self.plane, (y * y).sum(1)
        self.tree = Tree.build(points, square, self.leaf)
        order = self.tree.order
        self.ids, self.x, self.points = self.ids[order], self.x[order], points[order]
        self.c = chi_square_at(self.sure, self.plane.shape[1])
        self.ease = self.c * square[order]

    def _stop(self, kth: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The key from which the test holds for each query; infinite while it has no k-th best."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.where(np.isneginf(kth), np.inf, self.c * (1 - 2 * np.ldexp(kth / length, -self.scale)))

    def search(self, qid: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int, rounds: tuple[int, ...] = (64, 512)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query numbers, vec_ids and products of up to k vectors each; ``kth``: products known to be reached elsewhere."""
        length = norms_of(q)
        low_q = (q / length[:, None]) @ self.plane
        known = kth.copy()
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def take_in(qi: np.ndarray, row: np.ndarray) -> None:
            """Exact products of pairs, and the best k of each query with those found before."""
            nonlocal kth, found
            step = max(1, HELD // q.shape[1])
            got = [np.einsum("ij,ij->i", q[qi[a : a + step]], self.x[row[a : a + step]]) for a in range(0, len(qi), step)]
            own, names, score = (np.concatenate(c) for c in zip(found, (qi, self.ids[row], np.concatenate(got or [np.zeros(0)])), strict=True))
            order = np.lexsort((names, -score, own))
            own, names, score = own[order], names[order], score[order]
            rank = np.arange(len(own)) - np.searchsorted(own, own)
            found = (own[rank < k], names[rank < k], score[rank < k])
            here = np.full(len(q), -np.inf)
            here[own[rank == k - 1]] = score[rank == k - 1]
            kth = np.maximum(known, here)

        def verify(now: np.ndarray, rows: np.ndarray) -> None:
            """``now``: which queries meet which of ``rows``."""
            now &= qid[:, None] != self.ids[rows]
            self.verified += int(now.sum())
            if now.mean() * DENSE > 1:  # one matrix product, then exact ones of those near the k-th best
                about = np.where(now, q @ self.x[rows].T, -np.inf)
                floor = kth if about.shape[1] < k else np.maximum(kth, np.partition(about, about.shape[1] - k, axis=1)[:, about.shape[1] - k])
                now &= about >= (floor - np.ldexp(1e-9 * length, self.scale))[:, None]
            qi, at = np.nonzero(now)
            take_in(qi, rows[at])

        tree = self.tree
        gap = tree.gaps(low_q, first := tree.nearest_leaf(low_q)) - self.c * tree.most[first]
        for leaf in np.unique(first):
            mine = (first == leaf) & (gap < self._stop(kth, length))
            a, b = tree.span[leaf]
            verify(np.repeat(mine[:, None], b - a, axis=1), np.arange(a, b))
        qi, leaf = tree.leaves_within(low_q, self._stop(kth, length), self.c)
        keep = first[qi] != leaf
        qi, leaf = qi[keep], leaf[keep]
        leaves = np.unique(leaf)
        if not len(leaves):
            return found
        sizes = (tree.span[leaves, 1] - tree.span[leaves, 0]).astype(np.int64)
        rows = np.arange(sizes.sum()) + np.repeat(tree.span[leaves, 0] - np.cumsum(sizes) + sizes, sizes)
        key = np.full((len(q), len(leaves)), np.inf)
        key[qi, np.searchsorted(leaves, leaf)] = 0
        key = np.repeat(key, sizes, axis=1)
        points = self.points[rows]
        key += (low_q * low_q).sum(1)[:, None] + (points * points).sum(1) - self.ease[rows] - 2 * (low_q @ points.T)
        for take in (*rounds, None):
            now = key < self._stop(kth, length)[:, None]
            if not now.any():
                break
            if take is not None and take < len(rows):  # the nearest of each query; the others wait for a better s
                now &= key <= np.partition(key, take - 1, axis=1)[:, take - 1 : take]
            key[now] = np.inf
            verify(now, rows)
        return found


# ------------------------------------------------------------------ the index
@dataclass
class Directory:
    """The trees above the shards, and what is known of each shard."""

    splits: dict[tuple[int, int], list]  #: by width and range: nested [axis, at, left, right] or shard number
    of: pd.DataFrame | None = None  #: shard, width, scale, n, most, low, high

    def place(self, group: tuple[int, int], points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int32)
        todo = [(self.splits[group], np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            axis, at, left, right = node
            under = points[rows, axis] < at
            todo += [(left, rows[under]), (right, rows[~under])]
        return out


def _split(points: np.ndarray, shards: int, first: int):
    """A tree with ``shards`` leaves of about equal shares of the sample."""
    if shards == 1 or len(points) < 2:
        return first, 1
    axis = int(np.argmax(points.max(0) - points.min(0)))
    left = shards // 2
    at = np.partition(points[:, axis], len(points) * left // shards)[len(points) * left // shards]
    under = points[:, axis] < at
    if not under.any():
        return first, 1
    a, n = _split(points[under], left, first)
    b, m = _split(points[~under], shards - left, first + n)
    return [axis, float(at), a, b], n + m


def _vectors(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    col = table.column("v")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


FOUND = "row long, query_id long, vec_id long, score double"
_WIDE = "row long, vec_id long, v array<double>, width int, scale int"


@dataclass(frozen=True)
class ProjectionSearch:
    k: int = 20
    dims: int = 24
    sure: float = 0.9
    leaf: int = 64
    shard_rows: int = 25_000
    most_shards: int = 65_536
    sample_rows: int = 50_000
    query_rows: int = 20_000
    held_queries: int = 64
    seed: int = 5

    # -------------------------------------------------------------- cleaning
    def clean(self, vectors: DataFrame) -> DataFrame:
        """vec_id, v: the rows that take part."""
        v = F.col("embedding").cast("array<double>")
        huge = float("inf")
        fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(huge))) & F.exists("v", lambda e: e != 0)
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)

    def _measured(self, rows: DataFrame) -> DataFrame:
        """Rows with a number of their own, their width and range of norms."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                width = np.diff(batch.column("v").offsets.to_numpy())
                scale = np.zeros(len(width), np.int64)
                for w in np.unique(width):
                    at = np.flatnonzero(width == w)
                    scale[at] = range_of(norms_of(_vectors(batch.take(pa.array(at)))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width.astype(np.int32)), pa.array(scale.astype(np.int32))], [*batch.schema.names, "width", "scale"])

        return rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v").mapInArrow(run, _WIDE)

    # -------------------------------------------------------------- indexing
    def directory(self, rows: DataFrame) -> tuple[Directory, int]:
        """Split points of each width and range of norms, from a bounded sample; and the number of shards."""
        sizes = {(r["width"], r["scale"]): r["n"] for r in rows.groupBy("width", "scale").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(sizes.values())
        each = max(self.shard_rows, -(-total // self.most_shards))
        splits, first, points = {}, 0, {}
        if any(n > each for n in sizes.values()):
            sample = rows if total <= self.sample_rows else rows.filter(F.pmod(F.xxhash64("row", "vec_id"), F.lit(1 << 30)) < int((1 << 30) * self.sample_rows / total)).limit(self.sample_rows)
            got: dict[tuple[int, int], list] = {}
            for batch in sample.mapInArrow(self._project(), "width int, scale int, low array<double>").collect():
                got.setdefault((batch["width"], batch["scale"]), []).append(batch["low"])
            points = {g: np.array(p) for g, p in got.items()}
        for g in sorted(sizes):
            splits[g], n = _split(points.get(g, np.zeros((0, self.dims))), -(-sizes[g] // each), first)
            first += n
        return Directory(splits), first

    def _project(self):
        dims, seed = self.dims, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                width, scale = batch.column("width").to_numpy(), batch.column("scale").to_numpy()
                for w in np.unique(width):
                    at = np.flatnonzero(width == w)
                    low = scaled(_vectors(batch.take(pa.array(at))), scale[at]) @ plane_of(int(w), dims, seed)
                    yield pa.RecordBatch.from_arrays([pa.array(width[at]), pa.array(scale[at]), pa.array(list(low), pa.list_(pa.float64()))], ["width", "scale", "low"])

        return run

    def _place(self, directory: Directory):
        dims, seed = self.dims, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                width, scale = batch.column("width").to_numpy(), batch.column("scale").to_numpy()
                shard = np.empty(len(width), np.int32)
                for w, e in {*zip(width.tolist(), scale.tolist(), strict=True)}:
                    at = np.flatnonzero((width == w) & (scale == e))
                    y = scaled(_vectors(batch.take(pa.array(at))), scale[at])
                    shard[at] = directory.place((w, e), y @ plane_of(w, dims, seed))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

        return run

    def _boxes(self):
        dims, seed = self.dims, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                shard = batch.column("shard").to_numpy()
                for s in np.unique(shard).tolist():
                    part = batch.take(pa.array(np.flatnonzero(shard == s)))
                    x, e = _vectors(part), part.column("scale").to_numpy()
                    y = scaled(x, e)
                    low = y @ plane_of(x.shape[1], dims, seed)
                    n, most, a, b = len(x), float((y * y).sum(1).max()), low.min(0), low.max(0)
                    if s in held:
                        _, _, m, top, c, d = held[s]
                        n, most, a, b = n + m, max(most, top), np.minimum(a, c), np.maximum(b, d)
                    held[s] = [x.shape[1], int(e[0]), n, most, a, b]
            if held:
                w, e, n, most, a, b = zip(*held.values(), strict=True)
                lists = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(held), pa.int32()), pa.array(w, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int64()), pa.array(most), pa.array(list(a), lists), pa.array(list(b), lists)],
                    ["shard", "width", "scale", "n", "most", "low", "high"],
                )

        return run

    def index(self, vectors: DataFrame) -> tuple[DataFrame, Directory]:
        """All rows with their shards, as a table in the shared folder, and the directory."""
        rows = materialise(self._measured(self.clean(vectors)), "vectors")
        directory, _ = self.directory(rows)
        placed = materialise(rows.mapInArrow(self._place(directory), _WIDE + ", shard int"), "shards")
        boxes = placed.mapInArrow(self._boxes(), "shard int, width int, scale int, n long, most double, low array<double>, high array<double>")
        axis = lambda c, f: F.array(*[f(F.col(c)[i]) for i in range(self.dims)])
        merged = boxes.groupBy("shard").agg(F.first("width").alias("width"), F.first("scale").alias("scale"), F.sum("n").alias("n"), F.max("most").alias("most"), axis("low", F.min).alias("low"), axis("high", F.max).alias("high"))
        directory.of = pd.DataFrame([r.asDict() for r in merged.collect()], columns=["shard", "width", "scale", "n", "most", "low", "high"]).sort_values("shard")
        return placed, directory

    # ------------------------------------------------------------- searching
    def _route(self, directory: Directory, home: bool):
        """The most promising shard of each query, or all others that the test leaves in."""
        of, dims, seed, k, c = directory.of, self.dims, self.seed, self.k, chi_square_at(self.sure, self.dims)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 256):
                    batch = whole.slice(a, 256)
                    width = batch.column("width").to_numpy()
                    for w in np.unique(width).tolist():
                        part = batch.take(pa.array(np.flatnonzero(width == w)))
                        there = of[of["width"] == w]
                        low, high = np.stack(there["low"]), np.stack(there["high"])
                        most, scale, n = (there[x].to_numpy() for x in ("most", "scale", "n"))
                        q = _vectors(part)
                        length = norms_of(q)
                        low_q = (q / length[:, None]) @ plane_of(w, dims, seed)
                        gap = np.zeros((len(q), len(there)))
                        for i in range(dims):
                            d = np.maximum(np.maximum(low[:, i] - low_q[:, i : i + 1], low_q[:, i : i + 1] - high[:, i]), 0)
                            gap += d * d
                        if home:
                            hope = np.log2(np.maximum(1 + most - gap / dims, 1e-9)) + scale  # of the product, up to a factor
                            hope[:, n <= k] -= 1e9 if (n > k).any() else 0
                            at, to = np.arange(len(q)), np.argmax(hope, 1)
                            kth = np.full(len(q), -np.inf)
                        else:
                            kth = part.column("kth").to_numpy(zero_copy_only=False)
                            with np.errstate(over="ignore", invalid="ignore"):
                                stop = np.where(np.isneginf(kth)[:, None], np.inf, c * (1 - 2 * np.ldexp((kth / length)[:, None], -scale)))
                            left = (gap - c * most < stop) & (there["shard"].to_numpy() != part.column("shard").to_numpy()[:, None])
                            at, to = np.nonzero(left)
                            kth = kth[at]
                        for b in range(0, len(at), 4096):
                            part_at = pa.array(at[b : b + 4096])
                            yield pa.RecordBatch.from_arrays(
                                [*(part.column(x).take(part_at) for x in ("row", "vec_id", "v", "width")), pa.array(there["shard"].to_numpy()[to[b : b + 4096]], pa.int32()), pa.array(kth[b : b + 4096])],
                                ["row", "vec_id", "v", "width", "shard", "kth"],
                            )

        return run

    def _answer(self):
        k, dims, sure, leaf, seed, held = self.k, self.dims, self.sure, self.leaf, self.seed, self.held_queries

        def run(table: pa.Table) -> pa.Table:
            names = ["row", "query_id", "vec_id", "score"]
            asks = table.column("ask").to_numpy().astype(bool)
            own, asked = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if own.num_rows and asked.num_rows:
                own = own.take(pa.array(np.argsort(own.column("row").to_numpy())))  # one tree whatever order rows came in
                x = _vectors(own)
                shard = Shard(own.column("vec_id").to_numpy(), x, own.column("scale")[0].as_py(), plane_of(x.shape[1], dims, seed), sure, leaf)
                row, qid, kth = (asked.column(c).to_numpy() for c in ("row", "vec_id", "kth"))
                q = _vectors(asked)
                step = max(1, min(held, HELD // len(x)))
                for a in range(0, len(q), step):
                    i, names_of, score = shard.search(qid[a : a + step], q[a : a + step], kth[a : a + step], k)
                    out.append((row[a + i], qid[a + i], names_of, score))
            return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

        return run

    def _ask(self, placed: DataFrame, asks: DataFrame) -> DataFrame:
        """Each shard with its queries, at most about ``query_rows`` of them a task."""
        asks = materialise(asks, "asks")
        # one row a shard, so at most most_shards
        needed = asks.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / self.query_rows).cast("int").alias("blocks"))
        stored = placed.join(F.broadcast(needed), "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("ask"), "row", "vec_id", "v", "scale", F.lit(0.0).alias("kth")
        )
        asked = asks.join(F.broadcast(needed), "shard").select(
            "shard", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("ask"), "row", "vec_id", "v", F.lit(0).alias("scale"), "kth"
        )
        return stored.unionByName(asked).groupBy("shard", "block").applyInArrow(self._answer(), FOUND)

    def search(self, vectors: DataFrame, every: int = 20) -> DataFrame:
        """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
        placed, directory = self.index(vectors)
        if not len(directory.of):
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = placed.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "v", "width")
        routed = "row long, vec_id long, v array<double>, width int, shard int, kth double"
        homes = asked.mapInArrow(self._route(directory, True), routed)
        best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        found = self._ask(placed, homes)
        if len(directory.of) > 1:
            homes = materialise(homes.select("row", "vec_id", "v", "width", "shard"), "homes")
            found = materialise(found, "found at home")
            low = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            known = homes.join(low, "row", "left").withColumn("kth", F.when(F.col("n") >= self.k, F.col("least")).otherwise(F.lit(float("-inf")))).drop("n", "least")
            found = found.unionByName(self._ask(placed, known.mapInArrow(self._route(directory, False), routed)))
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= self.k)
        return ranked.select("query_id", "rank", "vec_id", "score")
