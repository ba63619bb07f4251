"""Language-model scoring with a log-bilinear neural model.

Tokens are lower-cased words and one end a text.  The most frequent tokens are
classes of their own; every other word belongs to the class of its last bytes
(its bin), within which it has its smoothed share of the training tokens:

    p(word | before) = p(class | classes before) * p(word | class)

The class model mixes several positions of the context.  Each position has a
log-bilinear model of its own: the vector of the class that stands there, through the
position's matrix, times the vector of the next, plus a bias.  It is trained in numpy by
noise-contrastive estimation on the class pairs at that distance in all training
documents, weighted by their counts (noise: the class shares), and normalised exactly:
batched matrix products give all scores after each class, their log-sum-exp the
constant.  The positions, and the plain class shares, are added with weights that
depend on how frequent the class before is, found by expectation maximisation over all
training tokens.  So the probabilities of all words after any context sum to one: a
class's words not seen in training share one more place in it, as in the baseline.

Both numbers of classes grow with the input: with T distinct training words,
those at a frequency floor that leaves at most ``per_root`` sqrt(T) of them (and
the ``words`` most frequent in any case) have their own class, and there are
about sqrt(T) bins (a power of two from 256 to 65,536) of two to three last
bytes.  So the classes squared, the cost of the constants, grow as T does.

Scale: counts of all words live in hash buckets and are never gathered; a
cell of documents asks the buckets for the counts of its distinct words and
gets them back aligned.  Class pairs are counted in parts and stored; each position is trained in
one task, which reads the parts one after the other in each pass, so its memory is a part and the model, and its
time grows with the distinct pairs: training uses as many cores as there are positions, at every size.
Only the classes, the bins' totals and the models come to
the driver.  The constants are a task for each block of classes.  Tasks combine before they
shuffle, so a word that all documents hold is sent once a task.

Defined results: null text is an empty text (one end); a null doc_id counts as
the empty text for the choice of training rows; very long texts are scored whole; repeated rows are scored (and
learned from) each; ties in frequency go to the smaller key; an empty table gives no rows; other columns are never
read.  Words are compared by 48-bit hashes and their last three bytes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CELL_BYTES, bound_batches, bucket_cuts, cell_of, cells_for, joined, materialise, mix, one_thread, pack, power_of_two, qualified, shared_dir, text_blocks, word_hashes, words_in

LEAST_BINS, MOST_BINS = 256, 65536
END = np.uint64((1 << 64) - 1)
_SUFFIX = np.random.default_rng(3).integers(0, 256, 65536, dtype=np.uint64)
_THIRD = np.random.default_rng(4).integers(0, 256, 65536, dtype=np.uint64)


#: Text bytes whose tokens are found at once, so that the numbers kept for each byte stay in the processor's cache.
PIECE_BYTES = 96 << 10


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """A key for each token, ends too, and where each text's tokens begin (one more at the end).

    The low bits of a key, 8 to 16 of them, are the word's bin: the low byte
    stands for its last two bytes, the next for the third.
    """
    data, offsets = joined(texts)
    cuts = [0, *(np.flatnonzero(np.diff(offsets[:-1] // PIECE_BYTES)) + 1).tolist(), len(offsets) - 1]
    parts = [_tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in zip(cuts, cuts[1:])]
    starts = np.zeros(len(offsets), np.int64)
    np.cumsum(np.concatenate([n for _, n in parts]), out=starts[1:])
    return np.concatenate([k for k, _ in parts]), starts


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some texts' tokens and how many each text has."""
    w = words_in(data, offsets)
    data = data + ((data - np.uint8(65) < 26) * np.uint8(32))
    h = word_hashes(w, data)
    if len(h):
        last = data[w.end - 1].astype(np.int64)
        other = np.where(w.end - w.start > 1, data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
        third = np.where(w.end - w.start > 2, data[np.maximum(w.end - 3, 0)], 0).astype(np.int64)
        low = _SUFFIX[last << 8 | other]
        h = h & ~np.uint64(65535) | _THIRD[third << 8 | low.astype(np.int64)] << np.uint64(8) | low
        h[h == END] -= np.uint64(65536)
    n = len(w.first) - 1
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + w.doc()] = h
    return out, w.counts + 1


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


# ----------------------------------------------------------------- counting
def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not any(len(k) for k, _ in parts):
        return parts[0] if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")  # which merges what is in order already
    keys = keys.take(order)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys.take(first), np.add.reduceat(np.concatenate([c for _, c in parts]).take(order), first)


class Tally:
    """Sorted keys with their counts, of parts that are merged once those not yet merged outweigh the others."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> bool:
        """Whether this led to a merge."""
        self.parts.append(np.unique(keys, return_counts=True))
        due = len(self.parts) >= 8 and sum(len(k) for k, _ in self.parts[1:]) > len(self.parts[0][0])
        if due:
            self.parts = [_merge(self.parts)]
        return due

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts = self.parts, []
        return _merge(parts)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for block in text_blocks(batch):
                tally.add(tokens_of(block.column("text"))[0])
        keys, counts = tally.take()
        buckets, cuts = bucket_cuts(keys, bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets), *(pa.array([pack(v[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()) for v in (keys, counts))], ["bucket", "keys", "counts"]
        )

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    """All tokens of a bucket with their counts."""
    keys, counts = _merge([(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)])
    return pa.table({"keys": pa.array([pack(keys)], pa.binary()), "counts": pa.array([pack(counts)], pa.binary())})


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for k, c in zip(batch.column("keys"), batch.column("counts"), strict=True):
            yield np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of their eight leading bits: some 7,000 levels, in the order of the counts."""
    shift = np.maximum(np.frexp(counts.astype(float))[1] - 8, 0)
    return shift * 128 + (counts >> shift)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, counts in _buckets(batches):
        level, n = np.unique(level_of(counts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n)], ["level", "n"])


def _bin_totals(bins: int):
    """The tokens and types of each bin in each bucket, and the ends as bin -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _buckets(batches):
            bin_, where = np.unique(np.where(keys == END, -1, (keys & np.uint64(bins - 1)).astype(np.int64)), return_inverse=True)
            total = np.bincount(where, counts, len(bin_)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(total), pa.array(np.bincount(where, minlength=len(bin_)))], ["bin", "n", "types"])

    return run


def _frequent(floor: int, words: int):
    """The tokens of each bucket at the level ``floor``, or among its ``words`` most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _buckets(batches):
            take = level_of(counts) >= floor
            take[np.lexsort((keys, -counts))[:words]] = True
            yield pa.RecordBatch.from_arrays([pa.array([pack(v[take])], pa.binary()) for v in (keys, counts)], ["keys", "counts"])

    return run


def places(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where each of ``found`` stands among the sorted distinct ``keys``, -1 if nowhere.

    Keys are hashes: their leading bits tell the place up to a few others.
    """
    bits = power_of_two(4 * len(keys))
    shift = np.uint64(64 - bits)
    first = np.zeros((1 << bits) + 1, np.int32)
    np.cumsum(np.bincount((keys >> shift).astype(np.int64), minlength=1 << bits), out=first[1:])
    slot = (found >> shift).astype(np.int64)
    at = first[slot]
    out = np.where(keys[np.minimum(at, len(keys) - 1)] == found, at, np.int32(-1)).astype(np.int64)
    left = np.flatnonzero((out < 0) & (first[slot + 1] - at > 1))
    ends = first[slot[left] + 1]
    at = at[left] + 1
    while len(left):
        hit = keys[at] == found[left]
        out[left[hit]] = at[hit]
        go = ~hit & (at + 1 < ends)
        left, ends, at = left[go], ends[go], at[go] + 1
    return out


@dataclass
class Vocabulary:
    keys: np.ndarray  #: sorted keys of the tokens with a class of their own
    tokens: int  #: all training tokens
    types: int
    in_bin: np.ndarray  #: tokens and types of each bin without those in ``keys``
    bin_types: np.ndarray
    own: np.ndarray  #: the counts of ``keys``

    @property
    def classes(self) -> int:
        return len(self.keys) + len(self.in_bin)

    def class_of(self, keys: np.ndarray) -> np.ndarray:
        at = places(self.keys, keys)
        return np.where(at >= 0, at, len(self.keys) + (keys & np.uint64(len(self.in_bin) - 1)).astype(np.int64))

    @property
    def end(self) -> int:
        return len(self.keys) - 1

    @property
    def counts(self) -> np.ndarray:
        """Training tokens of each class."""
        return np.concatenate([self.own, self.in_bin])

    def contexts(self, cls: np.ndarray, starts: np.ndarray, positions: int) -> list[np.ndarray]:
        """The classes 1, 2, ... places before each token; before a text's begin stand ends."""
        out = []
        for j in range(1, positions + 1):
            before = np.roll(cls, j)
            for i in range(j):
                at = starts[:-1] + i
                before[at[at < starts[1:]]] = self.end
            out.append(before)
        return out


#: Distinct pairs that a task holds before it sends them on.
HELD_PAIRS = 2_000_000


def _pairs(vocabulary: Vocabulary, parts: int, positions: int):
    """Class pairs of a task at each distance, as steps of codes and counts in ``parts``."""

    def send(j: int, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (mix(codes.astype(np.uint64)) % np.uint64(parts)).astype(np.min_scalar_type(parts))  # the fewer bytes, the faster sorted
        order = np.argsort(part, kind="stable")
        part, codes, counts = part[order], codes[order], counts[order]
        cuts = np.append(np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1)), len(part))
        spans = list(zip(cuts, cuts[1:]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(spans), j, np.int32)),
                pa.array(part[cuts[:-1]].astype(np.int32)),
                pa.array([press(np.diff(codes[a:b], prepend=0)) for a, b in spans], pa.binary()),
                pa.array([press(counts[a:b]) for a, b in spans], pa.binary()),
            ],
            ["position", "part", "codes", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Tally() for _ in range(positions)]
        for batch in batches:
            for block in text_blocks(batch):
                keys, starts = tokens_of(block.column("text"))
                cls = vocabulary.class_of(keys)
                for j, before in enumerate(vocabulary.contexts(cls, starts, positions)):
                    if found[j].add(before * vocabulary.classes + cls) and len(found[j].parts[0][0]) * positions > HELD_PAIRS:
                        yield send(j, *found[j].take())
        for j, own in enumerate(found):
            if own.parts:
                yield send(j, *own.take())

    return run


def press(a: np.ndarray) -> bytes:
    """Numbers that are not negative, in as few bytes each as the largest needs, compressed; their size and number lead."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * w or w == 8)
    raw = a.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpress(b: bytes) -> np.ndarray:
    raw = pa.decompress(b[9:], int.from_bytes(b[1:9], "little"), "zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{b[0]}").astype(np.int64)


def _sum_pairs(groups: int):
    def run(table: pa.Table) -> pa.Table:
        codes, counts = _merge([(np.cumsum(unpress(k)), unpress(c)) for k, c in zip(table.column("codes").to_pylist(), table.column("counts").to_pylist(), strict=True)])
        place = table.column("part")[0].as_py() % groups
        return pa.table({
            "position": table.column("position").slice(0, 1), "place": pa.array([place], pa.int32()), "n": pa.array([len(codes)], pa.int64()),
            "codes": pa.array([press(np.diff(codes, prepend=0))], pa.binary()), "counts": pa.array([press(counts)], pa.binary()),
        })

    return run


PAIRS = "position int, place int, n long, codes binary, counts binary"


@dataclass
class StoredPairs:
    """Pairs of one position in some places of their table, read a file at a time whenever they are gone through."""

    base: str
    position: int
    places: list[int]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        files, root = fs.FileSystem.from_uri(self.base)
        for place in self.places:
            where = f"{root}/position={self.position}/place={place}"
            if files.get_file_info(where).type != fs.FileType.Directory:
                continue
            for info in files.get_file_info(fs.FileSelector(where)):
                if not info.path.endswith(".parquet"):
                    continue
                for batch in pq.ParquetFile(files.open_input_file(info.path)).iter_batches(batch_size=1, columns=["codes", "counts"]):
                    for k, c in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                        yield np.cumsum(unpress(k)), unpress(c)


# ------------------------------------------------------------------ training
LEAST_SQUARE = 1e-6
#: Numbers in one row of a model on its way to the driver.
ROW = 65_536


def log_sums(reach: np.ndarray, target: np.ndarray, bias: np.ndarray, rows: int = 128, columns: int = 1024) -> np.ndarray:
    """The log-sum-exp of the scores after each row of ``reach``, by tiles that stay in the processor's cache."""
    out = np.empty(len(reach))
    for a in range(0, len(reach), rows):
        part = reach[a : a + rows]
        top, total = np.full((len(part), 1), -np.inf, np.float32), np.zeros(len(part))
        for b in range(0, len(bias), columns):
            s = part @ target[b : b + columns].T
            s += bias[b : b + columns]
            before, top = top, np.maximum(top, s.max(1, keepdims=True))
            s -= top
            total *= np.exp(before - top)[:, 0]
            total += np.exp(s, out=s).sum(1, dtype=np.float64)
        out[a : a + rows] = top[:, 0] + np.log(total)
    return out


@dataclass
class LogBilinear:
    context: np.ndarray  #: [classes, dims]
    turn: np.ndarray  #: [dims, dims]
    target: np.ndarray  #: [classes, dims]
    bias: np.ndarray  #: [classes]

    def sums(self, a: int, b: int) -> np.ndarray:
        """The log-sum-exp of all scores after each of the classes a:b."""
        return log_sums(self.context[a:b] @ self.turn, self.target, self.bias)

    def table(self) -> np.ndarray:
        """log10 p(class | class before), normalised."""
        s = self.context @ self.turn @ self.target.T + self.bias
        return (s - self.sums(0, len(s))[:, None]) / np.log(10)


def constants(spark: SparkSession, models: list[Scorer]) -> list[np.ndarray]:
    """``sums`` of all classes of each model, a block of them at a time, in tasks."""
    k = len(models[0].bias)
    rows = max(1, 4_000_000 // k)
    blocks = -(-k // rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for i in batch.column(0).to_pylist():
                model, a = models[i // blocks], i % blocks * rows
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pack(model.sums(a, a + rows))], pa.binary())], ["block", "sums"])

    n = blocks * len(models)
    tasks = max(1, min(n, len(models) * k * k // 200_000_000))
    found = sorted(spark.range(0, n, 1, tasks).mapInArrow(run, "block long, sums binary").collect())
    return [np.frombuffer(b"".join(r["sums"] for r in found[a : a + blocks]), np.float64) for a in range(0, n, blocks)]


def _totals(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of ``first`` up to the next.

    ``reduceat`` takes long for each sum, however few its rows: most are of one or two, and made here.
    """
    n = np.diff(first, append=len(rows))
    out = rows.take(first, 0)
    two = np.flatnonzero(n == 2)
    out[two] += rows.take(first[two] + 1, 0)
    more = n > 2
    if more.any():
        size = n[more]
        begin = np.cumsum(size) - size
        out[more] = np.add.reduceat(rows.take(np.repeat(first[more] - begin, size) + np.arange(begin[-1] + size[-1]), 0), begin, axis=0)
    return out


def _move(values: np.ndarray, sums: np.ndarray, at: np.ndarray, rows: np.ndarray, rate: float) -> None:
    """An Adagrad step of values[at] against ``rows``."""
    grown = sums.take(at, 0)
    grown += rows * rows
    sums[at] = grown
    step = rate * rows
    step /= np.sqrt(grown, out=grown)
    values[at] = np.subtract(values.take(at, 0), step, out=step)


def _batches(codes: np.ndarray, counts: np.ndarray, mean: float, batch: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs once, in batches of mixed order, with weights that add up to their counts over ``mean``.

    A pair counted more often than twice the mean comes in pieces, none above
    that, which are spread over the batches.
    """
    times = np.ceil(counts / (2 * mean)).astype(np.int64)
    which = rng.permutation(np.repeat(np.arange(len(codes), dtype=np.int32 if len(codes) < 1 << 31 else np.int64), times))
    weight = (counts / times / mean).astype(np.float32)
    for a in range(0, len(which), batch):
        at = np.sort(which[a : a + batch])
        yield codes.take(at), weight.take(at)


def start(share: np.ndarray, dims: int, seed: int) -> LogBilinear:
    """A model that has learned nothing but the class shares."""
    rng, classes = np.random.default_rng(seed), len(share)
    return LogBilinear(rng.normal(0, 0.1, (classes, dims)).astype(np.float32), np.eye(dims, dtype=np.float32), rng.normal(0, 0.1, (classes, dims)).astype(np.float32), np.log(share).astype(np.float32))


def shares(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.1) / (counts + 0.1).sum()


def train(codes: np.ndarray, counts: np.ndarray, classes: int, **options) -> LogBilinear:
    """``learn`` from class pairs at hand, from the start."""
    share = shares(np.bincount(codes % classes, counts, classes))
    m = start(share, 24, 2)
    return learn(m, {k: np.full_like(v, LEAST_SQUARE) for k, v in vars(m).items()}, [(codes, counts)], share, **options)


def learn(m: LogBilinear, sums: dict[str, np.ndarray], chunks: Iterable[tuple[np.ndarray, np.ndarray]], share: np.ndarray, noise: int = 64, batch: int = 8192, steps: int = 1000, passes: int = 2, rate: float = 0.08, seed: int = 2) -> LogBilinear:
    """Noise-contrastive estimation on all given class pairs, weighted by their counts.

    ``chunks`` are sorted codes and counts, read anew in each pass.  There are at least ``passes`` passes over all pairs, and as many more as make
    ``steps`` steps, so steps grow with the number of distinct pairs.  A pair
    is told from ``noise`` classes drawn by ``share``, once for all pairs of
    a batch that have the same class before; the model's score stands for a
    normalised log-probability.  Steps are scaled by Adagrad, whose ``sums`` go on
    where they are.  ``m`` is changed in place.
    """
    rng, classes = np.random.default_rng(seed), len(share)
    noise_reach = np.cumsum(share)
    offset = np.log(noise * share).astype(np.float32)
    done = turn = 0
    while turn < passes or 0 < done < steps:
        turn += 1
        for pair, weight in (b for codes, counts in chunks if len(codes) for b in _batches(codes, counts, counts.sum() / len(codes), batch, rng)):
            done += 1
            u, w = np.divmod(pair, classes)
            x = np.minimum(np.searchsorted(noise_reach, rng.random(noise) * noise_reach[-1], side="right"), classes - 1)
            weight = weight / weight.sum()
            first = np.flatnonzero(np.diff(u, prepend=-1))
            own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
            u = u[first]
            e = m.context.take(u, 0)
            q = e @ m.turn
            q_own, t_own, t_noise = q.take(own, 0), m.target.take(w, 0), m.target.take(x, 0)
            true = np.einsum("ij,ij->i", q_own, t_own) + (m.bias[w] - offset[w])
            false = q @ t_noise.T
            false += m.bias[x] - offset[x]
            g = weight * (1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1)
            f = np.clip(false, -30, 30, out=false)
            np.exp(np.negative(f, out=f), out=f)
            f += 1
            np.divide(np.add.reduceat(weight, first)[:, None], f, out=f)
            t_own *= g[:, None]
            dq = _totals(t_own, first) + f @ t_noise
            q_own *= g[:, None]
            at = np.concatenate([w, x])
            at = np.sort(at << 32 | np.arange(len(at)))
            order, at = at & 0xFFFFFFFF, at >> 32
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            at = at[begin]
            d_turn = e.T @ dq
            _move(m.target, sums["target"], at, _totals(np.concatenate([q_own, f.T @ q]).take(order, 0), begin), rate)
            _move(m.bias, sums["bias"], at, np.add.reduceat(np.concatenate([g, f.sum(0)]).take(order), begin), rate)
            _move(m.context, sums["context"], u, dq @ m.turn.T, rate)
            sums["turn"] += d_turn * d_turn
            m.turn -= rate * d_turn / np.sqrt(sums["turn"])
    return m


PIECES = "position int, name string, row int, numbers binary"


def _learn(base: str, groups: int, share: np.ndarray, dims: int, steps: int, passes: int):
    """The models of positions, each in rows of ``ROW`` numbers.

    A position is one sequence of steps over all its pairs, however many they are: the mean of models that each
    saw a part of the pairs is a far worse one.  The nearest position takes one pass more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for j in (i for batch in batches for i in batch.column(0).to_pylist()):
            model = start(share, dims, 2 + j)
            sums = {k: np.full_like(v, LEAST_SQUARE) for k, v in vars(model).items()}
            places = np.random.default_rng(j).permutation(groups).tolist()
            learn(model, sums, StoredPairs(base, j, places), share, seed=2 + j, steps=steps, passes=passes + (j == 0))
            for k, v in vars(model).items():
                for i, a in enumerate(range(0, v.size, ROW)):
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([k]), pa.array([i], pa.int32()), pa.array([pack(v.ravel()[a : a + ROW])], pa.binary())], ["position", "name", "row", "numbers"])

    return run


def _shaped(name: str, flat: np.ndarray, classes: int, dims: int) -> np.ndarray:
    return flat if name == "bias" else flat.reshape(dims if name == "turn" else classes, dims)


# ------------------------------------------------------------------- mixture
BANDS = 24


@dataclass
class Scorer:
    """What scoring needs of a trained model."""

    reach: np.ndarray  #: [classes, dims]: the vectors of the class before, through the position's matrix
    target: np.ndarray
    bias: np.ndarray

    def sums(self, a: int, b: int) -> np.ndarray:
        return log_sums(self.reach[a:b], self.target, self.bias)


@dataclass
class Mixture:
    """A model for each position, with their constants, and the weights of all."""

    models: list[Scorer]
    sums: list[np.ndarray]
    share: np.ndarray  #: [classes]
    band: np.ndarray  #: [classes]: which weights hold after a class
    weights: np.ndarray  #: [BANDS, 1 + positions]: of the shares and of each position

    def chances(self, before: list[np.ndarray], now: np.ndarray) -> np.ndarray:
        """p(now) by the shares and by each position, [1 + positions, n]."""
        out = np.empty((1 + len(self.models), len(now)))
        out[0] = self.share[now]
        for j, (m, sums) in enumerate(zip(self.models, self.sums, strict=True)):
            for a in range(0, len(now), 1 << 14):
                u, w = before[j][a : a + (1 << 14)], now[a : a + (1 << 14)]
                out[1 + j, a : a + (1 << 14)] = np.einsum("ij,ij->i", m.reach.take(u, 0), m.target.take(w, 0)) + m.bias[w] - sums[u]
        np.exp(out[1:], out=out[1:])
        return out

    def log10(self, before: list[np.ndarray], now: np.ndarray) -> np.ndarray:
        """log10 p(class now | classes before)."""
        return np.log10(np.einsum("in,ni->n", self.chances(before, now), self.weights[self.band[before[0]]]))

    def table(self, before: list[int]) -> np.ndarray:
        """p of every class after one context."""
        k = len(self.share)
        return 10.0 ** self.log10([np.full(k, b) for b in before], np.arange(k))


def bands_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(float))[1], BANDS - 1)


def _expect(mixture: Mixture, v: Vocabulary):
    """How much of the training tokens each part of the mixture accounts for, by band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weights = np.zeros_like(mixture.weights), mixture.weights.copy()
        n = len(mixture.models)
        for batch in batches:
            for block in text_blocks(batch):
                tokens, starts = tokens_of(block.column("text"))
                cls = v.class_of(tokens)
                before = v.contexts(cls, starts, n)
                p, band = mixture.chances(before, cls), mixture.band[before[0]]
                for _ in range(3):  # steps within the block, which begin with all seen so far
                    r = p * weights.T.take(band, 1)
                    r /= r.sum(0)
                    here = np.stack([np.bincount(band, x, BANDS) for x in r], 1)
                    weights = total + here + 1.0
                    weights /= weights.sum(1, keepdims=True)
                total += here
        yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], ["total"])

    return run


# ------------------------------------------------------------------- scoring
def _ask(bits: int):
    """A cell's distinct tokens by bucket, with their counts in its training rows."""

    def run(table: pa.Table) -> pa.Table:
        tokens, starts = tokens_of(table.column("text"))
        keys, _ = np.unique(tokens, return_counts=True)
        learned, times = np.unique(tokens[np.repeat(table.column("learn").to_numpy() > 0, np.diff(starts))], return_counts=True)
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, learned)] = times
        buckets, cuts = bucket_cuts(keys, bits)
        cell = table.column("cell")[0].as_py()
        return pa.table({
            "bucket": pa.array(buckets),
            "cell": pa.array([cell] * len(buckets), pa.int32()),
            "keys": pa.array([pack(keys[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
            "counts": pa.array([pack(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
        })

    return run


def _answer(table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()]
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, counts).astype(np.int64)[where]
    ends = np.cumsum([len(k) for k in keys])
    return pa.table({"cell": table.column("cell"), "bucket": table.column("bucket"), "counts": pa.array([pack(total[e - len(k) : e]) for e, k in zip(ends, keys, strict=True)], pa.binary())})


def _score(mixture: Mixture, v: Vocabulary):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("bucket").to_numpy())
        blocks = answers.column("counts").to_pylist()
        counts = np.frombuffer(b"".join(blocks[i] for i in order.tolist()), np.int64)
        tokens, starts = tokens_of(docs.column("text"))
        keys, _ = np.unique(tokens, return_counts=True)
        where = places(keys, tokens)
        cls = v.class_of(keys)
        own = cls < len(v.keys)
        bins = np.where(own, 0, cls - len(v.keys))
        within = np.where(own, 0.0, np.log10((counts + 0.1) / (v.in_bin[bins] + 0.1 * (v.bin_types[bins] + 1))))
        base = np.log10((counts + 0.1) / (v.tokens + 0.1 * (v.types + 1)))
        now = cls[where]
        each = mixture.log10(v.contexts(now, starts, len(mixture.models)), now) + within[where]
        n = docs.num_rows
        at = starts[:-1]
        known = np.add.reduceat((counts > 0)[where].astype(np.int64), at) if n else np.zeros(0, np.int64)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(np.diff(starts)), "n_known": pa.array(known),
            "train_tokens": pa.array([v.tokens] * n, pa.int64()), "base_score": np.add.reduceat(base[where], at) if n else np.zeros(0), "score": np.add.reduceat(each, at) if n else np.zeros(0),
        })

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class LanguageModel:
    """At least ``words`` tokens have a class of their own, and up to ``per_root`` times the root of the number of distinct words.

    A position is trained in at least ``passes`` passes (the nearest: one more) and ``steps`` steps.
    """

    words: int = 767
    per_root: int = 32
    positions: int = 3
    dims: int = 24
    passes: int = 1
    steps: int = 1000

    def vocabulary(self, learn: DataFrame, bits: int) -> Vocabulary:
        counted = learn.select("text").mapInArrow(_count(bits), "bucket long, keys binary, counts binary")
        counted = materialise(counted.groupBy("bucket").applyInArrow(_sum_counts, "keys binary, counts binary"), "counts")
        levels = sorted(map(tuple, counted.select("keys", "counts").mapInArrow(_levels, "level long, n long").groupBy("level").agg(F.sum("n")).collect()), reverse=True)
        root = math.isqrt(sum(n for _, n in levels))
        floor, room = math.inf, max(self.words, self.per_root * root)
        for level, n in levels:
            room -= n
            if room < 0:
                break
            floor = level
        bins = min(MOST_BINS, max(LEAST_BINS, 1 << power_of_two(root)))
        totals = counted.mapInArrow(_bin_totals(bins), "bin long, n long, types long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
        found = counted.mapInArrow(_frequent(floor, self.words), "keys binary, counts binary").collect()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in found] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in found] or [np.zeros(0, np.int64)])
        take = level_of(counts) >= floor
        take[np.lexsort((keys, -counts))[: self.words]] = True
        keys, counts = keys[take], counts[take]
        ends = sum(r["n"] for r in totals if r["bin"] < 0)
        in_bin, types = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for r in totals:
            if r["bin"] >= 0:
                in_bin[r["bin"]], types[r["bin"]] = r["n"], r["types"]
        tokens, all_types = int(in_bin.sum() + ends), int(types.sum() + (ends > 0))
        own = (keys[keys != END] & np.uint64(bins - 1)).astype(np.int64)
        in_bin -= np.bincount(own, counts[keys != END], bins).astype(np.int64)
        types -= np.bincount(own, minlength=bins)
        all_ = np.union1d(keys, np.array([END]))
        count = np.zeros(len(all_), np.int64)
        count[np.searchsorted(all_, keys)] = counts
        count[-1] = ends
        return Vocabulary(all_, tokens, all_types, in_bin, types, count)

    def models(self, pairs: str, groups: int, v: Vocabulary, spark: SparkSession) -> list[Scorer]:
        """A model for each position, from the class pairs stored at ``pairs`` in ``groups`` places."""
        share = shares(v.counts)
        base = qualified(spark, pairs)
        learn_ = _learn(base, groups, share, self.dims, self.steps, self.passes)
        rows = spark.range(0, self.positions, 1, self.positions).mapInArrow(learn_, PIECES).collect()  # the models, which the driver holds in any case
        got: dict[tuple[int, str], dict[int, bytes]] = {}
        while rows:
            r = rows.pop()
            got.setdefault((r["position"], r["name"]), {})[r["row"]] = bytes(r["numbers"])
        models: list[dict[str, np.ndarray]] = [{} for _ in range(self.positions)]
        for j, name in list(got):
            parts = got.pop((j, name))
            models[j][name] = _shaped(name, np.frombuffer(b"".join(parts[i] for i in sorted(parts)), np.float32), v.classes, self.dims)
        return [Scorer(m["context"] @ m["turn"], m["target"], m["bias"]) for m in models]

    def fit(self, docs: DataFrame) -> tuple[Mixture, Vocabulary]:
        """docs: text, learn (boolean)."""
        rows = docs.filter("learn")
        bits = power_of_two(cells_for(docs) / 8)
        v = self.vocabulary(rows, bits)
        spark, groups = docs.sparkSession, min(4096, 2 << bits)
        found = rows.select("text").mapInArrow(_pairs(v, 2 << bits, self.positions), "position int, part int, codes binary, counts binary")
        summed = found.groupBy("position", "part").applyInArrow(_sum_pairs(groups), PAIRS)
        pairs = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
        summed.write.partitionBy("position", "place").parquet(pairs)
        models = self.models(pairs, groups, v, spark)
        even = np.full((BANDS, 1 + self.positions), 1 / (1 + self.positions))
        mixture = Mixture(models, constants(docs.sparkSession, models), shares(v.counts), bands_of(v.counts), even)
        totals = even + sum(np.frombuffer(r["total"]).reshape(even.shape) for r in rows.select("text").mapInArrow(_expect(mixture, v), "total binary").collect())
        mixture.weights = totals / totals.sum(1, keepdims=True)
        return mixture, v

    def score(self, docs: DataFrame) -> DataFrame:
        """Scores of all rows, learned from those that are not held out."""
        held = is_held_out(F.col("doc_id")).alias("held_out")
        rows = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held)
        mixture, v = self.fit(rows.select("text", (~F.col("held_out")).alias("learn")))
        cells = cells_for(docs, CELL_BYTES // 2)  # a cell's tokens take some fifty times its text for a while
        keyed = rows.select(cell_of(F.coalesce(F.col("doc_id"), F.xxhash64("text")), cells).alias("cell"), "doc_id", "text", "held_out", (~F.col("held_out")).cast("int").alias("learn"))
        by_cell = keyed.groupBy("cell")
        asked = by_cell.applyInArrow(_ask(power_of_two(cells / 8)), "bucket long, cell int, keys binary, counts binary")
        answers = asked.groupBy("bucket").applyInArrow(_answer, "cell int, bucket long, counts binary")
        return by_cell.cogroup(answers.groupBy("cell")).applyInArrow(_score(mixture, v), SCORES)
