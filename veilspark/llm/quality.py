"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of a whole text.  Each feature is cut into
quantile bins and has a lookup table of log-odds; cyclic boosting visits the
features in turn, fits a shallow tree to the gradient over the feature's bins
and adds it, damped, to the table.  The feature pairs that gain most get a
small two-way table each, boosted the same way.  A score is the sum of one
entry per table: bin numbers and additions, vectorised over a block of texts.

Scale: the model is fitted on the driver from at most ``max_train`` labelled
rows, chosen by a hash of doc_id (a bounded sample, so the broadcast of their
ids is bounded too); scoring is one pass over the documents without a shuffle.

Defined results: null text is an empty text; very long texts are measured whole; a score right at a
limit counts as above it; an empty table gives no rows; several labels of a document are
averaged (a half counts as 1); null labels are left out; without rows to learn
from, or with one class only, every score is the share of label 1 (one half if
there is none); repeated rows score alike; other columns are never read, and
labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, gram_hashes, mix, text_blocks, word_hashes, words_of

FEATURES = (
    "bytes", "words", "word_bytes", "word_spread", "longest_word", "upper", "digits", "symbols", "exclaims", "commas", "stops",
    "beyond_ascii", "lines", "repeats", "longest_repeat", "distinct", "distinct_triples", "letters_alone", "marked_words", "bars", "bare_words",
)
_CLASS = np.zeros((9, 256), np.int8)
_CLASS[0, 65:91] = 1  # upper
_CLASS[1, 48:58] = 1  # digits
for _c in b"#$%&*+/<=>@\\^_`{|}~[]":
    _CLASS[2, _c] = 1  # symbols
_CLASS[3, ord("!")] = 1
for _c in b",;:":
    _CLASS[4, _c] = 1
for _c in b".?":
    _CLASS[5, _c] = 1
_CLASS[6, 128:] = 1
_CLASS[7, 10] = 1
_CLASS[8, ord("|")] = 1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[cuts])


def features_of(texts) -> np.ndarray:
    """One row of FEATURES per text."""
    w = words_of(texts)
    n = len(w.offsets) - 1
    size, count = np.diff(w.offsets), w.counts
    some = np.maximum(count, 1)
    chars = np.maximum(size, 1)
    per = {k: _sums(_CLASS[k][w.data], w.offsets) for k in range(9)}
    length = w.end - w.start
    doc = w.doc()
    total, squares = _sums(length, w.first), _sums(length * length, w.first)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    h = word_hashes(w)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(~again, np.arange(len(h)), 0)) if len(h) else np.zeros(0)
    longest_run = np.zeros(n)
    np.maximum.at(longest_run, doc, run)

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        _, first = np.unique(keys ^ mix(of.astype(np.uint64) + np.uint64(1)), return_index=True)
        return np.bincount(of[first], minlength=n)

    triples = gram_hashes(h, 3)
    inside = w.first[1:][doc[: len(triples)]] - np.arange(len(triples)) >= 3
    letters = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_LETTER[w.data], out=letters[1:])
    in_word = letters[w.end] - letters[w.start]
    last = w.data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    mean = total / some
    cols = [
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(squares / some - mean**2, 0)), np.log1p(longest),
        per[0] / chars, per[1] / chars, per[2] / chars, per[3] / some, per[4] / some, per[5] / some, per[6] / chars, per[7] / some,
        _sums(again, w.first) / some, longest_run / some, distinct(h, doc) / some, distinct(triples[inside], doc[: len(triples)][inside]) / np.maximum(count - 2, 1),
        _sums(length == 1, w.first) / some, _sums(~_LETTER[last], w.first) / some, per[8] / some, _sums(in_word == 0, w.first) / some,
    ]
    return np.stack([np.asarray(c, np.float64) for c in cols], 1)


def _stump(g: np.ndarray, h: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """A tree with ``splits`` cuts over ordered bins: the step of each bin."""
    cuts = {0, len(g)}
    for _ in range(splits):
        best, at = 1e-9, None
        edges = sorted(cuts)
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, at = gain[k], a + k + 1
        if at is None:
            break
        cuts.add(at)
    step = np.zeros(len(g))
    edges = sorted(cuts)
    for a, b in zip(edges, edges[1:]):
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _quad(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each of two features: its gain, the step of each cell."""
    best, where = -1.0, (0, 0)
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(g.shape[0] - 1):
        tl, hl = G[i, :-1], H[i, :-1]
        tr, hr = G[i, -1] - tl, H[i, -1] - hl
        bl, hb = G[-1, :-1] - tl, H[-1, :-1] - hl
        br, hd = G[-1, -1] - tl - tr - bl, H[-1, -1] - hl - hr - hb
        gain = tl**2 / (hl + ridge) + tr**2 / (hr + ridge) + bl**2 / (hb + ridge) + br**2 / (hd + ridge)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, where = float(gain[k]), (i + 1, k + 1)
    i, j = where
    step = np.zeros_like(g)
    for a in (slice(0, i), slice(i, None)):
        for b in (slice(0, j), slice(j, None)):
            step[a, b] = -g[a, b].sum() / (h[a, b].sum() + ridge)
    return best, step


@dataclass
class AdditiveModel:
    """Lookup tables: ``base`` plus one entry per feature and per chosen pair."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cuts, x[:, k], side="right")]
        for i, j, table in self.pairs:
            z += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 1.0) -> AdditiveModel:
    n = len(y)
    if not n:
        return AdditiveModel()
    share = float(np.mean(y))
    model = AdditiveModel(float(np.clip(np.log(max(share, 1e-12) / max(1 - share, 1e-12)), -30, 30)))
    if share in (0.0, 1.0):
        return model
    quantiles = lambda k, m: np.unique(np.quantile(x[:, k], np.linspace(0, 1, m + 1)[1:-1], method="lower"))
    model.cuts = [quantiles(k, bins) for k in range(x.shape[1])]
    model.coarse = [quantiles(k, pair_bins) for k in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.coarse)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(n, model.base)
    odds = lambda: 1 / (1 + np.exp(-z))
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            p = odds()
            step = rate * _stump(np.bincount(at[k], p - y, len(table)), np.bincount(at[k], p * (1 - p), len(table)), 3, ridge)
            table += step
            z += step[at[k]]
    p = odds()
    found = []
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def grid(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = shape(i, j)
        cell = rough[i] * s[1] + rough[j]
        return tuple(np.bincount(cell, v, s[0] * s[1]).reshape(s) for v in (p - y, p * (1 - p)))

    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            if min(shape(i, j)) > 1:
                found.append((_quad(*grid(i, j, p), ridge)[0], i, j))
    model.pairs = [(i, j, np.zeros(shape(i, j))) for _, i, j in sorted(found, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * _quad(*grid(i, j, odds()), ridge)[1]
            table += step
            z += step[rough[i], rough[j]]
    return model


def _features_with_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch):
            x = features_of(block.column("text"))
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("label"), flat], ["doc_id", "label", "x"])


def _score(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(model.score(features_of(block.column("text"))))], ["doc_id", "score"])

    return run


def _keep(model: AdditiveModel, text: int, least: float):
    """Passes on the rows of blocks whose score is at least ``least``; ``text`` is the number of that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for block in text_blocks(numbered, str(text)):
                good = model.score(features_of(block.column(text))) >= least
                yield block.filter(pa.array(good)).rename_columns(batch.schema.names)

    return run


@dataclass(frozen=True)
class QualityClassifier:
    """``max_train``: the most labelled rows that the model is fitted on."""

    max_train: int = 20_000

    def train(self, docs: DataFrame, labels: DataFrame) -> AdditiveModel:
        """docs: doc_id, text; labels: doc_id, label (1 is good)."""
        known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.max_train)
        rows = bound_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_features_with_label, "doc_id long, label int, x array<double>")
        got = sorted(((r["doc_id"], r["label"], r["x"]) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.max_train).collect()), key=lambda r: (r[0], r[2]))
        if not got:
            return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
        return fit(np.array([r[2] for r in got]), np.array([r[1] for r in got], float))

    def score(self, docs: DataFrame, model: AdditiveModel) -> DataFrame:
        """doc_id, score of every row."""
        return bound_batches(docs).select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")

    def keep(self, docs: DataFrame, model: AdditiveModel, least: float = 0.5) -> DataFrame:
        """The rows whose score is at least ``least``, with all their columns."""
        return bound_batches(docs).mapInArrow(_keep(model, docs.columns.index("text"), least), docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null doc_id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
