"""Shared plumbing: shared-folder tables, size estimates and word arithmetic.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``.  They
are found and hashed for a whole block of texts at once with numpy, so no
Python loop runs per word.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker, sent to it at once, and in a cell.
BLOCK_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
CELL_BYTES = 4 << 20

LEAST_CELLS = 64
LONG_WORD = 64

WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


# ------------------------------------------------------------------ storage
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine (a local master)
    gets a temporary folder, made once in this process; on a cluster that
    would be another folder on each machine, so it is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="veilspark-")
    return where.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as Hadoop resolves it, for readers outside the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding this session's Arrow batches by bytes.

    By default a batch is bounded by its number of rows, and ten thousand long
    texts take more memory than an executor leaves its Python workers.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; file sizes for a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cells_for(df: DataFrame, cell_bytes: int = CELL_BYTES) -> int:
    """How many hash cells keep one cell of documents near ``cell_bytes`` of text.

    It follows the input (parquet counted as half its text); small inputs still
    get ``LEAST_CELLS`` so that they spread.
    """
    return max(LEAST_CELLS, min(1 << 26, -(-2 * plan_bytes(df) // cell_bytes)))


def power_of_two(n: float) -> int:
    """The exponent of the least power of two that is at least ``n``."""
    return max(1, int(np.ceil(np.log2(max(n, 2)))))


def cell_of(column, cells: int):
    return F.pmod(F.xxhash64(column), F.lit(cells)).cast("int")


def one_thread() -> None:
    """Keep numpy's OpenBLAS in this worker to one thread: tasks share the cores already, and small products wait for each other.

    The library is asked by its own setting function; where there is none, nothing changes.
    """
    import ctypes
    import glob
    import os

    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


@functools.cache
def _trim():
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Give the memory that this worker has freed back to the machine: workers are kept for other tasks, and what they hold on to adds up."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


# -------------------------------------------------------------------- blocks
def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES):
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` each."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(column)
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        yield batch.slice(int(a), int(b - a))
        give_back()


@dataclass
class Words:
    """The words of a block of texts, as offsets into one byte buffer."""

    data: np.ndarray  #: bytes of all texts
    offsets: np.ndarray  #: text i is data[offsets[i]:offsets[i + 1]]
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: words of text i are first[i]:first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer and the offsets of the texts in it; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    else:
        texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def words_of(texts) -> Words:
    return words_in(*joined(texts))


def words_in(data: np.ndarray, offsets: np.ndarray) -> Words:
    ink = (data != 32) & (data - np.uint8(9) > 4)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(ink)
    after = np.empty_like(ink)
    if len(ink):
        before[0] = after[-1] = False
        before[1:], after[:-1] = ink[:-1], ink[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
    start = np.flatnonzero(ink & ~before)
    end = np.flatnonzero(ink & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


# ------------------------------------------------------------------- hashing
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, BLOCK_BYTES)
        for name, base in (("up", _BASE), ("down", _BACK)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), for even bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(w: Words, data: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums over the whole block.

    Polynomials modulo 2^64 collide on long regular words (those in Thue-Morse
    order, for one), so words above ``LONG_WORD`` bytes are hashed by BLAKE2.
    """
    data = w.data if data is None else data
    if not len(w.start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    h = (sums[w.end] - sums[w.start]) * down[w.start]
    h = mix(h + (w.end - w.start).astype(np.uint64))
    for i in np.flatnonzero(w.end - w.start > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[w.start[i] : w.end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that start at each word; the last k - 1 are missing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _BASE
        out += h[i : i + n]
    return mix(out)


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def bucket_cuts(sorted_hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (by the top ``bits``) present in sorted hashes and where each begins; one more end."""
    top = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(top, prepend=-1))
    return top[cuts], np.append(cuts, len(top))


def sliding(reduce, a: np.ndarray, width: int) -> np.ndarray:
    """reduce (np.minimum or np.maximum) over a[i:i + width], by doubling."""
    span, out = 1, a
    while 2 * span <= width:
        out = reduce(out[: len(out) - span], out[span:])
        span *= 2
    return reduce(out[: len(a) - width + 1], out[width - span : width - span + len(a) - width + 1])
