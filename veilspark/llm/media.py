"""Media columns as progressive JPEG, written and read here.

A payload of 64-byte units becomes the quantised coefficients of a 4:2:0 JPEG
(all quantisers 1): byte b is coefficient b + 256, so every coefficient has
the same magnitude class and the Huffman tables have one symbol each.  The
stream is progressive: a first DC scan and two spectral bands of AC at a
quarter of the precision, then two passes of successive approximation that add
the last bits.  Reading accumulates the scans into coefficient arrays, which
give the payload back exactly; a transform in exact integers (scaled basis, in
one matrix product for a block of rows), chroma upsampling and colour
conversion give the full-resolution RGB tensor.

Streams with other Huffman tables are read by a bit-by-bit decoder.

Scale: row by row, no shuffle; the streams are written to the shared folder
and read from there; numpy works on about 4 MB of rows at once.

Defined results: null is an empty payload of one unit; very long texts make wider
images, with no bound but memory for one row; equal payloads give
equal bytes, features and tensors; repeated rows, null doc_ids and ties are rows like others, and keys are
untouched; other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, joined, materialise, text_blocks

#: Largest number of 16-row units in a column of blocks (heights are 16-bit).
TALL = 4095


def _zigzag() -> np.ndarray:
    """Row-major position of each coefficient in zigzag order."""
    cells = sorted(((x + y, y if (x + y) % 2 else x, y, x) for y in range(8) for x in range(8)))
    return np.array([y * 8 + x for _, _, y, x in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Pixel = coefficients (zigzag) @ basis / 1024, in whole numbers that float32 sums exactly."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG] * 1024).astype(np.float32)


BASIS = _basis()

# ------------------------------------------------------------------- writing
#: (first, last coefficient, high bit, low bit) of each component's scans.
SCRIPT = ((0, 0, 0, 2), (1, 5, 0, 2), (6, 63, 0, 2), (0, 0, 2, 1), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind, 1, *[0] * 15, symbol]))


def _head(wide: int, tall: int, units: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * tall, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _segment(0xFE, b"units=%d" % units) + _segment(0xDB, bytes([0, *[1] * 64])) + _segment(0xC2, frame) + _table(0x00, 7) + _table(0x10, 7) + _table(0x11, 0)


def _scan_head(component: int, scan: tuple[int, int, int, int]) -> bytes:
    first, last, high, low = scan
    restart = _segment(0xDD, struct.pack(">H", 1 if last == 0 and high == 0 else 0))
    return restart + _segment(0xDA, bytes([1, component, 0x01 if first and high else 0x00, first, last, high << 4 | low]))


_SCAN_HEADS = [[_scan_head(c, s) for s in SCRIPT] for c in (1, 2, 3)]


def geometry(units: int) -> tuple[int, int]:
    """Width and height, in 16-pixel squares, of the image that holds so many 64-byte units."""
    squares = max(1, -(-units // 6))
    wide = -(-squares // TALL)
    return wide, -(-squares // wide)


def write_images(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A JPEG for each payload data[offsets[i]:offsets[i + 1]], zero-padded to whole units."""
    size = np.diff(offsets)
    units = np.maximum(1, -(-size // 64))
    shape = [geometry(u) for u in units.tolist()]
    blocks = np.array([6 * w * t for w, t in shape], np.int64)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    b = np.zeros(begin[-1] * 64, np.uint8)
    b[np.arange(len(data)) + np.repeat(begin[:-1] * 64 - offsets[:-1], size)] = data
    b = b.reshape(-1, 64)
    first = b >> 2 | 0x40
    luma = np.repeat(blocks * 4 // 6, blocks)
    inside = np.arange(len(b)) - np.repeat(begin[:-1], blocks)
    chroma = np.maximum(inside - luma, 0) % np.maximum(luma // 4, 1)
    inside = np.where(inside < luma, inside, chroma)
    dc = np.stack([first[:, 0], np.full(len(b), 0xFF, np.uint8), (0xD0 + inside % 8).astype(np.uint8)], 1).tobytes()
    low, high = np.ascontiguousarray(first[:, 1:6]).tobytes(), np.ascontiguousarray(first[:, 6:]).tobytes()
    planes = []
    for p in (1, 0):
        bits = b >> p & 1
        dc_bits = bits[:, 0].copy()
        bits[:, 0] = 0
        planes.append((dc_bits, np.packbits(bits, axis=1).tobytes()))
    out = []
    for i, (wide, tall) in enumerate(shape):
        parts = [_head(wide, tall, int(units[i]))]
        a, n = int(begin[i]), wide * tall
        for c, (p, q) in enumerate(((a, a + 4 * n), (a + 4 * n, a + 5 * n), (a + 5 * n, a + 6 * n))):
            heads = _SCAN_HEADS[c]
            parts += [heads[0], dc[3 * p : 3 * q - 2], heads[1], low[5 * p : 5 * q], heads[2], high[58 * p : 58 * q]]
            for k, (dc_bits, ac) in enumerate(planes):
                own = np.packbits(dc_bits[p:q])
                if (q - p) % 8:
                    own[-1] |= 0xFF >> (q - p) % 8
                parts += [heads[3 + 2 * k], own.tobytes().replace(b"\xff", b"\xff\x00"), heads[4 + 2 * k], ac[8 * p : 8 * q].replace(b"\xff", b"\xff\x00")]
        parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
    return out


# ------------------------------------------------------------------- reading
@dataclass
class Frame:
    width: int = 0
    height: int = 0
    units: int | None = None
    parts: list[tuple[int, int, int]] = field(default_factory=list)  #: id, horizontal and vertical sampling
    scans: list[tuple] = field(default_factory=list)  #: (component, scan, table, restart, bytes)

    def grid(self, k: int) -> tuple[int, int, int, int]:
        """Blocks of component k: rows and columns in the image, rows and columns that are stored."""
        _, h, v = self.parts[k]
        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        up = lambda a, b: -(-a // b)
        rows, cols = up(up(self.height * v, most_v), 8), up(up(self.width * h, most_h), 8)
        return rows, cols, up(self.height, 8 * most_v) * v, up(self.width, 8 * most_h) * h


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(media: bytes) -> Frame:
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    frame, at, restart, tables = Frame(), 2, 0, {}
    while True:
        marker = media[at + 1]
        if marker == 0xD9:
            return frame
        size = media[at + 2] << 8 | media[at + 3]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE and body.startswith(b"units="):
            frame.units = int(body[6:])
        elif marker == 0xC2:
            _, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
            frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive Huffman streams are read")
        elif marker == 0xC4:
            p = 0
            while p < len(body):
                n = sum(body[p + 1 : p + 17])
                tables[body[p]] = body[p + 1 : p + 17 + n]
                p += 17 + n
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xDA:
            n = body[0]
            ids = [p[0] for p in frame.parts]
            where = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            end = _NEXT.search(media, at).start()
            kind = 0x10 if first else 0
            used = tuple(tables.get(kind | (t & 15 if first else t >> 4), b"") for _, t in where)
            frame.scans.append((tuple(k for k, _ in where), (first, last, bits >> 4, bits & 15), used, restart, media[at:end]))
            at = end


_ONE = bytes([1, *[0] * 15])
_REGULAR = tuple(((c,), s, (_ONE + bytes([0 if s[0] and s[2] else 7]),) if s[0] or not s[2] else None, 1 if s[1] == 0 and s[2] == 0 else 0) for c in range(3) for s in SCRIPT)


def is_regular(f: Frame) -> bool:
    """Whether all of the stream's symbols have one code, as write_images makes them."""
    if len(f.scans) != len(_REGULAR) or [p[1:] for p in f.parts] != [(2, 2), (1, 1), (1, 1)]:
        return False
    return all(s[0] == r[0] and s[1] == r[1] and (r[2] is None or s[2] == r[2]) and s[3] == r[3] for s, r in zip(f.scans, _REGULAR, strict=True))


def _read_regular(frames: list[Frame]) -> np.ndarray:
    """Coefficients of all frames, block by block, components in turn."""
    counts = [[r * c for r, c, _, _ in map(f.grid, range(3))] for f in frames]
    total = sum(map(sum, counts))
    coefs = np.zeros((total, 64), np.int16)
    for s, (first, last, high, low) in enumerate(SCRIPT):
        raw = [(f.scans[7 * c + s][4], counts[i][c]) for i, f in enumerate(frames) for c in range(3)]
        if not high:
            width = last - first + 1 if first else 3
            parts = [x if first else x + b"\xff\xd0" for x, _ in raw]
            got = np.frombuffer(b"".join(parts), np.uint8).reshape(total, width)
            got = got if first else got[:, :1]
            if (got >> 6 != 1).any():
                raise ValueError("damaged scan")
            coefs[:, first : last + 1] = (got & 0x7F).astype(np.int16) << low
        else:
            parts = [x.replace(b"\xff\x00", b"\xff") for x, _ in raw]
            if first:
                bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8).reshape(total, 8), axis=1)
                coefs[:, 1:] |= bits[:, 1:].astype(np.int16) << low
            else:
                bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8))
                n = np.array([x for _, x in raw])
                start = np.cumsum(-(-n // 8) * 8) - -(-n // 8) * 8
                coefs[:, 0] |= bits[np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n)].astype(np.int16) << low
    return coefs


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | (self.bits[self.at] if self.at < len(self.bits) else 1)
            self.at += 1
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = n = 0
        while n < 16:
            code, n = code << 1 | self.take(1), n + 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("damaged scan")

    def value(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> n - 1 else v - (1 << n) + 1


def _codes(table: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1] if table else 0):
            out[n, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _read_any(f: Frame) -> list[np.ndarray]:
    """Coefficients of each component, [rows, columns, 64], by reading bit after bit."""
    grids = [f.grid(k) for k in range(len(f.parts))]
    coefs = [np.zeros((g[2], g[3], 64), np.int32) for g in grids]
    for comps, (first, last, high, low), tables, restart, data in f.scans:
        codes = [_codes(t) for t in tables]
        if len(comps) == 1:
            k = comps[0]
            order = [[(0, k, r, c)] for r in range(grids[k][0]) for c in range(grids[k][1])]
        else:
            h, v = f.parts[comps[0]][1:]
            order = [
                [(i, k, my * f.parts[k][2] + y, mx * f.parts[k][1] + x) for i, k in enumerate(comps) for y in range(f.parts[k][2]) for x in range(f.parts[k][1])]
                for my in range(grids[comps[0]][2] // v) for mx in range(grids[comps[0]][3] // h)
            ]
        pieces = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
        step = restart or len(order)
        for a, piece in zip(range(0, len(order), step), pieces, strict=False):
            bits, before, run = _Bits(piece), [0] * len(comps), 0
            for i, k, r, c in (u for unit in order[a : a + step] for u in unit):
                block = coefs[k][r, c]
                if first == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        before[i] += bits.value(bits.symbol(codes[i]))
                        block[0] = before[i] * (1 << low)
                    continue
                at = first
                fix = lambda j: bits.take(1) and not block[j] >> low & 1 if block[j] >= 0 else bits.take(1) and not -block[j] >> low & 1  # noqa: B023, E731
                while at <= last and not run:
                    symbol = bits.symbol(codes[0])
                    zeros, size = symbol >> 4, symbol & 15
                    if not size and zeros < 15:
                        run = (1 << zeros) + bits.take(zeros)
                        break
                    new = bits.value(size) if not high else (1 if bits.take(1) else -1) if size else 0
                    if not high:
                        at += zeros
                        if size:
                            block[at] = new * (1 << low)
                        at += 1
                        continue
                    while at <= last:
                        if block[at]:
                            if fix(at):
                                block[at] += (1 << low) if block[at] > 0 else -(1 << low)
                        elif not zeros:
                            break
                        else:
                            zeros -= 1
                        at += 1
                    if new and at <= last:
                        block[at] = new * (1 << low)
                    at += 1
                if run:
                    if high:
                        for j in range(at, last + 1):
                            if block[j] and fix(j):
                                block[j] += (1 << low) if block[j] > 0 else -(1 << low)
                    run -= 1
    return coefs


def _pixels(coefs: np.ndarray) -> np.ndarray:
    """[n, 64] coefficients to [n, 8, 8] samples."""
    out = coefs.astype(np.float32) @ BASIS
    return np.clip((out.astype(np.int32) + 512 >> 10) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    y = (y.astype(np.int32) << 16) + 32768
    cb, cr = cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    out[..., 0] = np.clip(y + 91881 * cr >> 16, 0, 255)
    out[..., 1] = np.clip(y - 22554 * cb - 46802 * cr >> 16, 0, 255)
    out[..., 2] = np.clip(y + 116130 * cb >> 16, 0, 255)
    return out


def tensor_of(f: Frame, coefs: list[np.ndarray]) -> np.ndarray:
    """Height x width x 3, from the coefficients of one image."""
    planes = []
    most_h, most_v = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    for (_, h, v), c in zip(f.parts, coefs, strict=True):
        rows, cols = c.shape[:2]
        plane = _pixels(c.reshape(-1, 64)).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
        planes.append(plane.repeat(most_v // v, 0).repeat(most_h // h, 1)[: f.height, : f.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    return _rgb(*planes)


def read_images(media: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """For each stream: its payload and its RGB tensor."""
    frames = [parse(m) for m in media]
    regular = [is_regular(f) and f.width == 16 for f in frames]
    quick = [f for f, r in zip(frames, regular, strict=True) if r]
    out: list[tuple[bytes, np.ndarray]] = []
    if quick:
        coefs = _read_regular(quick)
        blocks = np.array([6 * (f.height // 16) for f in quick])
        begin = np.cumsum(blocks) - blocks
        squares = blocks // 6
        # blocks of an image stand as 4n of luma, n and n of chroma; with one column that is square after square
        base = np.repeat(begin, squares)
        k = np.arange(squares.sum()) - np.repeat(np.cumsum(squares) - squares, squares)
        n = np.repeat(squares, squares)
        pixels = _pixels(coefs)
        y = pixels[(base + 4 * k)[:, None] + np.arange(4)].reshape(-1, 2, 2, 8, 8).swapaxes(2, 3).reshape(-1, 16, 16)
        up = lambda p: p.repeat(2, 1).repeat(2, 2)
        rgb = _rgb(y, up(pixels[base + 4 * n + k]), up(pixels[base + 5 * n + k]))
        raw = (coefs - 256).astype(np.uint8).tobytes()
        tall = np.cumsum(squares) - squares
        images = [(raw[64 * a : 64 * (a + (f.units if f.units is not None else b))], rgb[t : t + s].reshape(-1, 16, 3)) for f, a, b, t, s in zip(quick, begin.tolist(), blocks.tolist(), tall.tolist(), squares.tolist(), strict=True)]
    else:
        images = []
    quickly = iter(images)
    for f, r in zip(frames, regular, strict=True):
        if r:
            out.append(next(quickly))
            continue
        coefs = _read_any(f) if not is_regular(f) else _by_component(f)
        whole = np.concatenate([c[: g[0], : g[1]].reshape(-1, 64) for c, g in zip(coefs, map(f.grid, range(len(f.parts))), strict=True)])
        out.append(((whole[: f.units] - 256).astype(np.uint8).tobytes(), tensor_of(f, coefs)))
    return out


def _by_component(f: Frame) -> list[np.ndarray]:
    whole, out, a = _read_regular([f]), [], 0
    for k in range(3):
        rows, cols, _, _ = f.grid(k)
        out.append(whole[a : a + rows * cols].reshape(rows, cols, 64))
        a += rows * cols
    return out


def feature_of(rgb: np.ndarray) -> str:
    """Size, and mean and spread of each channel."""
    x = rgb.reshape(-1, 3).astype(np.int64)
    n = len(x)
    mean, square = x.sum(0) / n, (x * x).sum(0) / n
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(f"{v:.3f}" for v in [*mean, *spread])


# ---------------------------------------------------------------- operators
def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch, limit=2 << 20):
            data, offsets = joined(block.column("text"))
            media = write_images(data, offsets)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _load(tensors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "media", limit=3 << 20):
                media = block.column("media").to_pylist()
                images = read_images(media)
                hexed = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                payloads = [p for p, _ in images]
                cols = [
                    block.column("doc_id"),
                    block.column("n_bytes"),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    hexed(payloads),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    hexed(media),
                    pa.array([feature_of(t) for _, t in images]),
                ]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                if tensors:
                    cols += [pa.array([list(t.shape) for _, t in images], pa.list_(pa.int32())), pa.array([t.tobytes() for _, t in images], pa.binary())]
                    names += ["shape", "tensor"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a progressive JPEG, as a table in the shared folder."""
    made = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")
    return materialise(made, "media", "zstd")


def load(media: DataFrame, tensors: bool = False) -> DataFrame:
    """What the stored bytes give back; ``tensors`` adds shape and tensor (RGB bytes), a media column of its own."""
    schema = DIGESTS + (", shape array<int>, tensor binary" if tensors else "")
    return media.select("doc_id", "n_bytes", F.col("media")).mapInArrow(_load(tensors), schema)
