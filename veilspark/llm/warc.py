"""WARC archives with a two-level capture index.

Writing: of the records with equal payloads of at least ``least_revisit``
bytes the one with the largest page_id is a response and the others are
revisits that refer to it; smaller payloads are all responses.  Every task
writes one archive of gzip members (one a record) to the shared folder and
gives back an index line per record.

Index: lines are put in order of their reversed-host key over all tasks,
packed into compressed blocks of ``block_lines`` lines (level two), and each
block leaves one entry with its first key, file, offset and length in the
sparse directory (level one).  Reading is by key: wanted keys are range-sorted, each
task takes the part of the directory that its keys span and finds their blocks in it by
bisection; each block is read once, by its byte range, and searched by bisection for its
keys; the lines found say which byte ranges of the archives to read.

Scale: kinds are decided on (page_id, digest), never with html in hand; a
payload that a third of the pages share is one row after the first
aggregation.  A key that a third of the pages share is one key, whose many blocks are
searched by as many tasks.  Reads are spread over a number of tasks that follows the
number of lines.  No part of the directory comes to the driver.  Archives are
closed at ``most_bytes``.  Files are named by task attempt and only those whose index lines
were committed are ever read, so a repeated or lost task does no harm.

Defined results: null html is an empty payload; null page_ids take part (less
than all others); repeated rows are records each, of the same kind and with ids of their own; null urls
have an empty key; very long payloads are records like others, one in memory at a time; of equal payloads with
equal largest page_ids all these are responses; an empty table gives an empty archive; other columns are
never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, qualified, shared_dir, text_blocks

LEAST = -(1 << 63)
LINE = "key string, url string, page_id long, kind string, digest string, size long, refers_to long, file string, offset long, length long"
ENTRY = "key string, last string, file string, offset long, length long, lines long"
DATE = "2024-01-01T00:00:00Z"


def _store(base: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(base)
    return files, path.rstrip("/")


def surt(url: str | None) -> str:
    """Reversed-host key: scheme and www. dropped, host labels turned, path and query kept."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower().removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    head = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return head + ")" + (parts.path or "/").lower() + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None, turn: int) -> str:
    """An id that holds page_id and a number that tells records of one page_id apart."""
    return f"<urn:uuid:{uuid.UUID(int=(turn << 64 | (LEAST if page_id is None else page_id) & (1 << 64) - 1))}>"


def turn_of(archive: str, at: int) -> int:
    """A number for the record that begins at a place of an archive."""
    return int.from_bytes(hashlib.blake2b(f"{archive}:{at}".encode(), digest_size=8).digest(), "big")


def page_of(record: str) -> int | None:
    low = uuid.UUID(record[len("<urn:uuid:") : -1]).int & (1 << 64) - 1
    page = low - (1 << 64) if low >> 63 else low
    return None if page == LEAST else page


def _uri(url: str | None) -> str:
    """A URL as a header has it."""
    return "".join(c for c in (url or "urn:none") if c >= " ")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, turn: int = 0, refers_uri: str | None = None) -> bytes:
    named = base64.b32encode(bytes.fromhex(digest)).decode()
    uri = _uri(url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, turn)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{named}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        # the record referred to is told by its URI and date, and by its page; its own id is made elsewhere
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_uri(refers_uri)}", f"WARC-Refers-To-Date: {DATE}",
            f"Refers-To-Page: {LEAST if refers_to is None else refers_to}",
        ]
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "payload": None if revisit else payload,
        "payload_bytes": told,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest(),
        "told_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "record_type": fields["WARC-Type"],
        "refers_to_uri": fields.get("WARC-Refers-To-Target-URI"),
        "refers_to": None if not revisit or int(fields["Refers-To-Page"]) == LEAST else int(fields["Refers-To-Page"]),
    }


def _write(base: str, level: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _store(base)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                for block in text_blocks(batch, "payload"):
                    rows = []
                    for page, url, payload, digest, kind, refers, uri in zip(*(block.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "kind", "refers_to", "refers_uri")), strict=True):
                        payload = payload or b""
                        if out is None or at >= most_bytes:
                            if out is not None:
                                out.close()
                            name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                            out = files.open_output_stream(f"{root}/{name}", compression=None)
                        raw = gzip.compress(_record(page, url, payload, digest, refers, kind == "revisit", turn_of(name, at), uri), level, mtime=0)
                        out.write(raw)
                        rows.append((surt(url), url, page, kind, digest, len(payload), refers, name, at, len(raw)))
                        at += len(raw)
                    cols = zip(*rows, strict=True)
                    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in LINE.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


_FIELDS = [x.split()[0] for x in LINE.split(", ")]


def _line(row: tuple) -> str:
    clean = lambda v: "-" if v is None else str(v).replace("%", "%25").replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D") or "%"
    return "\t".join(map(clean, row))


def _back(v: str) -> str | None:
    return None if v == "-" else "" if v == "%" else v.replace("%0D", "\r").replace("%0A", "\n").replace("%09", "\t").replace("%25", "%")


def read_line(line: str) -> dict:
    row = dict(zip(_FIELDS, map(_back, line.split("\t")), strict=True))
    return row | {k: None if row[k] is None else int(row[k]) for k in ("page_id", "size", "refers_to", "offset", "length")}


def _pack_index(base: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _store(base)
        name, out, at = f"index-{uuid.uuid4().hex}.cdx.gz", None, 0
        held: list[tuple] = []
        entries: list[tuple] = []

        def flush() -> None:
            nonlocal out, at, held
            if out is None:
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            raw = gzip.compress("\n".join(map(_line, held)).encode(), 6, mtime=0)
            out.write(raw)
            entries.append((held[0][0], held[-1][0], name, at, len(raw), len(held)))
            at += len(raw)
            held = []

        try:
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in _FIELDS), strict=True):
                    held.append(row)
                    if len(held) == block_lines:
                        flush()
            if held:
                flush()
        finally:
            if out is not None:
                out.close()
        if entries:
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries, strict=True), types, strict=True)], [x.split()[0] for x in ENTRY.split(", ")])

    return run


PLACE = "file string, offset long, length long"
_PLACE_TYPES = (pa.string(), pa.int64(), pa.int64())


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sorted(set(map(surt, batch.column("url").to_pylist()))), pa.string())], ["key"])


def _search(base: str):
    """Sorted keys to the blocks that may hold them, by bisection in the part of the directory that they span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _store(base)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if not keys:
                continue
            part = pq.read_table(f"{root}/directory", filesystem=files, columns=["key", "last", *_PLACE], filters=[("last", ">=", keys[0]), ("key", "<=", keys[-1])])
            part = part.sort_by([("key", "ascending"), ("last", "ascending")])
            first, last = part.column("key").to_pylist(), part.column("last").to_pylist()
            spans = [(bisect_left(last, k), bisect_right(first, k)) for k in keys]
            at = pa.array([i for a, b in spans for i in range(a, b)], pa.int64())
            wanted = [k for k, (a, b) in zip(keys, spans, strict=True) for _ in range(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.string()), *(part.column(c).combine_chunks().take(at) for c in _PLACE)], ["key", *_PLACE])

    return run


_PLACE = ("file", "offset", "length")


def find(lines: list[str], key: str) -> Iterator[dict]:
    """The lines of a key in a sorted block."""
    for line in lines[bisect_left(lines, key, key=lambda x: _back(x.split("\t", 1)[0]) or "") :]:
        row = read_line(line)
        if row["key"] != key:
            return
        yield row


def _find_lines(base: str):
    """Blocks, each with its wanted keys in a row, to the places of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _store(base)
        block, lines = None, []
        for batch in batches:
            rows: list[dict] = []
            for key, *own in zip(*(batch.column(k).to_pylist() for k in ("key", *_PLACE)), strict=True):
                if own != block:
                    block = own
                    with files.open_input_file(f"{root}/{own[0]}") as f:
                        lines = gzip.decompress(f.read_at(own[2], own[1])).decode().split("\n")
                rows += find(lines, key)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(_PLACE, _PLACE_TYPES, strict=True)], _PLACE)

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read_records(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _store(base)
        name = f = None
        for batch in batches:
            rows: list[dict] = []
            for own, offset, length in zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True):
                if own != name:
                    if f is not None:
                        f.close()
                    name, f = own, files.open_input_file(f"{root}/{own}")
                row = parse_record(zlib.decompress(f.read_at(length, offset), 31))
                if row["payload_digest"] != row["told_digest"]:
                    raise ValueError("damaged record")
                rows.append({k: v for k, v in row.items() if k in READ})
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = [x.split()[0] for x in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names)
        if f is not None:
            f.close()

    return run


@dataclass
class Archive:
    """Archives and their index under ``base`` in the shared folder."""

    spark: SparkSession
    base: str

    @property
    def directory(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.base}/directory")

    def read(self, urls: DataFrame) -> DataFrame:
        """The records of all captures of the given URLs (column url), found by their keys through both levels of the index."""
        n = self.directory.agg(F.sum("lines")).first()[0] or 0
        tasks = max(1, min(-(-n // 2000), max(64, -(-n // 50_000))))
        keys = urls.select("url").distinct().mapInArrow(_keys, "key string").distinct()
        blocks = keys.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(_search(self.base), f"key string, {PLACE}")
        places = blocks.repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(_find_lines(self.base), PLACE)
        return places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_read_records(self.base), READ)

    def lookup(self, url: str) -> list[dict]:
        """The records of one URL: bisection in the part of the directory that holds its key, then range reads."""
        key = surt(url)
        entries = sorted(map(tuple, self.directory.filter((F.col("key") <= key) & (F.col("last") >= key)).select("key", "last", *_PLACE).collect()))
        files, root = _store(self.base)
        found = []
        for _, _, name, offset, length in entries:
            with files.open_input_file(f"{root}/{name}") as f:
                lines = gzip.decompress(f.read_at(length, offset)).decode().split("\n")
            for row in find(lines, key):
                with files.open_input_file(f"{root}/{row['file']}") as f:
                    found.append(row | parse_record(zlib.decompress(f.read_at(row["length"], row["offset"]), 31)))
        return found


@dataclass(frozen=True)
class WarcWriter:
    least_revisit: int = 1000
    block_lines: int = 2000
    level: int = 3
    most_bytes: int = 1 << 30

    def write(self, pages: DataFrame) -> Archive:
        spark = pages.sparkSession
        base = qualified(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
        files, root = _store(base)
        files.create_dir(root, recursive=True)
        payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
        named = bound_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
        rank = F.coalesce(F.col("page_id"), F.lit(LEAST))
        # kinds by (page, digest): no html here
        keys = named.filter(F.length("payload") >= self.least_revisit).select(rank.alias("page"), "digest", F.coalesce("url", F.lit("")).alias("uri")).groupBy("page", "digest").agg(F.min("uri").alias("uri"))
        last = keys.groupBy("digest").agg(F.max(F.struct("page", "uri")).alias("last"), F.count(F.lit(1)).alias("pages")).filter("pages > 1").select("digest", F.col("last.page").alias("original"), F.col("last.uri").alias("refers_uri"))
        revisits = keys.join(last, "digest").filter("page <> original").select("page", "digest", "original", "refers_uri")
        kinds = revisits.withColumnRenamed("digest", "its digest")
        rows = named.join(kinds, (rank == F.col("page")) & (F.col("digest") == F.col("its digest")), "left")
        refers = F.when(F.col("original") != LEAST, F.col("original"))
        written = rows.select("page_id", "url", "payload", "digest", F.when(F.col("page").isNotNull(), "revisit").otherwise("response").alias("kind"), refers.alias("refers_to"), "refers_uri")
        written.mapInArrow(_write(base, self.level, self.most_bytes), LINE).write.parquet(f"{base}/lines")
        lines = spark.read.schema(LINE).parquet(f"{base}/lines")
        ordered = lines.orderBy("key", "url", "page_id", "file", "offset")
        ordered.mapInArrow(_pack_index(base, self.block_lines), ENTRY).write.parquet(f"{base}/directory")
        return Archive(spark, base)
