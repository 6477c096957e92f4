"""WARC archives: one gzip member per record, written by tasks and read back as a stream.

Writer: every row becomes a record. Of rows with equal payloads of at least ``min_revisit_bytes``
bytes, that with the smallest id is a response; the others are revisits, which hold the HTTP headers
and point to it. Which ids are revisits is found beforehand from digests alone (one small
aggregation), so payloads are not shuffled. Each task writes archives of at most ``archive_bytes``
(plus one record) under names of its own and reports them; only reported archives count, so a task
that runs twice leaves no double records.

Reader: sequential, in pieces of ``READ_BYTES``. Each gzip member is inflated step by step, the record
header is read up to its blank line, and the block is taken by its Content-Length. Digests of block
and payload are computed along the way and compared with those in the header.

Defined cases: a null payload is empty; a null id is written without a page id and never becomes the
target of a revisit while another row has the payload; rows of equal payload that share the smallest
id are all responses; a null URL is left out; other bytes than printable ASCII in a URL are
percent-encoded; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.llm.store import fresh_path, stored

ARCHIVE_BYTES = 256 * 1024 * 1024
READ_BYTES = 1 << 18
# Longest accepted record or HTTP header; a longer one means a damaged archive.
HEADER_BYTES = 1 << 20

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A date is required; the pages carry none.
DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "archive STRING, offset LONG, page_id LONG, record_type STRING, refers_to LONG, url STRING, "
    "payload_bytes LONG, payload_digest STRING, verified BOOLEAN"
)
MANIFEST_SCHEMA = "archive STRING, n_records LONG, n_bytes LONG"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_file(path: str, mode: str) -> BinaryIO:
    """A file of the shared folder: a plain path or file: URI, else a store that Arrow knows."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(parts.path, mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_stream(inner)


def make_folder(path: str) -> None:
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        os.makedirs(parts.path, exist_ok=True)
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(inner, recursive=True)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"{page_id}/{url}" if page_id is not None else f"/{url}/{base32_sha1(payload)}"
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "!#$&'()*+,/:;=?@[]-._~%"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                page_id, url, html, refers_to, revisit = row
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_file(path, "wb")
                packed = member(record(page_id, url, (html or "").encode(), refers_to, revisit))
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    done.append((path, n, size))
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["archive", "n_records", "n_bytes"])

    return write


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record per row below ``folder``; returns the stored list of archives."""
    page, payload = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    make_folder(folder)
    rows = pages.select(page.cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("html"))
    digests = stored(
        rows.where(F.octet_length("html") >= min_revisit_bytes).select(
            "page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")
        ),
        "digests",
    )
    first = digests.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"))
    repeated = digests.join(first, ["digest", "n"]).where("page_id > refers_to OR page_id IS NULL AND refers_to IS NOT NULL")
    # A page id may stand on several rows with different payloads, so the digest is part of the key.
    marks = repeated.select("page_id", "digest", "n", "refers_to").distinct()
    keyed = rows.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html"))
    on = [keyed["page_id"].eqNullSafe(marks["page_id"]), keyed["digest"] == marks["digest"], keyed["n"] == marks["n"]]
    planned = keyed.join(marks, on, "left").select(
        keyed["page_id"], "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit")
    )
    return stored(planned.mapInArrow(_writer(folder, archive_bytes), MANIFEST_SCHEMA), "archives")


class _Inflated:
    """The decompressed bytes of a run of gzip members, with the offset at which the current one began."""

    def __init__(self, file: BinaryIO):
        self.file, self.packed, self.read_to = file, b"", 0
        self.unzip, self.offset, self.buffer = zlib.decompressobj(31), 0, bytearray()
        self.ended = False

    def _more(self) -> bool:
        """Inflate a little more of this member; false once it has ended."""
        if self.unzip.eof:
            return False
        if not self.packed:
            self.packed = self.file.read(READ_BYTES)
            self.read_to += len(self.packed)
            if not self.packed:
                raise EOFError(f"archive ends inside the member at {self.offset}")
        self.buffer += self.unzip.decompress(self.packed, READ_BYTES)
        self.packed = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
        return True

    def line_end(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if seen > HEADER_BYTES or not self._more():
                raise ValueError(f"no header end in the member at {self.offset}")
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, piece by piece."""
        while n:
            if not self.buffer and not self._more():
                raise ValueError(f"short block in the member at {self.offset}")
            piece = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(piece)
            if piece:
                yield piece

    def next_member(self) -> bool:
        """Go to the next member; false at the end of the archive."""
        while self._more():
            pass
        if bytes(self.buffer) != b"\r\n\r\n":
            raise ValueError(f"no record end in the member at {self.offset}")
        self.buffer.clear()
        self.offset = self.read_to - len(self.packed)
        if not self.packed:
            self.packed = self.file.read(READ_BYTES)
            self.read_to += len(self.packed)
        self.unzip = zlib.decompressobj(31)
        return bool(self.packed)


def read_records(file: BinaryIO) -> Iterator[dict]:
    """The records of one archive, in order. Blocks pass through in pieces; payloads are not kept."""
    source = _Inflated(file)
    more = True
    while more:
        head = source.line_end(b"\r\n\r\n").decode()
        version, *lines = head.rstrip("\r\n").split("\r\n")
        if version.encode() != VERSION:
            raise ValueError(f"not a record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        offset = source.offset
        block_hash, payload_hash, payload_bytes = hashlib.sha1(), hashlib.sha1(), 0
        http, in_body = bytearray(), False
        for piece in source.pieces(int(fields["content-length"])):
            block_hash.update(piece)
            if not in_body:
                http += piece
                end = http.find(b"\r\n\r\n")
                if end < 0:
                    if len(http) > HEADER_BYTES:
                        raise ValueError("no end of the HTTP header")
                    continue
                in_body, piece = True, bytes(http[end + 4 :])
                del http[end + 4 :]
            payload_hash.update(piece)
            payload_bytes += len(piece)
        revisit = fields["warc-type"] == "revisit"
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        length = next(int(v) for k, _, v in (x.partition(b":") for x in bytes(http).split(b"\r\n")) if k.lower() == b"content-length")
        verified = fields["warc-block-digest"] == "sha1:" + base64.b32encode(block_hash.digest()).decode() and (
            payload_bytes == 0 if revisit else payload_bytes == length and digest == base64.b32encode(payload_hash.digest()).decode()
        )
        yield {
            "offset": offset,
            "page_id": int(fields["page-id"]) if "page-id" in fields else None,
            "record_type": fields["warc-type"],
            "refers_to": int(fields["refers-to-page-id"]) if revisit else None,
            "url": fields.get("warc-target-uri"),
            "payload_bytes": length,
            "payload_digest": digest,
            "verified": verified,
        }
        more = source.next_member()


_ARROW = pa.schema(
    [
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("verified", pa.bool_()),
    ]
)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows: list[dict] = []
            with open_file(path, "rb") as file:
                for row in read_records(file):
                    rows.append({"archive": path, **row})
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives in ``manifest``; a damaged archive fails the job."""
    spark = manifest.sparkSession
    # Archives are few large files: one to a partition.
    spread = manifest.select("archive").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive")
    return spread.mapInArrow(_reader, RECORD_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
