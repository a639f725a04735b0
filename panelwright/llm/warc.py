"""WARC archives: a distributed writer and a sequential reader.

The writer makes one gzip member per record and lays members of a task into
segments of bounded size, which Spark's text writer puts into files through
its commit protocol, so a repeated task leaves no half files and any file
system that Spark writes to will do.  That writer ends every row with a
separator byte; a gzip member of under 16 MB ends in a zero byte, so the
segment's own last byte serves as the separator (larger members are followed
by an empty member).  A file is a plain sequence of gzip members.

The reader goes through a file member by member: incremental inflation,
header block, content-length framing, payload digest while the bytes pass.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_workers, store, text_or_empty

DATE = "2024-01-01T00:00:00Z"
SEGMENT_BYTES, SEGMENTS_PER_FILE, STEP = 1 << 20, 16, 1 << 16

# fixed values of the WARC 1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_EMPTY_MEMBER = _member(b"")


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as bytes (not compressed).  A revisit has no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"),
            b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + DATE.encode()]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url)
        head.append(b"WARC-Target-URI: " + safe.encode("utf-8"))
    head.append(b"WARC-Payload-Digest: sha1:" + digest)
    if revisit:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode()]
    block = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write_segments(batches):
    schema = pa.schema([("segment", pa.binary())])
    parts, size = [], 0
    for batch in batches:
        for page_id, url, html, response_id, revisit in zip(*(c.to_pylist() for c in batch.columns)):
            data = _member(record(page_id, url, html.encode("utf-8"), response_id, revisit))
            parts.append(data if data[-1] == 0 else data + _EMPTY_MEMBER)
            size += len(parts[-1])
            if size >= SEGMENT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], schema=schema)
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], schema=schema)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_revisit_bytes: int = 0) -> None:
    """Write a record per row under the folder ``path`` (any Spark file system).

    Of rows with equal payloads (UTF-8 of the html, NULL as empty) of at least
    ``min_revisit_bytes`` bytes the one with the smallest id is a response,
    the others are revisits of it.  Rows that repeat that id and payload are
    responses too; if all ids of a payload are NULL, all are responses.  Other
    columns are ignored; an empty table writes no record.
    """
    text = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("html"))
    rows = rows.withColumn("key", F.sha2("html", 256))
    first = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisit = (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
               & (F.octet_length("html") >= min_revisit_bytes))
    marked = rows.join(first, "key", "left").select("id", "url", "html", "first", revisit.alias("revisit"))
    segments = on_workers(marked).mapInArrow(_write_segments, "segment binary")
    # the row's last byte, a zero, is written as the separator
    body = F.expr("cast(substring(segment, 1, octet_length(segment) - 1) AS string)")
    (segments.select(body.alias("value")).write.mode("overwrite").option("lineSep", "\x00")
     .option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(path))


class BadRecord(ValueError):
    """The archive breaks the framing or a digest."""


def members(content: bytes) -> Iterator[Iterator[bytes]]:
    """The gzip members of ``content`` in order, each as inflated pieces.  A
    member must be read to its end before the next is asked for."""
    at = 0
    view = memoryview(content)
    state = {"at": at}

    def pieces():
        z = zlib.decompressobj(31)
        while not z.eof:
            chunk = view[state["at"]:state["at"] + STEP]
            if not len(chunk):
                raise BadRecord("the last member is cut off")
            state["at"] += len(chunk)
            out = z.decompress(chunk)
            state["at"] -= len(z.unused_data)
            if out:
                yield out

    while state["at"] < len(view):
        yield pieces()


def parse_record(pieces: Iterator[bytes], keep_payload: bool = False) -> dict | None:
    """Frame one record; None for an empty member.  The payload passes in
    pieces; it is kept only if asked for."""
    head = bytearray()
    while (cut := head.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            if head:
                raise BadRecord("record without header end")
            return None
        head += piece
    lines = bytes(head[:cut]).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise BadRecord("no WARC version line")
    fields = {k.strip().lower().decode(): v.strip().decode("utf-8") for k, _, v in (x.partition(b":") for x in lines[1:])}
    left = int(fields["content-length"])
    rest = bytes(head[cut + 4:])
    sha, size, kept = hashlib.sha1(), 0, []
    http, in_payload, after = bytearray(), False, bytearray()

    while True:
        block, extra = rest[:left], rest[left:]
        left -= len(block)
        after += extra
        if not in_payload:
            http += block
            end = http.find(b"\r\n\r\n")
            if end >= 0:
                in_payload, block = True, bytes(http[end + 4:])
            else:
                block = b""
        sha.update(block)
        size += len(block)
        if keep_payload:
            kept.append(block)
        rest = next(pieces, None)
        if rest is None:
            break
    if left or after != b"\r\n\r\n":
        raise BadRecord("content length and record length differ")
    digest = base64.b32encode(sha.digest()).decode()
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and declared != digest:
        raise BadRecord(f"payload digest of {fields.get('warc-record-id')} differs")

    def page(name):
        m = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None
    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "payload_bytes": None if revisit else size, "payload_digest": declared, "refers_to": page("warc-refers-to"),
            "payload": b"".join(kept) if keep_payload else None}


READ_SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
               "refers_to long, payload binary")


def _read_files(keep_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for pieces in members(content.as_buffer()):
                    found = parse_record(pieces, keep_payload)
                    if found is not None:
                        rows.append(found)
                        size += len(found["payload"] or b"")
                    if len(rows) >= 10_000 or size >= SEGMENT_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``: ``page_id, url,
    record_type, payload_bytes`` (NULL for revisits), ``payload_digest``
    (verified for responses), ``refers_to, payload`` (NULL unless kept).
    Broken framing or a wrong digest fails the read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return on_workers(files).mapInArrow(_read_files(keep_payload), READ_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give revisits the payload size of the response they refer to, found by
    id and digest; a revisit without its response gets NULL.  The archives are
    read once."""
    records = store(records.drop("payload"), "warc-records")        # read for both sides of the join
    responses = (records.filter("record_type = 'response'")
                 .select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"),
                         F.col("payload_bytes").alias("r_bytes")).distinct())
    joined = records.join(responses, (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "r_bytes").alias("payload_bytes"), "payload_digest",
                         "record_type", "refers_to")
