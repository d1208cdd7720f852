"""WARC archives: records are written by Spark's own writers, read back, and segments put together again.

Every page becomes an HTTP response in chunked transfer framing. A block longer than ``segment_bytes`` is split into a
first record and continuation records. Reading parses the records of each archive, groups what belongs together by the
origin's identifier, orders by segment number, verifies the total length, undoes the chunked framing and verifies the
payload's digest; an archive that fails a check raises an error.

Defined cases: null html is the empty payload; a null url is empty; rows that repeat the smallest page_id of a
payload are responses like it, so ties all stay; a payload of any length is cut into segments and put together whole; a null page_id is larger than any other, and rows of equal payloads without any page_id
are all responses; an empty table gives no archives and no rows; other columns are ignored. Archives are whole-file gzip, as Spark's text
writer makes them; the records inside follow WARC/1.1.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import fresh_path, table

#: Stands between records, and ends each.
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, key string, segment long, total long, block binary"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    out = bytearray()
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += b"%x\r\n" % len(part) + part + b"\r\n"
    return bytes(out + b"0\r\n\r\n")


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        at = end + 2
        if len(part := body[at : at + n]) < n or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(part)
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", str(len(block)))))
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(page_id: int | None, url: str, payload: bytes, digest: str, revisits: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the END after each; revisits: the page whose record has the payload."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if revisits is not None:
        head += [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(revisits))]
        yield _record(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head.append(("WARC-Type", "response"))
    if len(block) <= segment_bytes:
        yield _record(head, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([*head, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        yield _record([*more, *([("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else [])], part)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 4096, revisit_from: int = 100, salts: int = 16) -> None:
    """Writes (page_id, url, html) as archives in the folder path, through Spark's committer: a lost task leaves nothing."""
    rows = pages.selectExpr("cast(page_id as long) page_id", "coalesce(url, '') url", "cast(coalesce(html, '') as binary) payload").withColumn("digest", F.sha2("payload", 256))
    shared = rows.filter(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for record in records(page_id, url, payload, digest, None if first == page_id else first, segment_bytes):
                    out.append(record)
                    size += len(record)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # Small payloads don't meet the digests at all; copies of one payload, however many, are dealt over salts.
    salted = rows.withColumn("salt", F.when(F.octet_length("payload") >= revisit_from, F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")))
    told = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    small = salted.filter("salt is null").withColumn("first", F.lit(None).cast("long"))
    large = salted.filter("salt is not null").join(told, ["digest", "salt"], "left")
    joined = small.unionByName(large).select("page_id", "url", "payload", "digest", "first")
    written = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with names in lower case, block) of every record."""
    while line := archive.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := archive.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        if len(block := archive.read(n)) < n:
            raise ValueError("a record is cut off")
        yield fields, block


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP response, and its stated length."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = unchunked(body)
    return body, int(fields[b"content-length"]) if b"content-length" in fields else None


class _Gunzip(io.RawIOBase):
    """The bytes of all gzip members, or of a file that isn't compressed."""

    def __init__(self, raw: bytes):
        self.rest, self.z = raw, zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.rest:
            if self.z is None:
                out, self.rest = self.rest[: len(into)], self.rest[len(into) :]
            else:
                out = self.z.decompress(self.rest, len(into))
                self.rest = self.z.unconsumed_tail or self.z.unused_data
                if self.z.eof:
                    self.z = zlib.decompressobj(31)
            if out:
                into[: len(out)] = out
                return len(out)
        return 0


def _whole(fields: dict[str, str], block: bytes) -> tuple:
    """The row of a record with its whole block; a response's payload is verified against its digest."""
    number = lambda k: int(fields[k]) if fields.get(k) else None
    payload, n = payload_of(block)
    digest = fields["warc-payload-digest"].rpartition(":")[2]
    if fields["warc-type"] == "response":
        n = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} has another digest")
    return number("x-page-id"), fields["warc-type"], number("x-refers-to-page-id"), n, digest


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Whole records are decoded where they are read; only the segments of split ones travel with their blocks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("key", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for fields, block in parse(io.BufferedReader(_Gunzip(content.as_py()), 1 << 18)):
                    if "warc-segment-number" in fields:
                        digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                        page = int(fields["x-page-id"]) if fields.get("x-page-id") else None
                        key = fields.get("warc-segment-origin-id") or fields["warc-record-id"]
                        out.append((page, fields["warc-type"], None, None, digest, key, int(fields["warc-segment-number"]), int(fields.get("warc-segment-total-length", 0)) or None, block))
                        size += len(block)
                    else:
                        out.append((*_whole(fields, block), fields["warc-record-id"], None, None, None))
                    size += 200
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    read = files.mapInArrow(rows, RECORD)
    return read.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(_assembled, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by key and segment; those of a key are put together."""
    held: list[tuple] = []

    def close() -> tuple:
        if held[0][6] is None:
            if len(held) > 1:
                raise ValueError(f"{held[0][5]} occurs {len(held)} times")
            page, kind, refers, n, digest = held[0][:5]
            return page, n, digest, kind, refers
        block = b"".join(x[8] for x in held)
        if [x[6] for x in held] != list(range(1, len(held) + 1)) or held[-1][7] != len(block):
            raise ValueError(f"segments of {held[0][5]} are missing")
        fields = {"warc-type": "response", "warc-record-id": held[0][5], "warc-payload-digest": held[0][4], "x-page-id": "" if held[0][0] is None else str(held[0][0])}
        page, kind, refers, n, digest = _whole(fields, block)
        return page, n, digest, kind, refers

    def batch(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    for b in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[5] != held[0][5]:
                out.append(close())
                held.clear()
            held.append(row)
        if out:
            yield batch(out)
    if held:
        yield batch([close()])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)
