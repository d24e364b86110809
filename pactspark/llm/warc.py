"""WARC archives as a chunked record table.

A record's bytes (WARC/1.1 header, HTTP block, trailing line ends) are stored as
rows (record, chunk, last, data, payload_bytes, payload_sha1): long records run
over many rows of at most ``chunk_bytes``, and each row carries the length and
SHA-1 of the payload so far, so neither writer nor reader forms a whole record.
Joining a record's chunks in order gives the bytes of a .warc file.

Scale: equal payloads are found by an aggregate over digests; records of one
chunk are parsed where they lie, only longer ones are brought together by record
number and streamed in chunk order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm import scratch

URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record long, chunk int, last boolean, data binary, payload_bytes long, payload_sha1 string"


def _header(page: int | None, url: str | None, digest: str, size: int, refers: int | None, date: str) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers is None else 0)}", "", ""]
    return "\r\n".join(lines).encode(), http


def _chunks(chunk_bytes: int, date: str):
    def of(record, page, url, payload, digest, refers) -> Iterator[tuple]:
        head, http = _header(page, url, digest, len(payload), refers, date)
        body = memoryview(payload) if refers is None else memoryview(b"")
        sha, done, start = hashlib.sha1(), 0, head + http
        for chunk in range(1 << 30):
            part = body[done : done + max(1, chunk_bytes - len(start))]
            sha.update(part)
            done += len(part)
            last = done == len(body)
            yield record, chunk, last, b"".join((start, part, b"\r\n\r\n" if last else b"")), done, sha.hexdigest()
            if last:
                return
            start = b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                record, page, url, payload, digest, refers = (c[i] for c in batch.columns)
                for row in of(record.as_py(), page.as_py(), url.as_py(), payload.as_buffer(), digest.as_py(), refers.as_py()):
                    held.append(row)
                    size += len(row[3])
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return run


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 1000, chunk_bytes: int = 256 << 10, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` to the table ``path``.

    Of equal payloads of at least ``revisit_from`` bytes the one with the
    largest id is a response and the others are revisits of it; all others are
    responses. A null payload is empty, a null URL has no header line, repeated
    rows with the largest id are responses each, null ids are revisits where
    another id holds the payload. Control characters in a URL are percent-coded.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.filter(F.octet_length("payload") >= revisit_from)
    firsts = long.groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    known = rows.join(firsts, "digest", "left").withColumn("refers", F.when((F.octet_length("payload") >= revisit_from) & ~F.col("page").eqNullSafe(F.col("first")), F.col("first")))
    record = known.select(F.monotonically_increasing_id().alias("record"), "page", "url", "payload", "digest", "refers")
    record.mapInArrow(_chunks(chunk_bytes, date), CHUNKS).write.option("compression", "zstd").parquet(path)


class RecordParser:
    """Takes a record's bytes piece by piece; holds its headers and a running SHA-1 only."""

    def __init__(self) -> None:
        self.pending, self.fields, self.http = b"", None, False
        self.sha, self.payload, self.left = hashlib.sha1(), 0, 0

    def feed(self, data: bytes) -> None:
        data = self.pending + data if self.pending else data
        self.pending = b""
        if self.fields is None:
            head, end, data = data.partition(b"\r\n\r\n")
            if not end:
                self.pending = head
                return
            version, *lines = head.split(b"\r\n")
            if not version.startswith(b"WARC/1."):
                raise ValueError("a record must begin with its WARC version")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
            self.left = int(self.fields["content-length"])
        if not self.http:
            head, end, rest = data.partition(b"\r\n\r\n")
            if not end:
                self.pending = data
                return
            self.http, self.left, data = True, self.left - len(head) - 4, rest
        part = memoryview(data)[: self.left]
        self.sha.update(part)
        self.payload += len(part)
        self.left -= len(part)

    def row(self) -> tuple:
        if self.fields is None or not self.http or self.left:
            raise ValueError("a record ends before its content length")
        page = lambda name: None if (v := self.fields.get(name, f"<{URN}None>")[1:-1].removeprefix(URN)) == "None" else int(v)
        told = base64.b32decode(self.fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        if self.fields["warc-type"] == "revisit":
            return page("warc-record-id"), None, told, "revisit", page("warc-refers-to")
        if self.sha.hexdigest() != told:
            raise ValueError("a payload does not have the digest in its header")
        return page("warc-record-id"), self.payload, told, "response", None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    parser, expected = None, None
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            record, chunk, last, data, size, sha = (c[i] for c in batch.columns)
            at = (record.as_py(), chunk.as_py())
            if at[1] == 0:
                parser, expected = RecordParser(), at
            if at != expected:
                raise ValueError(f"chunk {at[1]} of record {at[0]} is out of order")
            expected = (at[0], at[1] + 1)
            parser.feed(data.as_py())
            if (parser.payload, parser.sha.hexdigest()) != (size.as_py(), sha.as_py()):
                raise ValueError(f"record {at[0]} differs from its running digest at chunk {at[1]}")
            if last.as_py():
                rows.append(parser.row())
                parser = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record; a revisit has its response's length."""
    table = spark.read.schema(CHUNKS).parquet(path)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    short = table.filter("chunk = 0 and last").mapInArrow(_parsed, schema)
    long = table.filter("not (chunk = 0 and last)").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_parsed, schema)
    parsed = scratch.save(short.union(long), "records")
    responses, revisits = parsed.filter("record_type = 'response'"), parsed.filter("record_type = 'revisit'").drop("payload_bytes")
    known = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes").dropDuplicates(["refers_to"])
    return responses.unionByName(revisits.join(known, "refers_to", "left"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read its records back."""
    path = scratch.new_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
