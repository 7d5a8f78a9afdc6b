"""WARC archives as a Python data source, read and written.

Reading plans one partition a file.  Each gzip member holds one record and tells
its own compressed length in an extra field, so a record whose headers fail a
pushed filter is passed over by its length, its payload never decoded.  Filters
on record_type, page_id, target_uri, payload_digest and refers_to are pushed.
With the option payload=false payloads are not decoded at all.

Writing gives each task files of its own, of bounded size, under names that hold
the attempt; a commit moves them into place, so lost attempts leave nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from . import shared

SCHEMA = "page_id bigint, target_uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
LEAST_PAYLOAD = 100
FILE_BYTES = 64 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"  # pages carry no time
_HEAD = 2048


def _member(record: bytes) -> bytes:
    """A gzip member whose extra field SL holds its own length and the record's."""
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(record) + body.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"SL", 8, size, len(record) & 0xFFFFFFFF) + packed + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(url: str) -> str:
    """Header values hold no controls: those are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def record(page_id: int, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One record: a response with its payload, or a revisit with headers only."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Bytes: {size}", f"X-Page-ID: {page_id}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(text: str | None) -> int | None:
    """A whole number of this profile; what other archives put there is none."""
    return int(text) if text and text.lstrip("-").isascii() and text.lstrip("-").isdigit() else None


def parse_headers(head: bytes) -> dict:
    """The named columns of a record's header block.  Bytes that aren't UTF-8 are read
    as Latin-1; columns that only this profile has are null in other archives."""
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError:
        lines = head.decode("latin-1").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    h: dict[str, str] = {}
    for x in lines[1:]:
        k, _, v = x.partition(":")
        h.setdefault(k.strip().lower(), v.strip())
    refers = h.get("warc-refers-to", "").rpartition(":")[2].rstrip(">")
    return {
        "page_id": _number(h.get("x-page-id")),
        "target_uri": h["warc-target-uri"].strip("<>") if "warc-target-uri" in h else None,
        "record_type": h.get("warc-type"),
        "payload_bytes": _number(h.get("x-payload-bytes")),
        "payload_digest": h.get("warc-payload-digest", "").rpartition(":")[2] or None,
        "refers_to": _number(refers),
        "content_length": int(h["content-length"]),
    }


def _payload(block: bytes, row: dict) -> bytes | None:
    return block.partition(b"\r\n\r\n")[2] if row["record_type"] == "response" else None


def _own_length(start: bytes) -> int | None:
    """The compressed length that a member of this profile tells."""
    return struct.unpack_from("<I", start, 16)[0] if len(start) == 24 and start[3] & 4 and start[10:14] == b"\x0c\0SL" else None


def _sought(source, at: int, wanted, payloads: bool) -> Iterator[tuple[dict | None, int]]:
    """Records whose members tell their length, with where the next one starts: headers
    are inflated first, what isn't wanted is passed over."""
    while True:
        source.seek(at)
        length = _own_length(source.read(24))
        if length is None:
            return
        inflate, left, head = zlib.decompressobj(-15), length - 32, b""
        while (cut := head.find(b"\r\n\r\n")) < 0:
            more = inflate.unconsumed_tail or source.read(min(left, _HEAD))
            left -= 0 if inflate.unconsumed_tail else len(more)
            if not more:
                raise ValueError("a record without the end of its headers")
            head += inflate.decompress(more, _HEAD)
        row, at = parse_headers(head[:cut]), at + length
        size, keep = row.pop("content_length"), wanted(row)
        row["payload"] = None
        if keep and payloads and row["record_type"] == "response":
            rest = inflate.unconsumed_tail + source.read(left)
            whole = head if inflate.eof else head + inflate.decompress(rest)
            row["payload"] = _payload(whole[cut + 4 : cut + 4 + size], row)
        yield (row if keep else None), at


def _inflated(source, at: int, wanted, payloads: bool) -> Iterator[dict]:
    """Records of any gzip stream from ``at`` on, whatever its members are, in one pass;
    blocks that aren't wanted are inflated, as nothing tells their compressed length, and
    dropped piece by piece."""
    source.seek(at)
    with gzip.GzipFile(fileobj=source) as stream:
        while True:
            head = stream.readline()
            while head in (b"\r\n", b"\n"):  # what ends the record before
                head = stream.readline()
            if not head:
                return
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                head += line
            row = parse_headers(head.replace(b"\r\n", b"\n").replace(b"\n", b"\r\n").removesuffix(b"\r\n"))
            size, keep = row.pop("content_length"), wanted(row)
            row["payload"] = None
            if keep and payloads and row["record_type"] == "response":
                row["payload"] = _payload(stream.read(size), row)
            else:
                while size > 0 and (gone := len(stream.read(min(size, 1 << 16)))):
                    size -= gone
            if keep:
                yield row


def read_records(source, wanted, payloads: bool) -> Iterator[dict]:
    """Records of a file (bytes, or an open file that can seek) whose headers pass
    ``wanted``.  Members of this profile are sought; from the first other one on the
    file is read as one stream.  One record is held at a time."""
    source = io.BytesIO(source) if isinstance(source, bytes) else source
    at = 0
    for row, at in _sought(source, 0, wanted, payloads):
        if row is not None:
            yield row
    source.seek(at)
    if source.read(1):
        yield from _inflated(source, at, wanted, payloads)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


@dataclass
class _Written(WriterCommitMessage):
    paths: list


class WarcReader(DataSourceReader):
    columns = ("record_type", "page_id", "target_uri", "payload_digest", "refers_to")

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.tests.append((f.attribute[0], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.tests.append((f.attribute[0], ()))
            else:
                yield f

    def partitions(self):
        where, path = _open(self.path)
        found = where.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith(".warc.gz")] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        where, _ = _open(self.path)
        tests = self.tests

        def wanted(row: dict) -> bool:
            return all(row[c] is not None and (not v or row[c] in v) for c, v in tests)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        with where.open_input_file(partition.path) as f:
            for row in read_records(f, wanted, self.payloads):
                rows.append(row)
                size += len(row["payload"] or b"")
                if len(rows) >= 1000 or size >= 4 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Takes page_id, url, html, payload_digest, payload_bytes and refers_to."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        where, path = _open(self.path)
        where.create_dir(path, recursive=True)
        made, out, size = [], None, 0
        for batch in iterator:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to")]
            cols[2] = cols[2].cast(pa.large_binary())
            for page, url, html, digest, n, refers in zip(*(c.to_pylist() for c in cols)):
                if out is None or size >= FILE_BYTES:
                    if out:
                        out.close()
                    made.append(f"{path}/.{uuid.uuid4().hex}.warc.gz")
                    out, size = where.open_output_stream(made[-1], compression=None), 0
                member = _member(record(page, url, digest, n, refers, html or b""))
                out.write(member)
                size += len(member)
        if out:
            out.close()
        return _Written(made)

    def commit(self, messages):
        where, path = _open(self.path)
        where.create_dir(path, recursive=True)
        for i, p in enumerate(p for m in messages if m for p in m.paths):
            where.move(p, f"{path}/{i:06d}-{p.rpartition('.warc.gz')[0][-32:]}.warc.gz")

    def abort(self, messages):
        where, _ = _open(self.path)
        for p in (p for m in messages if m for p in m.paths):
            where.delete_file(p)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def write_pages(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``pages`` with a page_id.

    Of rows whose payloads (html in UTF-8, empty for null) are equal and have at
    least 100 bytes, the one with the smallest page_id is a response and the
    others revisit it; all smaller ones are responses.  Null urls have no target
    header, and controls in urls are percent-encoded there.  Rows repeated under
    one page_id become records of their own; of equal ones, all are responses if
    their id is the smallest.  Rows with a null page_id are left out.
    """
    pages.sparkSession.dataSource.register(WarcDataSource)
    with shared.small_batches(pages.sparkSession):
        html = F.coalesce(F.col("html").cast("string"), F.lit(""))
        named = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
        named = named.withColumn("payload_digest", F.sha2(F.encode("html", "utf-8"), 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
        light = named.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= LEAST_PAYLOAD)
        first = light.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("payload_digest", "first")
        again = light.join(first, "payload_digest").where("page_id > first").select("page_id", "payload_digest", F.col("first").alias("refers_to")).distinct()
        rows = named.join(again.hint("shuffle_hash"), ["page_id", "payload_digest"], "left")
        rows.select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to").write.format("warc").mode("append").save(path)


def read(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``.  Turns on, for the session, the
    setting by which Spark pushes filters into Python sources."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes,
    payload_digest, record_type and refers_to.  Responses are checked: length and
    digest of what was decoded must equal their headers'."""
    spark = pages.sparkSession
    path = shared.Scratch(spark, "warc").path("archives")
    write_pages(pages, path)
    rows = read(spark, path)
    sound = (F.col("record_type") == "revisit") | ((F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes")))
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its headers: page "), F.col("page_id"))))
    return rows.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
