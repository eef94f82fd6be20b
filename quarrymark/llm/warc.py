"""WARC archives of pages: one gzip member per record, equal payloads stored once.

``write_archives`` puts one record per row into archives of at most ``archive_bytes`` compressed
bytes (a single record may be longer), each a file of its own in the given folder, through Spark's
own committer, so lost tasks leave nothing behind. A file is a plain sequence of gzip members,
ended by one zero byte (padding in gzip's terms); only its name lacks the usual ending.
``read_archives`` reads them one after the other: each member is decompressed in pieces, the header
gives the length of the block, and the digests of block and payload are computed on the way, so
a record's payload is held only where it is asked for.

Of rows with equal payloads (equal SHA-1 and xxHash64) the one with the largest id is a response,
the others are revisits: they carry the headers, hence the payload's length and digest, but no
payload. Defined results: a null payload is empty; a null id is the smallest; rows that share the
largest id, repeated rows included, are all responses; a null URL is left out of the header, control
characters and spaces in one are percent-encoded. An empty table makes no archive. A damaged or
truncated member gives one row whose ``error`` says so, with the columns that were still legible, and
reading goes on at the next member. Extra columns are not read.
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

from .common import Scratch, join_groups

ARCHIVE_BYTES = 32 << 20
#: Bytes fed to and taken from zlib at a time, and bytes of payloads in one batch of rows read.
PIECE, BATCH = 1 << 16, 4 << 20
DATE = "1970-01-01T00:00:00Z"
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")

RECORDS = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, offset long, error string"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _member(headers: list[tuple[str, bytes]], block: list[bytes]) -> bytes:
    """One record as a gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = b"WARC/1.1\r\n" + b"".join(k.encode() + b": " + v + b"\r\n" for k, v in headers) + b"\r\n"
    return b"".join([packer.compress(head), *map(packer.compress, block), packer.compress(b"\r\n\r\n"), packer.flush()])


def _uri(page_id: int | None) -> bytes:
    return f"<{_ID}{'' if page_id is None else page_id}>".encode()


def record(page_id: int | None, url: bytes | None, digest: bytes, length: int, payload: bytes | None, refers_to: int | None, date: str = DATE) -> bytes:
    """The record of one row: a response where the payload is given, else a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = [http] if payload is None else [http, payload]
    whole = hashlib.sha1()
    for part in block:
        whole.update(part)
    headers = [("WARC-Type", b"revisit" if payload is None else b"response"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", date.encode())]
    if url is not None:
        headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: b"%%%02X" % m.group()[0], url)))
    if payload is None:
        headers += [("WARC-Profile", _PROFILE.encode()), ("WARC-Refers-To", _uri(refers_to))]
    headers += [
        ("WARC-Payload-Digest", b"sha1:" + base64.b32encode(digest)), ("WARC-Block-Digest", b"sha1:" + base64.b32encode(whole.digest())),
        ("Content-Type", b"application/http; msgtype=response"), ("Content-Length", str(sum(map(len, block))).encode()),
    ]
    return _member(headers, block)


def _information() -> bytes:
    text = b"software: quarrymark\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", b"warcinfo"), ("WARC-Record-ID", b"<urn:x-archive:>"), ("WARC-Date", DATE.encode()), ("Content-Type", b"application/warc-fields"), ("Content-Length", str(len(text)).encode())], [text])


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", payload: str = "html", url: str = "url", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record per row into archives below the path."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").cast("binary").alias("url"), body.alias("payload"))
    keyed = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "length": F.octet_length("payload").cast("long")}).withColumn("key", F.concat("digest", F.unhex(F.hex(F.xxhash64("payload")))))
    scratch = Scratch(pages.sparkSession, "warc-groups")
    groups = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).where("n > 1"), "groups")
    joined = join_groups(keyed, groups, "key", "n", spread=F.col("page_id"))
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    ready = joined.select("page_id", "url", "digest", "length", F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("top")).alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(6)), strict=True):
                member = record(*(x.as_py() for x in row))
                if parts and size + len(member) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])
                    parts, size = [], 0
                if not parts:
                    parts, size = [_information()], 0
                parts.append(member)
                size += len(member)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["content"])

    archives = ready.mapInArrow(pack, "content binary")
    # each archive is a line of its own file; the text writer copies its bytes as they are
    archives.select(F.col("content").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


class Record:
    """One record, fed by the decompressed pieces of its member."""

    def __init__(self, keep: bool):
        self.keep, self.pending, self.headers, self.http = keep, bytearray(), None, None
        self.left = self.closing = 0
        self.block, self.body, self.kept, self.body_length = hashlib.sha1(), hashlib.sha1(), [], 0

    def feed(self, piece: bytes) -> None:
        if self.headers is None:
            self.pending += piece
            end = self.pending.find(b"\r\n\r\n")
            if end < 0:
                return
            first, *lines = bytes(self.pending[:end]).split(b"\r\n")
            if not first.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            self.headers = {k.strip().lower().decode("latin-1"): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
            self.left = int(self.headers["content-length"])
            piece = bytes(self.pending[end + 4 :])
            self.pending.clear()
        inside, rest = piece[: self.left], piece[self.left :]
        self.left -= len(inside)
        self.block.update(inside)
        self.closing += len(rest)
        if self.http is None and inside:
            self.pending += inside
            end = self.pending.find(b"\r\n\r\n")
            if end < 0:
                return
            self.http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in bytes(self.pending[:end]).split(b"\r\n")[1:])}
            inside = bytes(self.pending[end + 4 :])
            self.pending.clear()
        self.body.update(inside)
        self.body_length += len(inside)
        if self.keep:
            self.kept.append(inside)

    def header(self, name: str) -> str | None:
        value = (self.headers or {}).get(name)
        return None if value is None else value.decode("utf-8", "replace")

    def reference(self, name: str) -> int | None:
        value = self.header(name)
        return int(value[len(_ID) + 1 : -1]) if value and value.startswith(f"<{_ID}") and value != f"<{_ID}>" else None

    def digest(self, name: str) -> str | None:
        value = self.header(name)
        return value.partition(":")[2] if value else None

    def length(self) -> int | None:
        return int(self.http[b"content-length"]) if self.http and b"content-length" in self.http else None

    def fault(self) -> str | None:
        """What is wrong with a record whose member has ended."""
        if self.headers is None or self.left or self.closing != 4:
            return "the content length differs from the record"
        if self.digest("warc-block-digest") not in (None, base32_sha1(self.block.digest())):
            return "the block digest differs"
        if self.header("warc-type") == "response" and (self.digest("warc-payload-digest") != base32_sha1(self.body.digest()) or self.length() != self.body_length):
            return "the payload digest differs"
        return None


def records(data: bytes, keep: bool = True) -> Iterator[tuple[int, Record, str | None]]:
    """Offset, record and fault (or None) of all members of an archive, read one after the other."""
    at = 0
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        start, member, found, fault = at, zlib.decompressobj(31), Record(keep), None
        try:
            while not member.eof:
                chunk = member.unconsumed_tail or data[at : at + PIECE]
                fresh = not member.unconsumed_tail
                out = member.decompress(chunk, PIECE)
                at += len(chunk) * fresh
                if not (out or chunk or member.eof):
                    raise ValueError("the archive ends inside a record")
                found.feed(out)
            at -= len(member.unused_data)
            fault = found.fault()
        except (zlib.error, ValueError, KeyError) as e:
            fault = str(e)
            again = data.find(b"\x1f\x8b\x08", start + 1)
            at = again if again >= 0 else len(data)
        yield start, found, fault


def read_archives(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """A row per record of the archives below the path; ``payload`` is null for revisits, and for all where not kept."""
    schema = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("error", pa.string())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows, size = [], 0
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for offset, r, fault in records(content.as_py(), keep):
                    kind = r.header("warc-type")
                    if kind == "warcinfo" and fault is None:
                        continue
                    body = b"".join(r.kept) if keep and kind == "response" else None
                    rows.append((r.reference("warc-record-id"), r.header("warc-target-uri"), kind, r.reference("warc-refers-to"), r.length(), r.digest("warc-payload-digest"), body, name.as_py(), offset, fault))
                    size += len(body or b"") + 200
                    if size > BATCH:
                        yield table()
                        rows, size = [], 0
        if rows:
            yield table()

    if not _has_files(spark, path):
        return spark.createDataFrame([], RECORDS)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, RECORDS)


def _has_files(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(folder)
    return any(f.getPath().getName().startswith("part-") for f in found)
