"""WARC archives as seekable Zstandard bundles.

Each task writes bundles of its own: records are gathered into independent Zstandard frames of about FRAME_BYTES of
content, and the file ends with the seek table of the seekable format (a skippable frame that lists every frame's
compressed and plain size, and a footer). The returned index maps a record identifier to its file, its frame and
the offset and length inside the plain frame, so one record is read by decompressing one frame.

Bundles are named anew by every attempt of a task and count only when the index names them; the index is written by
Spark's committer. So lost executors and repeated tasks leave unused files at worst, never half a result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

from flagstone.llm.common import partitions, stored
from flagstone.plans.shared import scratch_path

FRAME_BYTES = 512 * 1024
BUNDLE_BYTES = 256 * 1024 * 1024
# Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store that holds `uri`, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class BundleWriter:
    """Writes one bundle; `add` gives a record's frame and its offset in it."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        self.out = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.frames, self.parts, self.held, self.plain = [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.held and self.held + len(record) > self.frame_bytes:
            self._close_frame()
        at = len(self.frames), self.held
        self.parts.append(record)
        self.held += len(record)
        self.plain += len(record)
        return at

    def _close_frame(self) -> None:
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(self.parts))
        self.out.write(data)
        self.frames.append((len(data), self.held))
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class BundleReader:
    """Reads frames of one bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        fs, path = filesystem(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        width = 12 if descriptor & 0x80 else 8  # with or without checksums
        table = self.file.read_at(count * width, size - 9 - count * width)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def _line(value) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", "" if value is None else str(value))


def record_id(page_id) -> str:
    """The key in percent encoding, so that any text comes back; an empty one is a bare %, a null one nothing."""
    key = "" if page_id is None else quote(str(page_id), safe="") or "%"
    return f"<urn:page:{key}>"


def page_key(identifier: Column, kind: DataType) -> Column:
    """The key of a record identifier."""
    key = identifier.substr(F.lit(11), F.length(identifier) - 11)
    return F.when(key == "%", "").otherwise(F.try_url_decode(F.nullif(key, F.lit("")))).cast(kind)


def record(page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """A response record, or a revisit record when `refers_to` is given (then without the payload)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers (names in lower case) and payload of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        block = data[end + 4:end + 4 + int(head["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
        yield head, fields, payload
        at = end + 4 + len(block) + 4


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Pages with `sha1`, and `refers_to` where a record revisits another one.

    Among equal payloads of at least `least_bytes` bytes those of the largest page_id are responses. Null html
    counts as empty. A null page_id is smaller than any other.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("_key", F.sha2("html", 256))
    prints = stored(rows.filter(F.octet_length("html") >= least_bytes).select("page_id", "_key"), "payloads")
    groups = prints.groupBy("_key").agg(F.max("page_id").alias("target"), F.min("page_id").alias("low"), F.count("page_id").alias("known"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("low < target or (known > 0 and known < n)").select("_key", "target")
    # Narrow rows of the records that revisit; broadcast by Spark only below its threshold, else joined by page.
    revisits = prints.join(groups, "_key").filter("not (page_id <=> target)").distinct()
    revisits = stored(revisits.select(F.col("page_id").alias("_page"), F.col("_key").alias("_same"), F.col("target").alias("refers_to")), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_key") == F.col("_same"))
    return rows.join(revisits, same, "left").select("page_id", "url", "html", F.sha1("html").alias("sha1"), "refers_to")


def write_bundles(planned: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write planned records; the index `(page_id, record_id, file, frame, offset, length)`, stored."""
    kind = planned.schema["page_id"].dataType.simpleString()

    def write(batches):
        out = None
        for batch in batches:
            cells = {"file": [], "frame": [], "offset": [], "length": []}
            ids, urls, digests, targets = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for page_id, url, html, sha1, target in zip(ids, urls, batch.column(2), digests, targets):
                if out is None:
                    out = BundleWriter(folder, frame_bytes)
                data = record(page_id, url, html.as_buffer().to_pybytes(), sha1, target)
                frame, offset = out.add(data)
                for name, x in zip(cells, (out.name, frame, offset, len(data))):
                    cells[name].append(x)
                if out.plain >= bundle_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([record_id(p) for p in ids], pa.string()), pa.array(cells["file"], pa.string()),
                 pa.array(cells["frame"], pa.int32()), pa.array(cells["offset"], pa.int64()), pa.array(cells["length"], pa.int64())],
                names=["page_id", "record_id", *cells])
        if out is not None:
            out.close()

    schema = f"page_id {kind}, record_id string, file string, frame int, offset long, length long"
    return stored(planned.mapInArrow(write, schema), "warc-index")


def read_bundles(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Every record of the bundles that the index names: record_id, url, record_type, refers_to, payload_bytes,
    payload_digest (hex SHA-1, of responses computed from the payload read) and `payload`, if wanted."""
    frames = index.select("file", "frame").distinct().repartitionByRange(partitions(index), "file", "frame").sortWithinPartitions("file", "frame")

    def read(batches):
        held = None, None
        for batch in batches:
            for file, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held[0] != file:
                    if held[1]:
                        held[1].close()
                    held = file, BundleReader(folder, file)
                rows = []
                for head, http, data in parse_records(held[1].frame(frame)):
                    told = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    response = head["warc-type"] == "response"
                    digest = hashlib.sha1(data).hexdigest() if response else told
                    if digest != told or response and len(data) != int(http["content-length"]):
                        raise ValueError(f"{head['warc-record-id']} is damaged")
                    rows.append((head["warc-record-id"], head["warc-target-uri"], head["warc-type"], head.get("warc-refers-to"),
                                 int(http["content-length"]), digest, data if payload else None))
                kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    schema = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return frames.mapInArrow(read, schema)


def read_record(index: DataFrame, folder: str, wanted: str) -> bytes | None:
    """One record's bytes by its identifier: one seek and one frame."""
    row = index.filter(F.col("record_id") == wanted).first()
    if row is None:
        return None
    bundle = BundleReader(folder, row["file"])
    data = bundle.frame(row["frame"])[row["offset"]:row["offset"] + row["length"]]
    bundle.close()
    return data


def archive(
    pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> tuple[DataFrame, str]:
    """Write a record per page below `folder` (one in the shared folder by default); the index and the folder.

    Pages of null html have an empty payload, repeated rows one record each; an empty table gives no bundle. Keys may be null or
    texts with any characters. A payload beyond a frame's size is a frame of its own.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return write_bundles(plan_records(pages, least_bytes), folder, frame_bytes, bundle_bytes), folder


def archive_report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive the pages, read all bundles back, and give per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index, folder = archive(pages)
    kind = pages.schema["page_id"].dataType
    return read_bundles(index, folder, payload=False).select(
        page_key(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_key(F.col("refers_to"), kind).alias("refers_to"))
