"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A bundle ends with the seek table of the
public Zstandard seekable format (a skippable frame of compressed and decompressed sizes), and an
index table maps every record identifier to its bundle, frame and offset inside the frame, so one
record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.batches import slices
from varve.llm.shared_files import AtomicFile, filesystem
from varve.operators.staging import Workspace

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that one task reads back.
READ_BYTES = 1 << 25
INDEX_SCHEMA = "record_id string, bundle string, frame long, offset long, length long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BundleWriter:
    """Frames of about ``frame_bytes`` of records each, then the seek table."""

    def __init__(self, uri: str, attempt: int, frame_bytes: int, level: int):
        self.uri, self.frame_bytes = uri, frame_bytes
        self.file = AtomicFile(uri, attempt)
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.pending = bytearray()

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame number, offset in the frame and length of the record."""
        if self.pending and len(self.pending) + len(record) > self.frame_bytes:
            self._flush()
        place = (len(self.frames), len(self.pending), len(record))
        self.pending += record
        return place

    def _flush(self) -> None:
        data = self.zstd.compress(bytes(self.pending))
        self.file.write(data)
        self.frames.append((len(data), len(self.pending)))
        self.pending.clear()

    def close(self) -> None:
        if self.pending:
            self._flush()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.file.commit()


class BundleReader:
    """Random access to the frames of one bundle through its seek table."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, full in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, full))
            at += packed
        self.zstd = zstandard.ZstdDecompressor()
        self.current: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self.current[0] != frame:
            at, packed, full = self.frames[frame]
            self.current = (frame, self.zstd.decompress(self.file.read_at(packed, at), max_output_size=full))
        return self.current[1][offset : offset + length]

    def close(self) -> None:
        self.file.close()


def record_id(page: dict) -> str:
    """The same identifier for the same row, however often its task runs."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '{page_id}|{copy}|{digest}|{url}'.format_map(page))}>"


def _header_value(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in text or "\n" in text else text


def encode_record(name: str, page: dict, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head only, whose Content-Length is that of the full payload."""
    payload = page["payload"].encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['payload_bytes']}\r\n\r\n".encode()
    revisit = page["record_type"] == "revisit"
    block = head if revisit else head + payload
    fields = [("WARC-Type", page["record_type"]), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if page["url"] is not None:
        fields.append(("WARC-Target-URI", _header_value(page["url"])))
    fields.append(("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(page['digest'])).decode()}"))
    if page["page_id"] is not None:
        fields.append(("WARC-X-Page-ID", str(page["page_id"])))
    if revisit:
        fields.append(("WARC-Profile", REVISIT_PROFILE))
        if page["refers_to"] is not None:
            fields.append(("WARC-X-Refers-To-Page-ID", str(page["refers_to"])))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return top.encode() + block + b"\r\n\r\n"


def decode_record(data: bytes) -> dict:
    """The fields of RECORD_SCHEMA; a response's length and digest are computed from the payload itself."""
    top, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    number = lambda key: int(fields[key]) if key in fields else None
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    else:
        http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size, digest = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return {
        "page_id": number("WARC-X-Page-ID"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-X-Refers-To-Page-ID"),
    }


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Decide for every row whether it is a response or a revisit.

    Among rows with equal payloads of at least ``min_bytes`` bytes the one with the largest
    page_id is the response (of repeated rows with that page_id, the first by url); the others
    revisit it. Null ids count as smallest and a null payload as empty. Winners are found on
    (digest, id) pairs alone; payloads are shuffled once, by id, so a payload shared by a third of
    all rows stays spread out.
    """
    base = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload")
    ).select(
        "*",
        F.sha1(F.encode("payload", "utf-8")).alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("key"),
    )
    shared = (
        base.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    members = base.select("key", "digest").distinct().join(shared, "digest")
    order = Window.partitionBy("key", "digest").orderBy(F.col("url").asc_nulls_first())
    placed = base.join(members.select("key", "digest", "winner", "n"), ["key", "digest"], "left")
    placed = placed.withColumn("copy", F.row_number().over(order))
    keeps = F.col("n").isNull() | ((F.col("key") == F.coalesce(F.col("winner").cast("string"), F.lit("null"))) & (F.col("copy") == 1))
    kind = F.when(keeps, "response").otherwise("revisit")
    return placed.select(
        "page_id",
        "url",
        F.when(kind == "response", F.col("payload")).otherwise("").alias("payload"),
        "payload_bytes",
        "digest",
        kind.alias("record_type"),
        F.when(kind == "revisit", F.col("winner")).alias("refers_to"),
        F.col("copy").cast("long").alias("copy"),
    )


def write_bundles(
    records: DataFrame, folder: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, level: int = 3, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write one or more bundles per partition below ``folder``; returns the (lazy) index table.

    Names depend on the partition only and files are renamed into place, so a task that runs
    again after a lost executor replaces what it wrote before. Evaluate the result once, by
    writing it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        bundle, number = None, 0
        for batch in slices(batches):
            places: dict[str, list] = {k: [] for k in ("record_id", "bundle", "frame", "offset", "length")}
            for page in batch.to_pylist():
                if bundle is None:
                    uri = f"{folder}/part-{context.partitionId():06d}-{number:04d}.warc.zst"
                    bundle = BundleWriter(uri, context.taskAttemptId(), frame_bytes, level)
                name = record_id(page)
                row = (name, bundle.uri, *bundle.add(encode_record(name, page, date)))
                for column, value in zip(places.values(), row, strict=True):
                    column.append(value)
                if bundle.file.size >= bundle_bytes:
                    bundle.close()
                    bundle, number = None, number + 1
            yield pa.RecordBatch.from_pydict(places)
        if bundle is not None:
            bundle.close()

    return records.mapInArrow(write, INDEX_SCHEMA)


def read_records(index: DataFrame) -> DataFrame:
    """Read the records an index (or any part of it) names; rows follow RECORD_SCHEMA.

    Frames are the unit of work: they are dealt out by bundle and frame, and each is decompressed
    once by the task that has its records.
    """
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    kinds = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in slices(batches):
            rows = []
            for uri, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
                if uri != opened:
                    if reader:
                        reader.close()
                    reader, opened = BundleReader(uri), uri
                rows.append(decode_record(reader.record(frame, offset, length)))
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        if reader:
            reader.close()

    # As many tasks as the frames have bytes for; the index itself is tiny and would be read by one.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // READ_BYTES), 1)
    work = index.select("bundle", "frame", "offset", "length").repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return work.mapInArrow(read, RECORD_SCHEMA)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as bundles and return the stored index table; ``folder`` defaults to the shared folder."""
    ws = Workspace(pages.sparkSession, "warc")
    return ws.table(write_bundles(plan_records(pages), folder or f"{ws.root}/bundles"), "index")
