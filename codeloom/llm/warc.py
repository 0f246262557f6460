"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a seek table in a skippable frame (the
public seekable format: sizes of every frame, compressed and not).  An index maps each record's identifier to its
bundle, frame and offset within the frame, so one record is read by decompressing one frame.

Executors write bundles through pyarrow's file systems, each attempt to names of its own.  The index, a Parquet
table that Spark commits, names the bundles that count; what a lost attempt has left is named nowhere.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices

#: Uncompressed bytes from which on a frame ends, and compressed bytes from which on a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 12 << 20
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, FOOTER_BYTES = 0x184D2A5E, 0x8F92EAB1, 9
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of every record; pages have none, and runs should agree.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "page_id long, record_id string, bundle string, frame int, frame_offset long, record_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block and names the record that it refers to."""
    clean = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean}"] * (url is not None) + [f"WARC-Page-ID: {page_id}"] * (page_id is not None)
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int


def records(frame: bytes, offset: int = 0) -> Iterator[Record]:
    """The records of a decompressed frame from an offset on."""
    while offset < len(frame):
        end = frame.index(b"\r\n\r\n", offset)
        lines = frame[offset:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {offset}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield Record(headers, frame[end + 4 : end + 4 + size], offset)
        offset = end + 4 + size + 4


class Bundle:
    """Collects records, closes frames, and ends with the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES) -> None:
        self.compressor, self.limit = zstandard.ZstdCompressor(level=3), frame_bytes
        self.body, self.open, self.frames = bytearray(), bytearray(), []

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset within it) of the record."""
        if self.open and len(self.open) + len(raw) > self.limit:
            self.close_frame()
        at = len(self.frames), len(self.open)
        self.open += raw
        return at

    def close_frame(self) -> None:
        if self.open:
            packed = self.compressor.compress(bytes(self.open))
            self.frames.append((len(packed), len(self.open)))
            self.body += packed
            self.open.clear()

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return bytes(self.body) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from a bundle or from its end, if that holds the whole table."""
    count, flags, magic = struct.unpack("<IBI", tail[-FOOTER_BYTES:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    entries = tail[-FOOTER_BYTES - width * count : -FOOTER_BYTES]
    out, at = [], 0
    for k in range(count):
        packed, size = struct.unpack_from("<II", entries, k * width)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size)


def read_record(path: str, frame: int, frame_offset: int) -> Record:
    """One record by its place in the index: two ranges of the bundle are read, one frame is decompressed."""
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        f.seek(f.size() - FOOTER_BYTES)
        count, flags, _ = struct.unpack("<IBI", f.read(FOOTER_BYTES))
        span = FOOTER_BYTES + count * (12 if flags & 0x80 else 8)
        f.seek(f.size() - span)
        start, packed, size = seek_table(f.read(span))[frame]
        f.seek(start)
        return next(records(zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size), frame_offset))


def assigned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, and first: the page_id that answers for an equal payload.

    Equality is by SHA-256.  The smallest page_id answers; payloads under least_bytes answer for
    themselves.  One row for each payload is what the join's small side has, and AQE may split a hot payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    key = F.sha2("payload", 256)
    firsts = rows.where(F.length("payload") >= least_bytes).groupBy(key.alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.withColumn("key", key)
    joined = rows.join(firsts.withColumnRenamed("key", "first_key"), rows["key"] == F.col("first_key"), "left")
    return joined.select("page_id", "url", "payload", F.coalesce("first", "page_id").alias("first"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record of each row to bundles under path/bundles, and return the index, stored under path/index.

    Rows of one payload and one page_id are all responses if theirs is the smallest.  A null page_id never
    answers for another row; where no row of a payload has an id, all are responses.
    """
    target = f"{path.rstrip('/')}/bundles"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(target if "://" in target or ":/" in target else f"file://{target}")
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        stem, count = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0
        bundle, rows = Bundle(frame_bytes), []

        def closed() -> pa.RecordBatch:
            nonlocal bundle, rows, count
            name = f"{stem}-{count:05d}.warc.zst"
            data = bundle.finish()
            with store.open_output_stream(f"{folder}/_{name}", compression=None) as f:
                f.write(data)
            store.move(f"{folder}/_{name}", f"{folder}/{name}")  # only whole bundles have names that readers list
            columns = list(zip(*[(p, r, name, *place, n) for p, r, place, n in rows]))
            out = pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()])], names=["page_id", "record_id", "bundle", "frame", "frame_offset", "record_bytes"])
            bundle, rows, count = Bundle(frame_bytes), [], count + 1
            return out

        for batch in batches:
            for part in slices(batch, "payload"):
                for page_id, url, payload, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))):
                    raw = record(page_id, url, payload, first, first != page_id)
                    rows.append((page_id, record_id(page_id), bundle.add(raw), len(raw)))
                    if len(bundle.body) >= bundle_bytes:
                        yield closed()
        if rows:
            yield closed()

    index = f"{path.rstrip('/')}/index"
    assigned(pages, least_bytes).select("page_id", "url", "payload", "first").mapInArrow(kernel, INDEX).write.parquet(index)
    return pages.sparkSession.read.schema(INDEX).parquet(index)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the bundles that the index names: one row each, with its place.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, frame_offset, url,
    block.  A response's length and digest are counted from its block and must agree with its headers.  Null ids and
    addresses come back null, empty payloads as empty blocks; a payload of any length is in one record; repeated rows
    are records of their own.  No bundles give no rows.
    """
    bundles = spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index").select("bundle").distinct()
    if bundles.isEmpty():  # an empty table: no bundle was written
        return spark.createDataFrame([], READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{path.rstrip('/')}/bundles")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")
    # Records, not bundles, are joined: so no bundle is shuffled, and columns that nobody reads aren't either.
    return named.mapInArrow(_read_batches, READ).join(bundles.withColumnRenamed("bundle", "known"), F.col("bundle") == F.col("known"), "left_semi")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_offset long, url string, block binary"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("url", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content")):
            raw = content.as_py()
            for k, frame in enumerate(seek_table(raw)):
                rows = []
                for r in records(read_frame(raw, frame)):
                    h = r.headers
                    said, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"])
                    if h["WARC-Type"] == "response" and (digest(r.block), len(r.block)) != (said, size):
                        raise ValueError(f"{name}, frame {k}, offset {r.offset}: the payload doesn't match its digest")
                    to_int = lambda x: None if x is None else int(x)
                    rows.append((to_int(h.get("WARC-Page-ID")), size, said, h["WARC-Type"], to_int(h.get("WARC-Refers-To-Page-ID")), name, k, r.offset, h.get("WARC-Target-URI"), r.block))
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives, read these back, and return the records (see `read`).

    A null html is an empty payload.  Other columns are not read.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write(pages, path, least_bytes)
    return read(spark, path)
