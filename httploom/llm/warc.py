"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a footer seek table (the published seekable format: a skippable frame
with the sizes of all frames) ends each bundle, and an index maps record identifiers to (frame, offset in the frame).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from httploom.session import scratch

from . import base

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 8 << 20
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time; callers pass theirs
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")

ENTRY = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
BUNDLE = T.StructType(
    [T.StructField("bundle", T.StringType()), T.StructField("archive", T.BinaryType()), T.StructField("entries", T.ArrayType(ENTRY))]
)
_ENTRY_ARROW = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))


def record_id(page: str | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page_of(urn: str) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") or None


def record(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head (and so the payload's length) and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if first is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(first)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Bundle:
    def __init__(self, frame_bytes: int):
        self.frame_bytes = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.entries: list[dict] = []
        self.open: list[bytes] = []
        self.filled = self.packed = 0

    def add(self, urn: str, data: bytes) -> None:
        self.entries.append({"record_id": urn, "frame": len(self.frames), "offset": self.filled, "length": len(data)})
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        frame = self.packer.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.filled))
        self.packed += len(frame)
        self.open, self.filled = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close_frame()
        table = b"".join(struct.pack("<II", *pair) for pair in self.sizes) + _FOOTER.pack(len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def _pack(batches, frame_bytes: int, bundle_bytes: int, date: str):
    task, number, bundle = TaskContext.get().partitionId(), 0, _Bundle(frame_bytes)

    def finished() -> pa.RecordBatch:
        row = [[f"part-{task:06d}-{number:06d}.warc.zst"], [bundle.finish()], [bundle.entries]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.binary(), _ENTRY_ARROW))], BUNDLE.names)

    for batch in batches:
        for page, url, html, digest, first in zip(*(batch.column(i) for i in range(5))):
            page = page.as_py()
            bundle.add(record_id(page), record(page, url.as_py(), html.as_py(), digest.as_py(), first.as_py(), date))
            if bundle.packed >= bundle_bytes:
                yield finished()
                number, bundle = number + 1, _Bundle(frame_bytes)
    if bundle.entries:
        yield finished()


def pack(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit: int = LEAST_REVISIT,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """``(bundle, archive, entries)``: the bytes of each ``.warc.zst`` bundle and the places of its records.

    Of rows with equal payloads of at least ``least_revisit`` bytes, those with the smallest id are responses and
    the others revisits of it. Frames close at ``frame_bytes`` of records, bundles at about ``bundle_bytes``
    compressed. The smallest id per payload digest is a map-side-combined aggregate; rows meet it by a left join,
    whose hot digests Spark splits.

    Null payload counts as empty, null URL as an empty target; rows with a null id are responses; repeated rows
    with the smallest id are all responses; an empty table gives no bundles; other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= least_revisit)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("digest", "first")
    )
    known = rows.join(firsts, "digest", "left").select(
        F.col("id").cast("string").alias("id"),
        F.col("url").cast("string").alias("url"),
        "payload",
        "digest",
        F.when(F.col("id") != F.col("first"), F.col("first")).cast("string").alias("first"),
    )
    return known.mapInArrow(base.packaged(_pack, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, date=date), BUNDLE)


def write(spark: SparkSession, bundles: DataFrame, path: str | None = None) -> DataFrame:
    """Write bundles below the shared root and read them back.

    One row per bundle in a Parquet table, through Spark's writers and so to any store; ``archive`` is the file's
    content as it stands, for whoever wants it as a file.
    """
    path = path or scratch(spark, "warc")
    bundles.write.option("compression", "none").parquet(path)
    return spark.read.schema(BUNDLE).parquet(path)


def index(archives: DataFrame) -> DataFrame:
    """``(record_id, bundle, frame, offset, length)`` of every record."""
    return archives.select("bundle", F.explode("entries").alias("e")).select("e.record_id", "bundle", "e.frame", "e.offset", "e.length")


def frames(archive: bytes) -> list[tuple[int, int, int]]:
    """``(start, packed size, size)`` of each frame, from the seek table at the end alone."""
    count, descriptor, magic = _FOOTER.unpack(archive[-_FOOTER.size :])
    if magic != SEEKABLE_MAGIC or descriptor & 0x80:
        raise ValueError("no seek table without checksums at the end")
    table = memoryview(archive)[-_FOOTER.size - 8 * count : -_FOOTER.size]
    out, start = [], 0
    for packed, size in struct.iter_unpack("<II", table):
        out.append((start, packed, size))
        start += packed
    return out


def _unpacked(archive: bytes, place: tuple[int, int, int]) -> bytes:
    start, packed, size = place
    return zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=size)


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at ``at``."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    stop = head_end + 4 + int(headers["Content-Length"])
    return headers, data[head_end + 4 : stop], stop + 4


def _described(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']} does not hold the payload that it announces")
    first = headers.get("WARC-Refers-To")
    return _page_of(headers["WARC-Record-ID"]), size, digest, kind, None if first is None else _page_of(first)


_READ = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_READ_ARROW = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _read(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column(0):
            archive = value.as_py()
            for place in frames(archive):
                data, at, rows = _unpacked(archive, place), 0, []
                while at < len(data):
                    headers, block, at = _parse(data, at)
                    rows.append(_described(headers, block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ_ARROW)], _READ)


def read(archives: DataFrame, id_type: str = "long", id_col: str = "page_id") -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of every record, from the archives alone.

    Length and digest are those of the full payload, also for revisits; each response's payload is checked against
    them. A damaged record fails the job.
    """
    schema = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    rows = archives.select("archive").mapInArrow(_read, schema)
    return rows.select(
        F.col("id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to")
    )


def _fetch(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, wanted in zip(batch.column(0), batch.column(1)):
            archive = archive.as_py()
            places, opened, data = frames(archive), None, b""
            for entry in sorted(wanted.as_py(), key=lambda e: (e["frame"], e["offset"])):
                if entry["frame"] != opened:
                    opened, data = entry["frame"], _unpacked(archive, places[entry["frame"]])
                found = data[entry["offset"] : entry["offset"] + entry["length"]]
                yield pa.RecordBatch.from_arrays([pa.array([entry["record_id"]]), pa.array([found], pa.binary())], ["record_id", "record"])


def fetch(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(record_id, record)`` for the record ids in ``wanted``; only the frames that hold them are decompressed."""
    places = index(archives).join(wanted.select("record_id").distinct(), "record_id")
    entry = F.struct("record_id", "frame", "offset", "length")
    by_bundle = places.groupBy("bundle").agg(F.collect_list(entry).alias("wanted"))  # at most a bundle's records
    return archives.join(by_bundle, "bundle").select("archive", "wanted").mapInArrow(_fetch, "record_id string, record binary")
