"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some records;
then a skippable frame with the record map (record id, frame, offset in that
frame, length); last, a skippable frame with the seek table, whose footer ends
the file. A reader fetches the footer, from it the table and the map, and then
only the frames it needs, each by a ranged read; plain decompressors read the
records in sequence. ``locate`` makes one table of where every record of a folder lies,
``fetch`` takes single records from there: one ranged read of one frame each.

Each input partition writes its own bundles with Spark's file committer (a text
sink with one row a file, whose line end is the footer's last four bytes), so a
task that is run again leaves no half bundles, and any store that Spark can write
serves. They are read back whole with Spark's binary file source, or in ranges by
Hadoop's file systems. Memory holds one bundle of ``bundle_bytes`` and one record.

Payloads of ``dedup_bytes`` or more that are equal are kept once, with the smallest
page id; the others become revisit records, which carry no payload and so are made from
the narrow table that found them. Payloads are not shuffled: their rows are kept where
they are read, but for the revisits, whose ids are broadcast if they were counted to be
few (``BROADCAST_IDS``); more of them are taken out by a shuffle.

Nulls: a null html is an empty payload, a null url leaves out the target; a page
with a null id is never a revisit and keeps a null id. Of repeated rows with the
smallest id each is a response. A payload of any length is one record in one frame.
Further columns are ignored, whatever their names. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, ready, table

#: Fixed values of the Zstandard formats.
SKIPPABLE, MAP_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")
MAGIC = struct.pack("<I", SEEKABLE)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else ""
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but tells its length and digest."""
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha256:{digest}"}
    if url:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head["Content-Type"] = "application/http; msgtype=response"
    else:
        block = b""
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Payload-Length": str(size)}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record's length is wrong")
    told = field["WARC-Payload-Digest"].removeprefix("sha256:")
    if field["WARC-Type"] == "revisit":
        return page_of(field["WARC-Record-ID"]), int(field["X-Payload-Length"]), told, "revisit", page_of(field["WARC-Refers-To"]), None
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(payload).hexdigest()
    if digest != told:
        raise ValueError("a payload doesn't have its digest")
    return page_of(field["WARC-Record-ID"]), len(payload), digest, "response", None, payload


class Bundle:
    """Collects records into frames of about frame_bytes each."""

    def __init__(self, frame_bytes: int, level: int):
        self.packer, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self.parts: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.map: list[tuple[str, int, int, int]] = []
        self.open, self.size = bytearray(), 0

    def add(self, urn: str, data: bytes) -> None:
        self.map.append((urn, len(self.table), len(self.open), len(data)))
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            self._part(self.packer.compress(bytes(self.open)), len(self.open))
            self.open = bytearray()

    def _part(self, data: bytes, raw: int) -> None:
        self.parts.append(data)
        self.table.append((len(data), raw))
        self.size += len(data)

    def finish(self) -> bytes:
        self.close_frame()
        index = self.packer.compress(json.dumps(self.map, separators=(",", ":")).encode())
        self._part(struct.pack("<II", MAP_FRAME, len(index)) + index, 0)
        body = b"".join(ENTRY.pack(*e) for e in self.table) + FOOTER.pack(len(self.table), 0, SEEKABLE)
        return b"".join([*self.parts, struct.pack("<II", SKIPPABLE, len(body)), body])


class Held:
    """A bundle in memory, as a source."""

    def __init__(self, data: bytes):
        self.data, self.size = memoryview(data), len(data)

    def read(self, at: int, n: int) -> bytes:
        return bytes(self.data[at : at + n])


class Ranged:
    """A file in any store that Spark reads, as a source of ranges; told counts the bytes that were read."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs, self.path, self.jvm, self.told = p.getFileSystem(spark._jsc.hadoopConfiguration()), p, spark._jvm, 0
        self.size = self.fs.getFileStatus(p).getLen()

    def read(self, at: int, n: int) -> bytes:
        stream = self.fs.open(self.path)
        try:
            stream.seek(at)
            data = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()
        self.told += len(data)
        return data


class BundleReader:
    """Random access by record number or id; only what is asked for is read: the footer, the table, the map, then frames."""

    def __init__(self, source: Held | Ranged | bytes):
        self.source = source = Held(source) if isinstance(source, bytes) else source
        n, _, magic = FOOTER.unpack(source.read(source.size - FOOTER.size, FOOTER.size)) if source.size >= FOOTER.size else (0, 0, 0)
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end")
        self.starts, self.sizes, start = [], [], 0
        for packed, _ in ENTRY.iter_unpack(source.read(source.size - FOOTER.size - n * ENTRY.size, n * ENTRY.size)):
            self.starts.append(start)
            self.sizes.append(packed)
            start += packed
        self.unpacker, self.frame_no, self.frame = zstandard.ZstdDecompressor(), -1, b""
        self.map = json.loads(self.unpacker.decompress(self._part(n - 1)[8:]))
        self.by_id: dict[str, list[int]] | None = None

    def _part(self, i: int) -> bytes:
        return self.source.read(self.starts[i], self.sizes[i])

    def read(self, i: int) -> bytes:
        _, frame, offset, length = self.map[i]
        if frame != self.frame_no:
            self.frame_no, self.frame = frame, self.unpacker.decompress(self._part(frame))
        return self.frame[offset : offset + length]

    def find(self, urn: str) -> list[bytes]:
        if self.by_id is None:
            self.by_id = defaultdict(list)
            for i, m in enumerate(self.map):
                self.by_id[m[0]].append(i)
        return [self.read(i) for i in self.by_id.get(urn, [])]


def bundler(frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(frame_bytes, level)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([bundle.finish().removesuffix(MAGIC)], pa.binary())], names=["content"])
        for b in batches:
            for page, url, html, refers_to, digest, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = (html or "").encode()
                if refers_to is None:
                    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                bundle.add(record_id(page), record(page, url, payload, size, digest, refers_to))
                if bundle.size >= bundle_bytes:
                    yield out()
                    bundle = Bundle(frame_bytes, level)
        if bundle.map:
            yield out()

    return run


def revisits(pages: DataFrame, dedup_bytes: int, scratch: Scratch) -> DataFrame:
    """page_id, url, refers_to, digest and size of pages whose payload a page with a smaller id has.

    The list of firsts is written, so that the join has nothing but exchanges under it
    and a common payload's rows can be split.
    """
    long = pages.where(F.octet_length("html") >= dedup_bytes).select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    first = long.groupBy(F.col("digest").alias("_same")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = scratch.save(first, "first")
    return long.join(first, F.col("digest") == F.col("_same")).where("refers_to < page_id").select("page_id", "url", "refers_to", "digest", "size")


def write(pages: DataFrame, path: str, scratch: Scratch, dedup_bytes: int = 100, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, level: int = 3) -> None:
    """Writes page_id, url, html as bundles into the folder path."""
    ready(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    again = scratch.save(revisits(pages, dedup_bytes, scratch), "revisits")
    ids = scratch.save(again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_same")).distinct(), "revisit_ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS // 8 else ids  # a row with its digest is some 100 bytes
    digest = F.when(F.octet_length("html") >= dedup_bytes, F.sha2(F.col("html").cast("binary"), 256))
    none = F.lit(None)
    kept = pages.withColumn("_digest", digest).join(ids, (F.col("page_id") == F.col("_page")) & (F.col("_digest") == F.col("_same")), "left_anti")
    rows = kept.select("page_id", "url", "html", none.cast("long").alias("refers_to"), none.cast("string").alias("digest"), none.cast("long").alias("size"))
    rows = rows.unionByName(again.withColumn("html", none.cast("string")))
    bundles = rows.mapInArrow(bundler(frame_bytes, bundle_bytes, level), "content binary").select(F.col("content").cast("string"))
    bundles.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path and content of bundles in; where each record lies out."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = content.as_py()
            if data:
                reader = BundleReader(data)
                rows = [(page_of(urn), path, reader.starts[f], reader.sizes[f], offset, n) for urn, f, offset, n in reader.map]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["page_id", "path", "frame_at", "frame_bytes", "offset", "length"])


def locate(spark: SparkSession, path: str) -> DataFrame:
    """page_id, path, frame_at, frame_bytes, offset, length of every record; to be written, sorted by page_id, for fetch."""
    ready(spark)
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(placed, "page_id long, path string, frame_at long, frame_bytes long, offset long, length long")
    return rows.repartitionByRange("page_id").sortWithinPartitions("page_id")


def fetch(index: DataFrame, page_ids: Iterable[int], opened: dict[str, Ranged] | None = None) -> list[tuple]:
    """Parsed records of some pages (as parse gives them), by ranged reads of their frames alone, on the driver. opened: the sources, kept by path."""
    spark, opened, out = index.sparkSession, {} if opened is None else opened, []
    for r in index.where(F.col("page_id").isin(*page_ids)).orderBy("path", "frame_at", "offset").collect():
        if r.path not in opened:
            opened[r.path] = Ranged(spark, r.path)
        frame = zstandard.ZstdDecompressor().decompress(opened[r.path].read(r.frame_at, r.frame_bytes))
        out.append(parse(frame[r.offset : r.offset + r.length]))
    return out


def unbundle(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                if not data:
                    continue
                reader, rows = BundleReader(data), []
                for i in range(len(reader.map)):
                    row = parse(reader.read(i))
                    rows.append(row if with_payload else (*row[:5], None))
                    if len(rows) == 1000 or i + 1 == len(reader.map):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                        rows = []

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all bundles in path, each found by the record map."""
    ready(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unbundle(with_payload), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), scratch.path("bundles"), scratch)
    return read(spark, scratch.path("bundles"), with_payload=False).drop("payload")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d
)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f < page_id THEN f END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""
