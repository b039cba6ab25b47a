"""WARC archives as seekable Zstandard bundles.

Every task streams its rows into bundle files: records are grouped into independent frames,
and a seek table in a skippable frame at the end lists every frame's compressed and
uncompressed size. An index table maps each record to bundle, frame, and offset in the
frame. Equal payloads are found by digest with a pre-aggregated group and one join (hot
payloads are split by adaptive execution); the one with the largest page_id is stored as a
response, the others as revisits without a payload.

A response holds an HTTP message with the page as its body; a revisit names the response by
profile, target, date and, where one record has that page, identifier. Identifiers are
unique: that of a page that stands for others follows from its content, all others from
their place.

The folder is qualified by Hadoop, so a path without a scheme means the default file system.
Bundles go to any place that pyarrow's file systems reach; others are refused before any work
is done. Each attempt of a task writes to names of its own, and only files that the committed
index names count, so lost executors and repeated tasks leave at most unused files.

Defined cases: null html is an empty payload; null page_id and url are kept as such, and
characters of a url that a header can't hold are percent-encoded; repeated rows of the
winning page are responses alike; an empty table gives no bundle and no rows; other columns
are left out. A long page has a frame of its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wallscope.llm.arrow import bound_batches
from wallscope.session import materialize, scratch_path

# The skippable frame of a seek table and the number that ends it.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
#: All records carry one date, so that a repeated task writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the archive format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Printable ASCII stays as it is in a header, a percent sign too.
PLAIN = "!\"#$%&'()*+,/:;<=>?@[\\]^`{|}"
#: Names that Hadoop and pyarrow have for the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}
#: Bytes of payloads in a batch of records that were read.
BATCH_BYTES = 4 << 20

INDEX = "page_id bigint, record_id string, bundle string, frame bigint, frame_start bigint, offset bigint, length bigint"
RECORDS = (
    "page_id bigint, record_id string, url string, record_type string, refers_to bigint, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


class Place(NamedTuple):
    frame: int
    start: int
    offset: int
    length: int


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, uncompressed) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, uncompressed size) of every frame of a bundle."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    frames, start = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", bundle, len(bundle) - 9 - 8 * (count - i))
        frames.append((start, packed, plain))
        start += packed
    return frames


class BundleWriter:
    """Collects records into frames and writes the finished bundle in one piece."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.done, self.frames, self.open, self.places = [], [], [], []
        self.start = self.offset = self.size = 0

    def add(self, record: bytes) -> None:
        if self.open and self.offset + len(record) > self.frame_bytes:
            self.end_frame()
        self.places.append(Place(len(self.frames), self.start, self.offset, len(record)))
        self.open.append(record)
        self.offset += len(record)
        self.size += len(record)

    def end_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.done.append(packed)
            self.frames.append((len(packed), self.offset))
            self.start += len(packed)
            self.open, self.offset = [], 0

    def finish(self) -> bytes:
        self.end_frame()
        return b"".join(self.done) + seek_table(self.frames)


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def identifier(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def content_identifier(page_id: int | None, url: str | None, digest: str) -> str:
    """The identifier of the one response that others revisit."""
    return identifier("content", page_id, url, digest)


def record(name: str, page_id: int | None, url: str | None, refers_to: tuple | None, payload: bytes) -> bytes:
    """A record's bytes; ``refers_to`` (page_id, url, identifier or None) makes it a revisit."""
    body = HTTP % len(payload)
    if refers_to is None:
        body += payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(body)),
    ]
    head += [("WARC-Target-URI", quote(url, safe=PLAIN))] if url is not None else []
    if refers_to is not None:
        page, target, other = refers_to
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", page)]
        head += [("WARC-Refers-To-Target-URI", quote(target, safe=PLAIN))] if target is not None else []
        head += [("WARC-Refers-To", other)] if other is not None else []
    head += [("X-Page-ID", page_id)] if page_id is not None else []
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple]:
    """Rows of ``RECORDS`` of the records in ``raw``; the size of a revisited page is that of its HTTP header."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        body = raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        inner = body.index(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in body[:inner].decode().split("\r\n")[1:])
        number = lambda key: int(head[key]) if key in head else None
        yield (
            number("X-Page-ID"), head["WARC-Record-ID"], head.get("WARC-Target-URI"), head["WARC-Type"],
            number("X-Refers-To-Page"), head["WARC-Payload-Digest"].removeprefix("sha1:"),
            int(fields["Content-Length"]), body[inner + 4 :],
        )


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload; ``stands`` if this one record is what others revisit; ``refers_to``
    (page_id, url, digest, single): the page whose equal payload of ``least`` bytes or more is stored instead.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Equal rows first: whether one record or several have the winning page.
    alike = rows.where(F.length("payload") >= least).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    winner = F.max(F.struct("page_id", "url", F.col("n") == 1)).alias("winner")
    winners = alike.groupBy("digest").agg(winner, F.sum("n").alias("copies")).where("copies > 1")
    winners = winners.select("digest", F.struct("winner.page_id", "winner.url", "digest", F.col("winner.col3").alias("single")).alias("winner"))
    joined = rows.join(winners, "digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("winner.page_id"))
    stands = F.coalesce(F.col("winner.single") & own & F.col("url").eqNullSafe(F.col("winner.url")), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", stands.alias("stands"), F.when(~own & F.col("winner.page_id").isNotNull(), F.col("winner")).alias("refers_to"))


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as Hadoop understands it, in the form that pyarrow opens; fails if it can't."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    place = f"{SCHEMES.get(full.getScheme(), full.getScheme())}://{full.getAuthority() or ''}{full.getPath()}"
    try:
        fs.FileSystem.from_uri(place)
    except (OSError, ValueError) as error:
        raise ValueError(f"bundles can't be written to {root}: pyarrow doesn't open {place}") from error
    return place


def write(
    pages: DataFrame, root: str, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Write all pages to bundles below ``root``; returns the stored index table."""
    root = qualified(pages.sparkSession, root)
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        writer, names, count = BundleWriter(frame_bytes), [], 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            file = f"bundle-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{file}", compression=None) as out:
                out.write(writer.finish())
            return _batch([(p, n, file, *place) for (p, n), place in zip(names, writer.places)], INDEX)

        for batch in batches:
            for page_id, url, payload, digest, stands, other in zip(*(c.to_pylist() for c in batch.columns)):
                name = content_identifier(page_id, url, digest) if stands else identifier("place", task, count, page_id, url)
                if other is not None:
                    target = content_identifier(other["page_id"], other["url"], other["digest"]) if other["single"] else None
                    other = (other["page_id"], other["url"], target)
                writer.add(record(name, page_id, url, other, payload))
                names.append((page_id, name))
                count += 1
                if writer.size >= bundle_bytes:
                    yield flush()
                    writer, names = BundleWriter(frame_bytes), []
        if names:
            yield flush()

    return materialize(with_revisits(pages, least).mapInArrow(run, INDEX), "warc-index")


def read(spark: SparkSession, root: str, index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names, as ``RECORDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                for start, packed, plain in read_seek_table(bundle):
                    raw = zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], plain)
                    yield _batch(list(parse(raw)), RECORDS)

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.schema(schema).format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(root)
    # A stored list of names, a row per bundle, shows Catalyst how small it is: contents needn't be shuffled.
    named = materialize(index.select("bundle").distinct(), "bundles")
    files = files.select("content", F.element_at(F.split("path", "/"), -1).alias("bundle"))
    return files.join(named, "bundle", "left_semi").select("content").mapInArrow(run, RECORDS)


def fetch(root: str, rows: DataFrame) -> DataFrame:
    """The records of the given index rows: each bundle's seek table gives its frames, the index the places in them.

    Rows of a bundle come together, so each frame is read and decompressed once.
    """
    root = qualified(rows.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        opened, source, table, shown, plain = None, None, {}, None, b""
        held, size = [], 0
        for batch in batches:
            for file, frame, start, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != opened:
                    if source is not None:
                        source.close()
                    opened, source, shown = file, store.open_input_file(f"{base}/{file}"), None
                    table = dict(enumerate(tail_table(source)))
                if frame != shown:
                    first, packed, whole = table[frame]
                    if first != start:
                        raise ValueError(f"{file}: frame {frame} isn't where the index has it")
                    source.seek(first)
                    plain, shown = zstandard.ZstdDecompressor().decompress(source.read(packed), whole), frame
                held += parse(plain[offset : offset + length])
                size += length
                if size > BATCH_BYTES:
                    yield _batch(held, RECORDS)
                    held, size = [], 0
        if source is not None:
            source.close()
        if held:
            yield _batch(held, RECORDS)

    dealt = rows.select("bundle", "frame", "frame_start", "offset", "length").repartition("bundle")
    return dealt.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, RECORDS)


def tail_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """The seek table of an open bundle, read from its end."""
    size = source.size()
    source.seek(size - 9)
    count = struct.unpack("<IBI", source.read(9))[0]
    source.seek(size - 9 - 8 * count)
    return read_seek_table(source.read(9 + 8 * count))


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new folder of the shared space and read every record back by its place."""
    root = scratch_path(pages.sparkSession, "warc")
    return fetch(root, write(pages, root))
