"""WARC archives compressed with Zstandard, one frame per record, dictionary in the leading skippable frame.

Writing: payloads are digested, the record with the smallest id of each group of equal payloads becomes the
response and the others revisit it; every task appends its records to archive files in a shared folder.
Reading: `read_archives` takes (path, content) rows, such as Spark's binaryFile reader gives, loads the
dictionary from the skippable frame, decodes frame by frame and checks headers, lengths and digests.

Defined results: a null payload is an empty one; a null URL is written as none and read as null; repeated
(id, payload) rows are written one by one, each that has the smallest id as a response; a row without an id
revisits the smallest one, or is a response where none has an id; an empty table writes
no archive and reads as no row. Damaged archives raise ArchiveError, naming the record.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs as pa_fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_at_exit, shared_dir, slices, spread_join, stored

#: Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
#: An archive is closed once it is this large; the dictionary learns from so many payloads of at most so many bytes.
ARCHIVE_BYTES = 16 << 20
SAMPLED, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 15, 1 << 16


class ArchiveError(ValueError):
    """What is wrong in an archive, and where."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def dictionary_from(payloads: list[bytes]) -> bytes:
    """A trained dictionary, or none where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes() if len(payloads) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def name_of(page_id: int | None) -> bytes:
    return b"none" if page_id is None else b"%d" % page_id


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One uncompressed WARC record; a revisit has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [VERSION, b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: <urn:page:%s>" % name_of(page_id), b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode("utf-8", "surrogatepass"))
    lines.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if refers_to is not None:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Collects the frames of one archive file."""

    def __init__(self, dictionary: bytes, level: int = 3):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
        self.parts = [struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed]
        self.size = len(self.parts[0])

    def add(self, raw: bytes) -> None:
        self.parts.append(self.compressor.compress(raw))
        self.size += len(self.parts[-1])


def frames(content: bytes, where: str = "archive") -> Iterator[bytes]:
    """The decoded records of an archive: its dictionary is in the leading skippable frame, then one frame a record."""
    if len(content) < 8:
        raise ArchiveError(f"{where}: shorter than a frame header")
    magic, length = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ArchiveError(f"{where}: no dictionary frame at the start")
    if 8 + length > len(content):
        raise ArchiveError(f"{where}: the dictionary frame is cut short")
    dictionary = content[8 : 8 + length]
    if dictionary[:4] == struct.pack("<I", ZSTD_FRAME):
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decompressor = zstandard.ZstdDecompressor(dict_data=known)
    at, view = 8 + length, memoryview(content)
    while at < len(content):
        magic = int.from_bytes(content[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F and at + 8 <= len(content):
            at += 8 + int.from_bytes(content[at + 4 : at + 8], "little")
            continue
        if magic != ZSTD_FRAME:
            raise ArchiveError(f"{where}: no frame at byte {at}")
        one, out, step = decompressor.decompressobj(), [], 1 << 16
        try:
            while not one.eof and at < len(content):
                got = view[at : at + step]
                out.append(one.decompress(got))
                at += len(got) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"{where}: frame before byte {at} doesn't decode: {e}") from e
        if not one.eof:
            raise ArchiveError(f"{where}: the last frame is cut short")
        yield b"".join(out)


def parse(raw: bytes, where: str = "record") -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, lengths checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.1", b"WARC/1.0"):
        raise ArchiveError(f"{where}: no WARC version line or no end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ArchiveError(f"{where}: header without a colon")
        headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "surrogatepass")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"{where}: {name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"{where}: the block's length isn't what Content-Length says")
    return headers, rest[:-4]


def read_record(raw: bytes, where: str) -> tuple[int | None, str | None, str, int, str, int | None, bytes | None]:
    """page_id, url, type, payload bytes, digest, refers_to and payload (null for revisits)."""
    headers, block = parse(raw, where)
    http, found, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: *(\d+)", http)
    own = re.fullmatch(r"<urn:page:(-?\d+|none)>", headers["warc-record-id"])
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not found or not length or not own:
        raise ArchiveError(f"{where}: no HTTP header with a length, or a foreign record id")
    page_id = None if own[1] == "none" else int(own[1])
    if headers["warc-type"] == "revisit":
        other = re.fullmatch(r"<urn:page:(-?\d+)>", headers.get("warc-refers-to", ""))
        if not other or payload:
            raise ArchiveError(f"{where}: a revisit refers to one record and has no payload")
        return page_id, headers.get("warc-target-uri"), "revisit", int(length[1]), digest, int(other[1]), None
    if headers["warc-type"] != "response" or len(payload) != int(length[1]) or digest_of(payload) != digest:
        raise ArchiveError(f"{where}: not a response, or its payload's length or digest differs")
    return page_id, headers.get("warc-target-uri"), "response", len(payload), digest, None, payload


#: Digests that several records share are broadcast up to this many rows (60 bytes each).
BROADCAST_ROWS = 200_000


def referred(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Rows with the smallest id of their digest's records (null where it is alone). first: sha, first, c."""
    if first.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(first.drop("c")), "sha", "left")
    alone = rows.join(first.select("sha"), "sha", "left_anti").withColumn("first", F.lit(None).cast("long"))
    return spread_join(rows, first, ["sha"], "c").drop("c").unionByName(alone)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes all rows to archives in `folder` and returns (path, records) of the finished ones.

    Files are renamed into place when complete; those of a task that ran twice have other names, and only the
    names that this frame returns count. Store the result before reading: each run writes anew.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # One small row per digest that occurs twice or more and is long enough; counts are combined before the shuffle.
    first = rows.select("page_id", "sha", F.octet_length("payload").alias("n")).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("c"), F.first("n").alias("n")).where((F.col("c") > 1) & (F.col("n") >= least_bytes)).select("sha", "first", "c")
    rows = referred(rows, stored(first, "digests")).select("page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))
    small = pages.select(F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("p"), F.col(id_col).alias("i")).where(F.octet_length("p").between(1, SAMPLE_BYTES))
    ids = small.select("i", F.xxhash64("i").alias("h")).orderBy("h", "i").limit(SAMPLED).select("i").distinct()
    sample = small.join(F.broadcast(ids), "i").orderBy("i", "p").limit(SAMPLED)  # SAMPLED ids at most
    dictionary = dictionary_from([bytes(r[0]) for r in sample.select("p").collect()])  # SAMPLED * SAMPLE_BYTES at most
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, target = pa_fs.FileSystem.from_uri(folder)
        system.create_dir(target, recursive=True)
        archive, n = Archive(dictionary), 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{target}/{name}.part") as out:
                for x in archive.parts:
                    out.write(x)
            system.move(f"{target}/{name}.part", f"{target}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            for part in slices(batch):
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    archive.add(record(page_id, url, payload, digest_of(payload), refers_to, date))
                    n += 1
                    if archive.size >= ARCHIVE_BYTES:
                        yield close()
                        archive, n = Archive(dictionary), 0
        if n:
            yield close()

    return rows.mapInArrow(write, "path string, records bigint")


READ = "path string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archives given as (path string, content binary); payloads are checked even if not returned."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for i, raw in enumerate(frames(content.as_py(), path)):
                    page_id, url, kind, n, digest, other, payload = read_record(raw, f"{path}, record {i}")
                    rows.append((path, page_id, url, kind, n, digest, other, payload if payloads else None))
                    held += len(raw) if payloads else 200
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def round_trip(pages: DataFrame, least_bytes: int = 0, payloads: bool = False, **columns: str) -> DataFrame:
    """Writes `pages` as archives in the shared folder and reads them back; fails if a record got lost."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/evisieve/warc-{uuid.uuid4().hex}"
    listing = f"{folder}-list"
    write_archives(pages, folder, least_bytes, **columns).write.parquet(listing)
    for path in (folder, listing):
        delete_at_exit(spark, path)
    written = spark.read.schema("path string, records bigint").parquet(listing)
    # Only archives of finished tasks are listed, and only those are read.
    archives = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(f"{folder}") if written.take(1) else spark.createDataFrame([], "path string, content binary")
    name = lambda c: F.substring_index(c, "/", -1)
    listed = written.select(name("path").alias("name")).distinct()
    archives = archives.withColumn("name", name(F.col("path"))).where(F.col("name").endswith(".warc.zst"))
    archives = archives.join(F.broadcast(listed), "name", "left_semi")  # a name per ARCHIVE_BYTES of output
    return read_archives(archives, payloads)
