"""Media columns: byte-range reads over directories of archives.

Texts become 8-bit grey images (PNG, 64 samples a row), stored as members of
ZIP archives below one directory. :class:`ArchiveSource` is a Spark data source
that plans byte ranges over those archives, so one large archive is read by
many tasks; every task streams its members in Arrow batches and reads a member
again by its offset when a read falls short or fails its checksum.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import column, fresh_path, row_slices, text_bytes

WIDTH = 64
#: An archive is closed and a new one begun after this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Bytes of an archive that one task reads.
RANGE_BYTES = 8 << 20
#: Ranges of one read about (one more an archive at most); beyond, they grow with the archives.
MOST_RANGES = 50_000
#: Payload bytes in one Arrow batch.
BATCH_BYTES = 4 << 20

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    """``raw`` followed by zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(raw: bytes) -> bytes:
    """A lossless grey image of the padded bytes; the unpadded length is kept as a text chunk."""
    rows = np.frombuffer(pad(raw), dtype=np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # filter type 0 before every row
    scan[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(scan, 6)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """The payload of an image made by :func:`encode_png` and its unpadded length."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, n_bytes, height = 8, [], -1, 0
    while at < len(media):
        size = struct.unpack_from(">I", media, at)[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        at += 12 + size
    scan = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, WIDTH + 1)
    return scan[:, 1:].tobytes(), n_bytes


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _ArchiveWriter:
    """Archives of one task attempt. Names hold the attempt, so a repeated task never clashes."""

    def __init__(self, uri: str) -> None:
        self.fs, self.root = _filesystem(uri)
        task = TaskContext.get()
        self.stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}" if task else "part-000000-0"
        self.count, self.zip = 0, None

    def add(self, name: str, media: bytes) -> Iterator[tuple[str, int, int]]:
        if self.zip is None:
            self.path = f"{self.root}/{self.stem}-{self.count:04d}.zip"
            self.sink = self.fs.open_output_stream(self.path)
            self.zip, self.members, self.bytes = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED), 0, 0
        self.zip.writestr(zipfile.ZipInfo(name), media)
        self.members, self.bytes = self.members + 1, self.bytes + len(media)
        if self.bytes >= ARCHIVE_BYTES:
            yield from self.close()

    def close(self) -> Iterator[tuple[str, int, int]]:
        if self.zip is not None:
            self.zip.close()
            size = self.sink.tell()
            self.sink.close()
            self.zip, self.count = None, self.count + 1
            yield self.path.rpartition("/")[2], size, self.members


def write_archives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Store every text of ``docs`` as an image in archives of a new shared directory; return its URI.

    A null text is stored as the empty one. Member names are ``<n>-<id>.png``,
    with an empty id for null, so repeated ids stay apart. Which archives count
    is said by the table ``manifest`` beside them, committed by Spark: what a
    failed or doubled task attempt left behind is not in it.
    """
    uri = fresh_path(docs.sparkSession, "archives")
    fs, root = _filesystem(uri)
    fs.create_dir(root, recursive=True)

    def write(batches):
        out, n, done = _ArchiveWriter(uri), 0, []
        for batch in row_slices(batches):
            for doc_id, raw in zip(column(batch, "id").to_pylist(), text_bytes(batch), strict=True):
                done += out.add(f"{n:09d}-{'' if doc_id is None else doc_id}.png", encode_png(raw))
                n += 1
        done += out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "bytes", "members"])

    rows = docs.select(docs[id_column].cast("string").alias("id"), docs[text_column].alias("text"))
    rows.mapInArrow(write, "archive string, bytes long, members long").write.parquet(f"{uri}/manifest")
    return uri


class ArchiveRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int) -> None:
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))
        self.on_error = options.get("onerror", "raise")

    def partitions(self) -> list[ArchiveRange]:
        """One partition per byte range of each archive; only names and sizes pass the driver."""
        fs, root = _filesystem(self.uri)
        if fs.get_file_info(f"{root}/manifest").type == pafs.FileType.Directory:
            found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/manifest")) if f.path.endswith(".parquet")]
            sizes = [(r["archive"], r["bytes"]) for f in found for r in pq.read_table(f, filesystem=fs).to_pylist()]
        else:
            sizes = [(f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(root)) if f.extension == "zip"]
        step = max(self.range_bytes, -(-sum(size for _, size in sizes) // MOST_RANGES))
        return [ArchiveRange(name, at, min(size, at + step)) for name, size in sorted(sizes) for at in range(0, size, step)] or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._members(partition):
            rows.append(row)
            held += len(row[4] or b"")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _members(self, partition: ArchiveRange) -> Iterator[tuple]:
        if not partition.archive:
            return
        fs, root = _filesystem(self.uri)
        path = f"{root}/{partition.archive}"
        with fs.open_input_file(path) as file:
            with zipfile.ZipFile(file) as archive:  # reads the directory at the archive's end
                own = sorted((x for x in archive.infolist() if partition.start <= x.header_offset < partition.end), key=lambda x: x.header_offset)
            if not own:
                return
            last = own[-1]
            file.seek(own[0].header_offset)
            block = file.read(last.header_offset + 30 + 65_536 + last.compress_size - own[0].header_offset)
        for info in own:
            media, error = None, None
            for attempt in range(self.retries + 1):
                try:
                    if attempt == 0:
                        media = _member(info, block, own[0].header_offset)
                    else:
                        time.sleep(min(2.0, 0.05 * 2**attempt))
                        with fs.open_input_file(path) as again:
                            again.seek(info.header_offset)
                            media = _member(info, again.read(30 + 65_536 + info.compress_size), info.header_offset)
                    error = None
                    break
                except (OSError, ValueError, struct.error, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
            if error and self.on_error == "raise":
                raise OSError(f"member {info.filename} of {path} at {info.header_offset}: {error}")
            yield partition.archive, info.filename, info.header_offset, info.file_size, media, error


def _member(info: zipfile.ZipInfo, block: bytes, block_at: int) -> bytes:
    at = info.header_offset - block_at
    if block[at : at + 4] != b"PK\x03\x04":
        raise ValueError("no member header")
    name, extra = struct.unpack_from("<HH", block, at + 26)
    at += 30 + name + extra
    data = block[at : at + info.compress_size]
    if len(data) < info.compress_size:
        raise ValueError("short read")
    if info.compress_type == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    if zlib.crc32(data) != info.CRC:
        raise ValueError("checksum differs")
    return bytes(data)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["archive", "member", "offset", "length", "media", "error"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(directory)``.

    Options: ``rangeBytes``, ``retries`` and ``onError`` (``raise``, or ``row``
    to return a row whose ``media`` is null and whose ``error`` says why).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, length long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in dict(self.options).items()})


def read_archives(spark: SparkSession, uri: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(uri)


def feature(payload: bytes) -> str:
    """How many samples lie in each sixteenth of the range, comma-joined."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8) >> 4, minlength=16)
    return ",".join(map(str, counts.tolist()))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Decode members read by :func:`read_archives` and describe them, one row each.

    The id is taken from the member's name. An empty directory gives no rows.
    """

    def describe(batches):
        for batch in batches:
            out = []
            for member, media in zip(column(batch, "member").to_pylist(), column(batch, "media").to_pylist(), strict=True):
                payload, n_bytes = decode_png(media)
                name = member.partition("-")[2].removesuffix(".png")
                out.append((int(name) if name else None, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select("member", "media").mapInArrow(describe, FEATURES)


def media_column(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Store all texts as images in archives, read them back and return :data:`FEATURES`.

    Null and empty texts have 0 bytes and one row of zero samples. Repeated rows
    give repeated rows; equal texts give equal values; a null id stays null.
    Other columns of ``docs`` are not looked at. Empty input gives no rows.
    """
    return media_features(read_archives(docs.sparkSession, write_archives(docs, id_column, text_column), **options))
