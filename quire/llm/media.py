"""Media columns: payloads as losslessly coded images in archives, read back by a Spark data source.

``write_media`` stores each row's text as UTF-8, padded with spaces to rows of 192 samples, as an 8-bit grey PNG (filter
0, so the payload's bytes are the image's samples), and collects the PNGs as members of ZIP archives of about
``archive_bytes``, one stream per task.  A manifest table lists the archives of tasks that were committed, so leftovers
of lost or repeated tasks are never read.

``spark.read.format("media_archive")`` plans byte ranges of the listed archives (option ``splitBytes``); a task reads
the archive's directory, takes the members that begin in its range, and streams their stored bytes in Arrow batches
of bounded size.  A member that can't be read is tried again by itself, from its offset, ``retries`` times with a new
stream; members before it are not read again.  One that stays unreadable fails the task, or with ``onError=null`` comes
as null media.

Defined results: null text is stored as the empty text; a null doc_id is kept; repeated rows are stored once a row; an
empty table gives no archive and no rows; columns other than doc_id and text are ignored.  ``feature`` describes the
samples: mean and deviation, and an 8 x 8 bit map of which cells are brighter than the mean.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.llm.common import fresh_path, table

ROW = 192
ARCHIVE_BYTES, SPLIT_BYTES, BATCH_BYTES, RETRIES = 64 << 20, 16 << 20, 8 << 20, 3
#: Partitions that a read is planned in at most, however large the archives are.
MOST_TASKS = 20_000
_PNG = b"\x89PNG\r\n\x1a\n"
_SCHEMA = "doc_id long, n_bytes long, archive string, offset long, media binary"
_LOCAL_HEADER = struct.Struct("<IHHHHHIIIHH")  # a fixed layout of the ZIP format


def pad(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of the image's row."""
    return payload.ljust(max(-(-len(payload) // ROW), 1) * ROW, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: bytes, level: int = 6) -> bytes:
    """8-bit grey image whose samples, row by row, are ``samples``."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image of ``encode_png``; checks every chunk's CRC."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("PNG chunk with a wrong CRC")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a PNG filter that is not written here")
    return lines[:, 1:].tobytes()


def describe(samples: bytes) -> str:
    """Mean, deviation and an 8 x 8 map of brighter cells of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64)
    mean = x.mean()
    cells = np.add.reduceat(x, np.arange(64) * len(x) // 64) / np.maximum(np.diff(np.append(np.arange(64) * len(x) // 64, len(x))), 1)
    return f"{mean:.3f};{x.std():.3f};{int.from_bytes(np.packbits(cells > mean).tobytes(), 'big'):016x}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Archives:
    """ZIP archives of one task attempt, started anew when one is full."""

    def __init__(self, folder: str, archive_bytes: int) -> None:
        self.files, self.folder = _open(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.archive_bytes, self.zip, self.buffer, self.members = archive_bytes, None, io.BytesIO(), 0

    def add(self, doc_id: int | None, n_bytes: int, media: bytes) -> tuple[str, int, int] | None:
        """(name, bytes, members) of the archive that this member fills."""
        if self.zip is None:
            self.buffer, self.members = io.BytesIO(), 0
            self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        self.zip.writestr(zipfile.ZipInfo(f"{self.members}/{'' if doc_id is None else doc_id}/{n_bytes}.png"), media)
        self.members += 1
        return self.close() if self.buffer.tell() >= self.archive_bytes else None

    def close(self) -> tuple[str, int, int] | None:
        if self.zip is None:
            return None
        self.zip.close()
        self.zip = None
        name, data = f"{uuid.uuid4().hex}.zip", self.buffer.getbuffer()
        with self.files.open_output_stream(f"{self.folder}/{name}") as out:
            out.write(data)
        return name, len(data), self.members


def write_media(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Stores every row of ``docs`` (doc_id, text) in archives under ``folder``; returns ``folder``."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, done = _Archives(f"{folder}/archives", archive_bytes), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                done.append(archives.add(doc_id, len(text or b""), encode_png(pad(text or b""))))
        done = [x for x in [*done, archives.close()] if x]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "bytes", "members"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows.mapInArrow(store, "name string, bytes long, members long").write.parquet(f"{folder}/manifest")
    return folder


@dataclass
class ByteRange:
    archive: str
    begin: int
    end: int


@dataclass
class ByteRanges(InputPartition):
    """Ranges that one task reads, one after another."""

    ranges: list[ByteRange]


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].rstrip("/")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.retries = int(options.get("retries", RETRIES))
        self.keep_going = options.get("onerror", "fail") == "null"

    def partitions(self) -> list[ByteRanges]:
        """Byte ranges of the committed archives, in ``MOST_TASKS`` partitions at most; no archive is opened for it."""
        import pyarrow.dataset as ds

        files, folder = _open(f"{self.folder}/manifest")
        names = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
        listed = ds.dataset(names, filesystem=files, format="parquet").to_table().to_pylist() if names else []
        n = sum(-(-x["bytes"] // self.split) for x in listed)
        split = self.split * max(-(-n // MOST_TASKS), 1)  # past an archive's end where that is smaller
        ranges = [ByteRange(f"{self.folder}/archives/{x['name']}", at, min(at + split, x["bytes"])) for x in sorted(listed, key=lambda x: x["name"]) for at in range(0, x["bytes"], split)]
        each = max(-(-len(ranges) // MOST_TASKS), 1)
        return [ByteRanges(ranges[at : at + each]) for at in range(0, len(ranges), each)] or [ByteRanges([])]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self._read(one)

    def _read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        files, path = _open(partition.archive)
        batch, held = [], 0
        for offset, size, name in self._members(files, path, partition):
            media = self._member(files, path, offset, size)
            _, doc_id, n_bytes = name.removesuffix(".png").split("/")
            batch.append((int(doc_id) if doc_id else None, int(n_bytes), partition.archive, offset, media))
            held += size
            if held >= BATCH_BYTES or len(batch) >= 4096:
                yield _batch(batch)
                batch, held = [], 0
        if batch:
            yield _batch(batch)

    def _members(self, files: fs.FileSystem, path: str, part: ByteRange) -> list[tuple[int, int, str]]:
        """(offset, size, name) of the members that begin within the range, from the archive's directory."""
        with files.open_input_file(path) as stream, zipfile.ZipFile(stream) as archive:
            return sorted((i.header_offset, i.file_size, i.filename) for i in archive.infolist() if part.begin <= i.header_offset < part.end)

    def _member(self, files: fs.FileSystem, path: str, offset: int, size: int) -> bytes | None:
        for attempt in range(self.retries + 1):
            try:
                return read_member(files, path, offset, size)
            except (OSError, ValueError) as problem:
                if attempt == self.retries:
                    if self.keep_going:
                        return None
                    raise OSError(f"{path}: the member at {offset} can't be read: {problem}") from problem
                time.sleep(0.05 * 2**attempt)
        return None


def read_member(files: fs.FileSystem, path: str, offset: int, size: int) -> bytes:
    """A stored member's bytes by its header's offset; verified by the header's CRC."""
    with files.open_input_file(path) as stream:
        stream.seek(offset)
        signature, _, _, _, _, _, crc, _, _, name, extra = _LOCAL_HEADER.unpack(stream.read(_LOCAL_HEADER.size))
        stream.seek(offset + _LOCAL_HEADER.size + name + extra)
        data = stream.read(size)
    if signature != 0x04034B50 or len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("member does not match its header")
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "archive", "offset", "media"])


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)`` of what ``write_media`` stored."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader({k.lower(): v for k, v in self.options.items()})


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media (doc_id, n_bytes, media), from the payload that decodes from them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for media in batch.column(2).to_pylist():
                payload = decode_png(media)
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").where("media IS NOT NULL").mapInArrow(each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_media(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read_media(spark, write_media(table(spark, sf_dir, "documents"), fresh_path(spark, "media"))))
