"""Media columns: archives of media members as a Spark data source.

Writing: each task appends members to ZIP archives of about ``archive_bytes``, under names of its own,
so a repeated or speculative task never touches another's files; the driver's commit lists the
archives of the winning tasks in a manifest, and only those exist for a reader. Mode append adds a
manifest, overwrite replaces all. Reading: the driver
plans byte ranges over the archives' sizes alone. A task reads the index at its archive's end, takes
the members whose headers begin in its range, reads each by its offset, checks its CRC and sends them
on in Arrow batches of bounded size. A member that fails is read again by itself, on a new handle;
when all attempts fail the task fails, or with ``on_error=report`` the row carries the error.

Members are 8-bit PCM WAV files: bytes of the content, padded with zeros to a positive multiple of
64, are the samples; an ``olen`` chunk holds the unpadded length. Folders may be in any store that
pyarrow's file systems open.

Defined results: a null content is the empty one, padded to 64 zeros; a null key is the empty key;
repeated rows are members of their own, told apart by offset, and so are ties; a very long text is one
member, and one batch; a member that can't be read has its error and nulls; an empty table gives
archives with no member or none, and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
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
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..sources import manifests
from .common import scratch_path

BLOCK = 64
SAMPLE_RATE = 16_000
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
LABEL = "archives"
SCHEMA = "archive string, offset long, key string, media binary, error string"
LOCAL_HEADER = struct.Struct("<4s5H3L2H")


def to_wav(content: bytes) -> bytes:
    """Content as samples of a WAV file."""
    payload = content + b"\0" * (-len(content) % BLOCK if content else BLOCK)
    fmt = struct.pack("<4sLHHLLHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    size = struct.pack("<4sLQ", b"olen", 8, len(content))
    body = b"WAVE" + fmt + size + struct.pack("<4sL", b"data", len(payload)) + payload
    return struct.pack("<4sL", b"RIFF", len(body)) + body


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, chunks = 12, {}
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sL", media, at)
        chunks[name] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return chunks[b"data"], struct.unpack("<Q", chunks[b"olen"])[0]


def feature(payload: bytes) -> str:
    """Envelope of 16 segments' mean samples, mean distance from the middle, and crossings of the middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    edges = np.arange(16) * len(x) // 16
    means = np.add.reduceat(x, edges) // np.diff(np.r_[edges, len(x)])
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"env={bytes((means + 128).astype(np.uint8)).hex()};dev={int(np.abs(x).sum()) // len(x)};cross={crossings}"


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.limit = int(options.get("archive_bytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out = members = name = None
        count = 0

        def close() -> None:
            members.close()
            done.append((name, out.tell()))
            out.close()

        for batch in iterator:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content")):
                if members is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{root}/{name}")
                    members = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(f"{count:010d}/{key or ''}.wav")
                info.compress_type = zipfile.ZIP_DEFLATED
                members.writestr(info, to_wav(content.as_py() or b""))
                count += 1
                if out.tell() >= self.limit:
                    close()
                    members = None
        if members is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        manifests.publish(self.path, LABEL, sorted([*a] for m in messages if m for a in m.archives), self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                store.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 3))
        self.report = options.get("on_error", "raise") == "report"

    def partitions(self) -> list[Range]:
        store, root = _store(self.path)
        archives = manifests.committed(self.path, LABEL)
        if archives is None:
            archives = [(i.base_name, i.size) for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".zip")]
        return [Range(name, at, min(at + self.range_bytes, size)) for name, size in archives for at in range(0, size, self.range_bytes)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive, so no range was planned
            return
        store, root = _store(self.path)
        place = f"{root}/{partition.archive}"
        handle = None

        def member(info: zipfile.ZipInfo) -> bytes:
            handle.seek(info.header_offset)
            head = LOCAL_HEADER.unpack(handle.read(LOCAL_HEADER.size))
            handle.seek(info.header_offset + LOCAL_HEADER.size + head[-2] + head[-1])
            data = handle.read(info.compress_size)
            if info.compress_type == zipfile.ZIP_DEFLATED:
                data = zlib.decompress(data, -15)
            if head[0] != b"PK\x03\x04" or len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise ValueError(f"member at {info.header_offset} of {place} is damaged")
            return data

        rows: list[tuple] = []
        size = 0
        handle = store.open_input_file(place)
        with zipfile.ZipFile(handle) as index:
            infos = [i for i in index.infolist() if partition.start <= i.header_offset < partition.end]
        handle = store.open_input_file(place)
        for info in infos:
            media = error = None
            for attempt in range(self.attempts):
                try:
                    media, error = member(info), None
                    break
                except (OSError, ValueError, zlib.error, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
                    if attempt + 1 < self.attempts:
                        time.sleep(0.1 * 2**attempt)
                        handle = store.open_input_file(place)
            if error and not self.report:
                raise OSError(error)
            rows.append((partition.archive, info.header_offset, info.filename.split("/", 1)[-1].removesuffix(".wav"), media, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["archive", "offset", "key", "media", "error"])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive")`` with options path, range_bytes, attempts, on_error."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def store_texts(docs: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Write docs(doc_id, text) as members keyed by doc_id."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").cast("binary").alias("content"))
    rows.write.format("media_archive").mode(mode).options(path=path, **options).save()


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(path=path, **options).load()


def describe(media: DataFrame) -> DataFrame:
    """Sizes, hashes and features of members, from the stored bytes; a member's error instead, if it has one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, item, error in zip(batch.column("key").to_pylist(), batch.column("media"), batch.column("error").to_pylist()):
                stored = item.as_py()
                if stored is None:
                    rows.append((int(key) if key else None, *[None] * 7, error or "no media"))
                    continue
                payload, length = from_wav(stored)
                rows.append((int(key) if key else None, length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload), None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [[]] * 9, kinds)], names)

    return media.select("key", "media", "error").mapInArrow(task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def round_trip(docs: DataFrame) -> DataFrame:
    """Store the texts in archives of the shared folder, read them back and describe what was read."""
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    store_texts(docs, path)
    return describe(load(spark, path))
