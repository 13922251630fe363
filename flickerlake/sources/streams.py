"""Binary event streams as a Spark data source, ``pixel_events``.

A stream is a header and fixed-width big-endian records; single-channel records have 9 bytes, others
11. Reading plans byte ranges that are whole numbers of records from the file's size alone; a range is
decoded by one numpy view into Arrow batches. Writing gives one stream for each task, closed by an
end record, named by the task and committed by the driver's manifest. A stream's end is found in its
last record, as streams that were cut off have none. Conversion to absolute time and frames is left to
the operators.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.events import CAMERAS, EOF_ADDRESS
from . import manifests

# Fixed values of the format.
MAGIC = b"adder"
FIXED_HEADER = struct.Struct(">5sBBHHIIIBB")
BIG_ENDIAN = ord("b")
END_SIZE = 11
TIME_MODES = ("DeltaT", "AbsoluteT", "Mixed")
SINGLE = np.dtype([("x", ">u2"), ("y", ">u2"), ("d", "u1"), ("t", ">u4")])
MULTI = np.dtype([("x", ">u2"), ("y", ">u2"), ("some", "u1"), ("c", "u1"), ("d", "u1"), ("t", ">u4")])

RANGE_RECORDS = 1 << 20
BATCH_RECORDS = 1 << 16
LABEL = "streams"
SCHEMA = "stream string, x int, y int, c int, d int, t long, seq long"


@dataclass
class Header:
    """What a stream says about itself; ``size`` is the header's length in bytes."""

    version: int = 2
    width: int = 1
    height: int = 1
    channels: int = 1
    tps: int = 2550
    ref_interval: int = 255
    delta_t_max: int = 255
    camera: str = "FramedU8"
    time_mode: str = "AbsoluteT"
    adu_interval: int = 1

    @property
    def event_size(self) -> int:
        return SINGLE.itemsize if self.channels == 1 else MULTI.itemsize

    @property
    def size(self) -> int:
        return FIXED_HEADER.size + 4 * min(self.version, 3)

    def pack(self) -> bytes:
        fixed = FIXED_HEADER.pack(MAGIC, self.version, BIG_ENDIAN, self.width, self.height, self.tps, self.ref_interval, self.delta_t_max, self.event_size, self.channels)
        extra = ([c for c, *_ in CAMERAS].index(self.camera), TIME_MODES.index(self.time_mode), self.adu_interval)
        return fixed + b"".join(struct.pack(">I", v) for v in extra[: self.version])

    @classmethod
    def parse(cls, data: bytes) -> Header:
        magic, version, endian, width, height, tps, ref, dtm, _, channels = FIXED_HEADER.unpack(data[: FIXED_HEADER.size])
        if magic != MAGIC or endian != BIG_ENDIAN or version > 3 or not width * height * channels:
            raise ValueError("not a raw event stream")
        extra = struct.unpack_from(f">{version}I", data, FIXED_HEADER.size)
        # before version 2 times were intervals; later versions say what they are
        camera = CAMERAS[extra[0]][0] if version >= 1 else "FramedU8"
        mode = TIME_MODES[extra[1]] if version >= 2 else "DeltaT"
        return cls(version, width, height, channels, tps, ref, dtm, camera, mode, extra[2] if version >= 3 else 1)


def event_count(file_size: int, header: Header, tail: bytes) -> int:
    """Whole records before the end record, if ``tail``, the file's last bytes, is one."""
    ended = tail[-END_SIZE:] == end_record() and file_size - END_SIZE >= header.size
    return max(0, (file_size - header.size - (END_SIZE if ended else 0)) // header.event_size)


def open_stream(store: fs.FileSystem, place: str) -> tuple[Header, int]:
    """A raw stream's header and the number of its events."""
    with store.open_input_file(place) as f:
        header, size = Header.parse(f.read(FIXED_HEADER.size + 12)), f.size()
        f.seek(max(0, size - END_SIZE))
        return header, event_count(size, header, f.read(END_SIZE))


def record_at(position: int, header: Header) -> int:
    """Number of the record that begins at a byte; an error if none does."""
    if position < header.size or (position - header.size) % header.event_size:
        raise ValueError(f"no record begins at {position}")
    return (position - header.size) // header.event_size


def decode(data: bytes, channels: int) -> np.ndarray:
    return np.frombuffer(data, SINGLE if channels == 1 else MULTI)


def encode(x: np.ndarray, y: np.ndarray, c: np.ndarray, d: np.ndarray, t: np.ndarray, channels: int) -> bytes:
    out = np.zeros(len(x), SINGLE if channels == 1 else MULTI)
    out["x"], out["y"], out["d"], out["t"] = x, y, d, t
    if channels > 1:
        out["some"], out["c"] = 1, c
    return out.tobytes()


def end_record() -> bytes:
    """End of a stream; it has a channel whatever the plane."""
    return encode(*(np.array([v]) for v in (EOF_ADDRESS, EOF_ADDRESS, 0, 0, 0)), channels=3)


@dataclass
class Range(InputPartition):
    stream: str
    header: dict
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    stream: str
    first: int = 0


class StreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.records = int(options.get("range_records", RANGE_RECORDS))
        self.start = int(options.get("start_byte", 0))

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            places = [root]
        elif (entries := manifests.committed(self.path, LABEL)) is not None:
            places = sorted(f"{root}/{name}" for name, in entries)
        else:
            places = sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.is_file and not i.base_name.startswith(("_", ".")))
        out = []
        for place in places:
            header, n = open_stream(store, place)
            first = record_at(self.start, header) if self.start else 0
            out += [Range(place, asdict(header), at, min(self.records, n - at)) for at in range(first, n, self.records)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        header = Header(**partition.header)
        with store.open_input_file(partition.stream) as f:
            for at in range(0, partition.count, BATCH_RECORDS):
                n, first = min(BATCH_RECORDS, partition.count - at), partition.first + at
                f.seek(header.size + first * header.event_size)
                e = decode(f.read(n * header.event_size), header.channels)
                c = pa.nulls(n, pa.int32()) if header.channels == 1 else pa.array(e["c"].astype(np.int32))
                ints = {k: pa.array(e[k].astype(np.int32)) for k in ("x", "y", "d")}
                columns = [pa.array([partition.stream] * n), ints["x"], ints["y"], c, ints["d"], pa.array(e["t"].astype(np.int64)), pa.array(np.arange(first, first + n))]
                yield pa.RecordBatch.from_arrays(columns, ["stream", "x", "y", "c", "d", "t", "seq"])


class StreamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        kinds = {"camera": str, "time_mode": str}
        # option names arrive in lower case
        fields = {k: kinds.get(k, int)(options[k]) for k in Header.__dataclass_fields__ if k in options}
        self.header = Header(**fields)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.events"
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(self.header.pack())
            for batch in iterator:
                x, y, d, t = (batch.column(k).to_numpy() for k in ("x", "y", "d", "t"))
                c = batch.column("c").fill_null(0).to_numpy() if "c" in batch.schema.names else np.zeros(len(x))
                out.write(encode(x, y, c, d, t, self.header.channels))
            out.write(end_record())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        manifests.publish(self.path, LABEL, sorted([m.stream] for m in messages if m), self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.stream}")


class PixelEvents(DataSource):
    """Options: path; range_records and start_byte (where a record begins) to read; the fields of Header to write.

    Mode append adds streams to the folder, overwrite replaces them.
    """

    @classmethod
    def name(cls) -> str:
        return "pixel_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options, overwrite)


POLARITY = np.dtype([("t", "<u4"), ("data", "<u4")])
# Kind and size of the records of a polarity file.
POLARITY_KIND = bytes((0, 8))
POLARITY_LABEL = "polarity"


class PolarityReader(DataSourceReader):
    """Polarity files: text lines that begin with %, two bytes of kind and size, then records of 8 bytes."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.records = int(options.get("range_records", RANGE_RECORDS))

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        entries = manifests.committed(self.path, POLARITY_LABEL)
        places = [root] if entries is None else [f"{root}/{name}" for name, _ in sorted(entries, key=lambda e: e[1])]
        out = []
        for place in places:
            with store.open_input_file(place) as f:
                start, head = 0, f.read(1 << 16)
                while head[start : start + 1] == b"%":
                    start = head.index(b"\n", start) + 1
                start += len(POLARITY_KIND)
                n = (f.size() - start) // POLARITY.itemsize
            out += [Range(place, {"start": start}, at, min(self.records, n - at)) for at in range(0, n, self.records)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.stream) as f:
            f.seek(partition.header["start"] + partition.first * POLARITY.itemsize)
            e = np.frombuffer(f.read(partition.count * POLARITY.itemsize), POLARITY)
        data = e["data"].astype(np.int64)
        parts = (e["t"].astype(np.int64), data & 0x3FF, (data & 0xFFFC000) >> 14, data >> 28 & 1)
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["t", "x", "y", "p"])


class PolarityWriter(DataSourceArrowWriter):
    """One file a task, with width and height in its text; the manifest has files in order of their first time."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.size = int(options.get("width", 1)), int(options.get("height", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        name, first = f"{uuid.uuid4().hex}.dat", None
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(b"%% Height %d\n%% Version 2\n%% Width %d\n" % self.size[::-1] + POLARITY_KIND)
            for batch in iterator:
                t, x, y, p = (batch.column(k).to_numpy().astype(np.uint32) for k in ("t", "x", "y", "p"))
                if len(t):
                    first = int(t[0]) if first is None else first
                records = np.zeros(len(t), POLARITY)
                records["t"], records["data"] = t, p << 28 | y << 14 | x
                out.write(records.tobytes())
        return Written(name, -1 if first is None else first)

    def commit(self, messages: list[Written | None]) -> None:
        manifests.publish(self.path, POLARITY_LABEL, sorted(([m.stream, m.first] for m in messages if m), key=lambda e: e[1]), self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.stream}")


class PolarityEvents(DataSource):
    """``polarity_events`` of (t, x, y, p); to write, options path, width and height. ``save_polarity`` writes in order of time."""

    @classmethod
    def name(cls) -> str:
        return "polarity_events"

    def schema(self) -> str:
        return "t long, x long, y long, p long"

    def reader(self, schema) -> PolarityReader:
        return PolarityReader(self.options)

    def writer(self, schema, overwrite: bool) -> PolarityWriter:
        return PolarityWriter(self.options, overwrite)


def save_polarity(events, path: str, width: int, height: int, mode: str = "append") -> None:
    """Write events(t, x, y, p) so that files, and records within them, follow each other in time."""
    events.sparkSession.dataSource.register(PolarityEvents)
    ordered = events.select("t", "x", "y", "p").repartitionByRange("t").sortWithinPartitions("t", "y", "x", "p")
    ordered.write.format("polarity_events").mode(mode).options(path=path, width=str(width), height=str(height)).save()


def register(spark) -> None:
    for source in (PixelEvents, PolarityEvents):
        spark.dataSource.register(source)
