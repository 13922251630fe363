"""Compressed units of a stream: residuals of pixel blocks under adaptive arithmetic coding.

A unit holds the events of one time window, as blocks of 16 x 16 pixels of a channel. First events are
coded against the first event of the pixel before, later ones against a prediction from the pixel's
last interval. A unit is coded in parts of at most ``PART_EVENTS`` events, in order of blocks and pixels, so
neither a full window nor a pixel with many events is held at once. Parts are coded apart from each other, as
small units are: each has contexts of its own, names its first and last place, and takes a pixel's first event
there for a first one, wherever it was cut. Blocks between two parts have no events and no marks.
Coding is lossless for the events that ``codec.placed`` keeps and that lie within the header's plane. The stream
that units make up has a header, then each part behind its unit's number and its length. Records without the bit
``PART`` in their number hold a whole unit, as streams did before there were parts.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.events import D_EMPTY, long, whole
from ..sources import manifests
from ..sources.streams import FIXED_HEADER, MAGIC, Header, PixelEvents
from ..sources.streams import LABEL as RAW_LABEL
from .codec import BLOCK, D_SHIFT_MAX, NO_EVENT, SHIFT_WHOLE, SKIP, T_RESIDUAL_MAX, numbered, unit
from .entropy import Context, Decoder, Encoder

# Fixed value: residuals of d are coded 255 higher.
OFFSET = 255
# Counts that symbols start with, as (first, last, count): small residuals, wrapped ones, and the two marks.
D_LIKELY = [(0, 20, 10), (235, 275, 10), (245, 265, 20), (490, 510, 10), (511, 511, 20), (512, 512, 10)]
T_LIKELY = [(0, 9, 10)]
COMPRESSED_MAGIC = b"addec"
LABEL = "units"
UNIT_HEAD = struct.Struct(">QI")
# The bit of a unit's number that says that the record is a part, whose first and last place follow.
PART, PART_HEAD = 1 << 63, struct.Struct(">QQ")
PART_EVENTS = 1 << 14
# Bytes of a file that one task reads, or one record more.
STRETCH_BYTES = 1 << 18
SCHEMA = "adu long, x long, y long, c long, d long, t long"
Event = tuple[int, int]


class Model:
    """Contexts that encoder and decoder share."""

    def __init__(self) -> None:
        self.d, self.t, self.shift = Context(OFFSET + SKIP + 1, D_LIKELY), Context(256, T_LIKELY), Context(SHIFT_WHOLE + 1)


def predict(k: int, change: int, before: Event, last_dt: int, start: int, length: int) -> int:
    """Time of a pixel's k-th event of the unit, counted from 0."""
    if k == 1:
        return start
    scale = -1 if before[0] == D_EMPTY else 0 if abs(change) > D_SHIFT_MAX else change
    moved = last_dt << scale if scale >= 0 else last_dt >> -scale
    return before[1] + min(moved, length)


class _Writer:
    def __init__(self) -> None:
        self.model, self.coder = Model(), Encoder()

    def d(self, symbol: int) -> None:
        self.coder.put(self.model.d, symbol + OFFSET)

    def t(self, residual: int) -> None:
        whole = abs(residual) >= T_RESIDUAL_MAX
        self.coder.put(self.model.shift, SHIFT_WHOLE if whole else 0)
        for byte in residual.to_bytes(8 if whole else 2, "big", signed=True):
            self.coder.put(self.model.t, byte)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.model, self.coder = Model(), Decoder(data)

    def d(self) -> int:
        return self.coder.take(self.model.d) - OFFSET

    def t(self) -> int:
        size = 8 if self.coder.take(self.model.shift) == SHIFT_WHOLE else 2
        return int.from_bytes(bytes(self.coder.take(self.model.t) for _ in range(size)), "big", signed=True)


def _sizes(header: Header) -> tuple[int, int]:
    """Blocks in a row of the plane, and places in a block; blocks at the plane's edges have places without a pixel."""
    return -(-header.width // BLOCK), header.channels * BLOCK * BLOCK


def _place(header: Header) -> Column:
    """A pixel's place in coding order, from x, y and c."""
    across, size = _sizes(header)
    block = whole(F.col("y"), BLOCK) * across + whole(F.col("x"), BLOCK)
    return block * size + F.col("c") * (BLOCK * BLOCK) + F.col("y") % BLOCK * BLOCK + F.col("x") % BLOCK


def _spot(place: int, header: Header) -> tuple[int, int, int]:
    """The pixel (c, y, x) of a place."""
    across, size = _sizes(header)
    block, rest = divmod(place, size)
    (by, bx), (c, rest) = divmod(block, across), divmod(rest, BLOCK * BLOCK)
    return c, by * BLOCK + rest // BLOCK, bx * BLOCK + rest % BLOCK


def _spots(header: Header, first: int = 0, last: int | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of the plane from a first place to a last one, each as its pixels (c, y, x) in order."""
    across, size = _sizes(header)
    if last is None:
        last = across * -(-header.height // BLOCK) * size - 1
    begin, end = _spot(first, header), _spot(last, header)
    for block in range(first // size, last // size + 1):
        by, bx = (k * BLOCK for k in divmod(block, across))
        spots = [(c, y, x) for c in range(header.channels) for y in range(by, min(by + BLOCK, header.height)) for x in range(bx, min(bx + BLOCK, header.width))]
        if block == first // size:
            spots = [s for s in spots if s >= begin]
        if block == last // size:
            spots = [s for s in spots if s <= end]
        yield spots


def encode_unit(events: dict[tuple[int, int, int], list[Event]], start: int, length: int, header: Header, first: int = 0, last: int | None = None) -> bytes:
    """Bytes of a unit that begins at ``start``, or of its part between two places; ``events`` by (c, y, x) in order of time."""
    out = _Writer()
    for spots in _spots(header, first, last):
        if not any(s in events for s in spots):
            out.d(SKIP)
            continue
        before: Event | None = None
        for s in spots:
            if s not in events:
                out.d(NO_EVENT)
                continue
            d, t = events[s][0]
            out.d(d - (before[0] if before else 0))
            out.t(t - (before[1] if before else start))
            before = d, t
    for spots in _spots(header, first, last):
        for s in spots:
            es = events.get(s, [])
            for k in range(1, len(es)):
                change, last_dt = es[k][0] - es[k - 1][0], es[k - 1][1] - es[k - 2][1] if k > 1 else 0
                out.d(change)
                out.t(es[k][1] - predict(k, change, es[k - 1], last_dt, start, length))
            if es:
                out.d(NO_EVENT)
    return out.coder.done()


def decode_unit(data: bytes, start: int, length: int, header: Header, first: int = 0, last: int | None = None) -> dict[tuple[int, int, int], list[Event]]:
    """The inverse of ``encode_unit``."""
    source = _Reader(data)
    events: dict[tuple[int, int, int], list[Event]] = {}
    for spots in _spots(header, first, last):
        before: Event | None = None
        for s in spots:
            symbol = source.d()
            if symbol == SKIP:
                break
            if symbol == NO_EVENT:
                continue
            before = symbol + (before[0] if before else 0), source.t() + (before[1] if before else start)
            events[s] = [before]
    for spots in _spots(header, first, last):
        for s in spots:
            es = events.get(s)
            while es:
                change = source.d()
                if change == NO_EVENT:
                    break
                last_dt = es[-1][1] - es[-2][1] if len(es) > 1 else 0
                t = predict(len(es), change, es[-1], last_dt, start, length) + source.t()
                es.append((es[-1][0] + change, t))
    return events


def compress(events: DataFrame, header: Header) -> DataFrame:
    """(adu, first, last, n, payload) of events(x, y, c, d, t, seq): parts of units, with their first and last place.

    Tasks get ranges of units and places, and their parts are in order. What is dealt out is a pixel in
    a unit, so neither a unit nor a block is one task's work, and one shuffle serves numbering and coding.
    """
    length, most = header.ref_interval * header.adu_interval, PART_EVENTS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for adu, own in groupby(rows, itemgetter(0)):
            while part := [*islice(own, most)]:
                first, last = part[0][1], part[-1][1]
                by: dict[tuple[int, int, int], list[Event]] = {}
                for place, pixel in groupby(part, itemgetter(1)):
                    by[_spot(place, header)] = [(d, t) for *_, d, t in pixel]
                payload = encode_unit(by, adu * length, length, header, first, last)
                values = zip((adu, first, last, len(part)), [pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([*(pa.array([v], kind) for v, kind in values), pa.array([payload], pa.binary())], ["adu", "first", "last", "n", "payload"])

    source = events.select(*(long(F.col(k)).alias(k) for k in ("x", "y", "d", "t", "seq")), long(F.coalesce("c", F.lit(0))).alias("c"))
    inside = [F.col(k).between(0, side - 1) for k, side in (("x", header.width), ("y", header.height), ("c", header.channels))]
    source = source.where(inside[0] & inside[1] & inside[2]).select(unit(F.col("t"), length).alias("adu"), _place(header).alias("place"), "d", "t", "seq")
    # the number keeps adaptive execution from joining ranges, whose bytes say little of the work in them
    ranges = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = numbered(source.repartitionByRange(ranges, "adu", "place"), ("adu", "place"))
    return kept.sortWithinPartitions("adu", "place", "t", "seq").select("adu", "place", "d", "t").mapInArrow(task, "adu long, first long, last long, n long, payload binary")


def decompress(units: DataFrame, header: Header) -> DataFrame:
    """Events of units(adu, first, last, payload); order within a pixel is that of their times."""
    length = header.ref_interval * header.adu_interval

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for adu, first, last, payload in zip(*(column.to_pylist() for column in batch.columns)):
                yield _rows(adu, decode_unit(payload, adu * length, length, header, first, last))

    return units.select("adu", "first", "last", "payload").mapInArrow(task, SCHEMA)


def _rows(adu: int, events: dict[tuple[int, int, int], list[Event]]) -> pa.RecordBatch:
    rows = [(adu, x, y, c, d, t) for (c, y, x), es in events.items() for d, t in es]
    return pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in [*zip(*rows)] or [[]] * 6], [f.split()[0] for f in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    places: list[tuple[int, int]]


@dataclass
class Stretch(InputPartition):
    """Records of a file, from a byte on to another."""

    path: str
    header: dict
    begin: int
    end: int


class UnitWriter(DataSourceArrowWriter):
    """Writes sorted (adu, first, last, payload) rows; the parts of a task make one stream."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.header = options["path"], overwrite, Header(**json.loads(options["header"]))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        name, places = f"{uuid.uuid4().hex}.units", []
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(COMPRESSED_MAGIC + self.header.pack()[len(COMPRESSED_MAGIC) :])
            for batch in iterator:
                for adu, first, last, payload in zip(*(batch.column(k).to_pylist() for k in ("adu", "first", "last", "payload"))):
                    if not places or out.tell() - places[-1][1] >= STRETCH_BYTES:
                        places.append((adu, out.tell()))
                    out.write(UNIT_HEAD.pack(PART | adu, PART_HEAD.size + len(payload)) + PART_HEAD.pack(first, last) + payload)
        return Written(name, places[0][0] if places else -1, places)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest holds (unit, byte) where each stretch begins, in order of time."""
        files = sorted((m.first, m.name, m.places) for m in messages if m and m.places)
        manifests.publish(self.path, LABEL, [[name, places] for _, name, places in files], self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.name}")


def _walk(f: pa.NativeFile, at: int, end: int) -> Iterator[tuple[int, int]]:
    """(number, byte) of a stream's records up to a byte, found by their lengths; a record that was cut off ends it."""
    while at + UNIT_HEAD.size <= end:
        f.seek(at)
        number, length = UNIT_HEAD.unpack(f.read(UNIT_HEAD.size))
        if at + UNIT_HEAD.size + length > end:
            return
        yield number, at
        at += UNIT_HEAD.size + length


class UnitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Stretch]:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            entries = [(root, None)]
        else:
            entries = [(f"{root}/{name}", places) for name, places in manifests.committed(self.path, LABEL) or ()]
        out = []
        for name, places in entries:
            with store.open_input_file(name) as f:
                head, size = f.read(FIXED_HEADER.size + 12), f.size()
                if head[:5] != COMPRESSED_MAGIC:
                    raise ValueError(f"{name} is not a compressed stream")
                header = Header.parse(MAGIC + head[5:])
                begins = [at for _, at in places] if places is not None else []
                for _, at in _walk(f, header.size, size) if places is None else ():
                    if not begins or at - begins[-1] >= STRETCH_BYTES:
                        begins.append(at)
            out += [Stretch(name, asdict(header), *ends) for ends in zip(begins, [*begins[1:], size])]
        return out

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        header = Header(**partition.header)
        length = header.ref_interval * header.adu_interval
        with store.open_input_file(partition.path) as f:
            for number, at in _walk(f, partition.begin, partition.end):
                f.seek(at)
                payload = f.read(UNIT_HEAD.unpack(f.read(UNIT_HEAD.size))[1])
                adu, places = number & ~PART, ()
                if number & PART:
                    places, payload = PART_HEAD.unpack_from(payload), payload[PART_HEAD.size :]
                yield _rows(adu, decode_unit(payload, adu * length, length, header, *places))


class CompressedEvents(DataSource):
    """``compressed_events``: units by the manifest of a folder; to write, options path and header (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "compressed_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UnitReader:
        return UnitReader(self.options)

    def writer(self, schema, overwrite: bool) -> UnitWriter:
        return UnitWriter(self.options, overwrite)


def save(events: DataFrame, header: Header, path: str, mode: str = "append") -> None:
    """Compress events and write them; each task's stream is in order of units."""
    events.sparkSession.dataSource.register(CompressedEvents)
    compress(events, header).drop("n").write.format("compressed_events").mode(mode).options(path=path, header=json.dumps(asdict(header))).save()


def load(spark, path: str) -> DataFrame:
    spark.dataSource.register(CompressedEvents)
    return spark.read.format("compressed_events").load(path)


def open_events(spark, path: str) -> DataFrame:
    """(x, y, c, d, t) of a stream or a folder of streams, raw or compressed, told apart by the first bytes.

    One header is read on the driver.
    """
    spark.dataSource.register(PixelEvents)
    spark.dataSource.register(CompressedEvents)
    store, root = fs.FileSystem.from_uri(path)
    first = root
    if store.get_file_info(root).type == fs.FileType.Directory:
        names = [e[0] for label in (LABEL, RAW_LABEL) for e in manifests.committed(path, label) or ()]
        names = names or [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.is_file and not i.base_name.startswith(("_", "."))]
        if not names:
            raise ValueError(f"no stream in {path}")
        first = f"{root}/{min(names)}"
    with store.open_input_file(first) as f:
        magic = f.read(len(MAGIC))
    kinds = {MAGIC: "pixel_events", COMPRESSED_MAGIC: "compressed_events"}
    if magic not in kinds:
        raise ValueError(f"{first} is no event stream")
    events = spark.read.format(kinds[magic]).load(path)
    return events.select(*(long(F.col(k)).alias(k) for k in ("x", "y", "c", "d", "t")))
