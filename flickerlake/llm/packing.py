"""Sequence packing: bounded-space online best fit with a final merge of leftovers.

Each task keeps at most ``open_windows`` windows of ``window`` tokens. A document is cut into whole
windows and a rest; the rest goes to the open window it fills best. When it fits none and no further
window may be opened, the fullest one is topped up with the head of the rest and emitted, so emitted
windows are full. At the end of a task the open windows are poured together, which leaves less than
one window. Those leftovers, under ``window`` tokens a task, are merged in rounds of ``fan_in``
tasks; the last one is cut into powers of two, which need no padding.

Defined results: a null or empty text yields the end token alone; a null doc_id is carried along;
repeated rows are packed once each; of windows that fit a piece equally well the one opened first is
taken; an empty table gives no rows; other columns are ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 2048
OPEN_WINDOWS = 64
FAN_IN = 64
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, leftover boolean"
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32())), ("leftover", pa.bool_())])
#: Below this code point every character's class has been fixed for decades, so all libraries split alike.
STABLE_BELOW = "ɐ"

#: White space so long that the quick library's backtracking may run out of stack.
WIDE_GAP = 10_000

_gaps = re.compile(r"\s{64,}")
_encoders: dict[str, Callable[[str], list[int]]] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_stable(text: str) -> bool:
    """Whether all characters lie below STABLE_BELOW; most texts are settled by their narrow encodings."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < STABLE_BELOW
    return True


def has_wide_gap(text: str) -> bool:
    """Whether WIDE_GAP characters of white space or more follow each other."""
    return len(text) >= WIDE_GAP and any(m.end() - m.start() >= WIDE_GAP for m in _gaps.finditer(text))


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text -> ids of the tokenizer file at ``path``, once for each worker.

    Where a rank file of the same vocabulary lies beside it, texts of stable characters take that
    quicker library; the ids are equal (``tests/llm/test_packing.py``). Others, and texts with a
    WIDE_GAP, take the file itself.
    """
    if path in _encoders:
        return _encoders[path]
    files: list = []

    def by_file(text: str) -> list[int]:
        if not files:  # read when the first text asks for it
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            files.append(Tokenizer.from_file(path))
            files[0].encode_special_tokens = True
        return files[0].encode(text, add_special_tokens=False).ids

    encode = by_file
    twin = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(twin):
        import base64

        import public_tokenizers
        import tiktoken

        with open(twin, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        quick = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if not is_stable(text) or has_wide_gap(text):
                return by_file(text)
            return quick.encode_ordinary(text)

    _encoders[path] = encode
    return encode


class Packer:
    """Open windows of one task. ``rows`` collects finished pieces until they are drained."""

    def __init__(self, window: int, limit: int, first_id: int, keep_ids: bool):
        self.window, self.limit, self.keep_ids = window, limit, keep_ids
        self.next_id = first_id
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], leftover: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, ids if self.keep_ids or leftover else None, leftover))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self._emit([(doc_id, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect_left(self.free, (len(ids), -1))
            if at < len(self.free):
                space, key = self.free.pop(at)
                self._put(key, space, (doc_id, start, ids, total))
                return
            if len(self.open) < self.limit:
                key = max(self.open, default=-1) + 1
                self.open[key] = []
                self._put(key, self.window, (doc_id, start, ids, total))
                return
            space, key = self.free.pop(0)
            self._put(key, space, (doc_id, start, ids[:space], total))
            start, ids = start + space, ids[space:]

    def _put(self, key: int, space: int, piece: tuple) -> None:
        self.open[key].append(piece)
        if space == len(piece[2]):
            self._emit(self.open.pop(key))
        else:
            insort(self.free, (space - len(piece[2]), key))

    def close(self, final: bool) -> None:
        """Pour the open windows together, fullest first; what is left is under one window."""
        poured = [p for _, key in self.free for p in self.open[key]]
        self.free, self.open = [], {}
        rest = sum(len(p[2]) for p in poured)
        while rest:
            size = self.window if rest >= self.window else 1 << rest.bit_length() - 1 if final else rest
            taken, poured = self._take(poured, size)
            self._emit(taken, leftover=not final and size < self.window)
            rest -= size

    @staticmethod
    def _take(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
        taken = []
        for k, (doc_id, start, ids, total) in enumerate(pieces):
            if len(ids) >= size:
                taken.append((doc_id, start, ids[:size], total))
                rest = [(doc_id, start + size, ids[size:], total)] if len(ids) > size else []
                return taken, rest + pieces[k + 1 :]
            taken.append((doc_id, start, ids, total))
            size -= len(ids)
        return taken, []

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in ARROW]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def _pack_documents(path: str, window: int, limit: int, keep_ids: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(window, limit, TaskContext.get().partitionId() << 32, keep_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                packer.add(doc_id, 0, ids, len(ids))
                if len(packer.rows) >= 4096:
                    yield packer.drain()
        packer.close(final=False)
        yield packer.drain()

    return task


def _pack_leftovers(window: int, limit: int, keep_ids: bool, level: int, final: bool) -> Callable:
    def group(key: tuple, pieces: pa.Table) -> pa.Table:
        packer = Packer(window, limit, level << 56 | key[0].as_py() << 32, keep_ids)
        pieces = pieces.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        names = ("doc_id", "start", "ids", "doc_tokens")
        for doc_id, start, ids, total in zip(*(pieces.column(n).to_pylist() for n in names)):
            packer.add(doc_id, start, np.array(ids, dtype="<u4"), total)
        packer.close(final)
        return pa.Table.from_batches([packer.drain()])

    return group


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    fan_in: int = FAN_IN,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: which ids of which document lie where in which sequence.

    ``ids`` is null unless ``with_ids``; ``ids_crc32`` is over little-endian unsigned 32-bit ids.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = materialize(source.mapInArrow(_pack_documents(path, window, open_windows, with_ids), SCHEMA), "pack")
    parts, level = [made.where(~F.col("leftover"))], 0
    while True:
        left = made.where("leftover").withColumn("task", F.shiftright("sequence_id", 32).bitwiseAND(F.lit((1 << 24) - 1)))
        groups = left.agg(F.max("task")).first()[0]
        if groups is None:
            break
        level, final = level + 1, groups < fan_in
        merge = _pack_leftovers(window, open_windows, with_ids, level, final)
        grouped = left.withColumn("group", (F.col("task") / fan_in).cast("long")).groupBy("group")
        made = materialize(grouped.applyInArrow(merge, SCHEMA), "pack-rest")
        parts.append(made.where(~F.col("leftover")))
        if final:
            break
    packed = parts[0]
    for part in parts[1:]:
        packed = packed.unionByName(part)
    return packed.drop("leftover")
