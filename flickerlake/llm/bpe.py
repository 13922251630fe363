"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pre-tokens are merged on their own. Within one, every adjacent pair that the vocabulary knows waits
in the bucket of its merge rank; a bucket is a heap of linked-list positions, as equal ranks are
merged leftmost first. A two-level bitmap says which buckets hold something, and find-first-set on
both levels gives the lowest rank in constant time. A pair that has changed since it was queued is
stale and skipped. A pre-token of n bytes takes O(n log n) in all, however long it is.

Defined results: a null text is the empty text (no ids); a null doc_id is carried along; repeated
rows are encoded once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import is_stable, tokenizer_path

WORD_BITS = 8
CACHE_WORDS = 500_000
#: The public pattern over characters below STABLE_BELOW, with their classes spelled out.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085 "
STABLE_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


class RankQueue:
    """Positions by rank. ``top`` has a bit for each word of ``words`` that isn't zero."""

    __slots__ = ("buckets", "top", "words")

    def __init__(self) -> None:
        self.top, self.words, self.buckets = 0, {}, {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> WORD_BITS
        self.words[word] = self.words.get(word, 0) | 1 << (rank & (1 << WORD_BITS) - 1)
        self.top |= 1 << word

    def pop(self) -> tuple[int, int]:
        """Lowest rank and, of its positions, the leftmost. Not for an empty queue."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = word << WORD_BITS | low.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.words[word] = bits ^ low
            if bits == low:
                self.top &= self.top - 1
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n, queue, find = len(piece), RankQueue(), ranks.get
    end, before = [*range(1, n + 1), n], [*range(-1, n)]  # of the token that begins at a position
    pair = [find(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank with its successor
    for i, rank in enumerate(pair):
        if rank >= 0:
            queue.push(rank, i)
    while queue.top:
        rank, i = queue.pop()
        if pair[i] != rank:
            continue
        right = end[i]
        pair[right] = -1
        end[i] = after = end[right]
        if after < n:
            before[after] = i
            pair[i] = rank = find(piece[i : end[after]], -1)
            if rank >= 0:
                queue.push(rank, i)
        else:
            pair[i] = -1
        if i:
            left = before[i]
            pair[left] = rank = find(piece[left:after], -1)
            if rank >= 0:
                queue.push(rank, left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(ids)


class _Words(dict):
    """Ids by pre-token in two generations of CACHE_WORDS: what is used again survives the change."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.old = ranks, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = merge(word.encode(), self.ranks)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of a file of ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.words = _Words(ranks)
        self.split_any = regex.compile(public_tokenizers.PATTERN).findall
        self.split_stable = re.compile(STABLE_PATTERN).findall

    def encode(self, text: str) -> list[int]:
        split = self.split_stable if is_stable(text) else self.split_any
        return [*chain.from_iterable(map(self.words.__getitem__, split(text)))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    return tokenizer_path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text)."""
    path = path or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = codec(path).encode
        for batch in batches:
            ids = [to_ids(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _input(docs).mapInArrow(task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, content) of encoded(doc_id, ids); content is bytes, as ids may end within a character."""
    path = path or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = codec(path).decode
        for batch in batches:
            content = [to_bytes(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, content binary")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Both directions in one pass: counts and hashes of the ids and of what they decode to."""
    path = path or default_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path)
        decimal = [str(i) for i in range(len(both.bytes_of))]
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for text in batch.column("text"):
                ids = both.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(both.decode(ids)).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
