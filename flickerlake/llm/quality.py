"""Quality classification: logistic regression on hashed word n-grams, scored as sparse dot products.

A text is a sequence of words, numbers and runs of marks. Three streams of it are hashed: lower-cased
tokens in one- and two-grams, and shapes (case, kind, whether the token repeats the one before) in
one- to three-grams, since noise shows in how words are written rather than in which they are. Counts
over the whole text are damped by a logarithm and scaled to unit length. Weights come from
follow-the-regularised-leader updates on the driver over ``max_rows`` labelled rows and ``max_entries``
n-grams at most, chosen by a hash of doc_id, which is its only use; the documents' own rows are read where they lie.

Defined results: a null or empty text is scored by the intercept alone; a very long one is counted in
chunks of CHUNK tokens; a null label isn't learned from and several labels of a document are averaged,
a tie counting as good; rows that repeat a doc_id are learned from each; a null doc_id is never learned
from and is not held out; without both labels in the sample every score is the label that there is, or 0.5; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnable, materialize, within
from .ftrl import Ftrl, settled

DIMS = 1 << 18
MAX_ROWS = 6000
MAX_ENTRIES = 16_000_000
THRESHOLD = 0.3
CHUNK = 1 << 18
CACHE_WORDS = 50_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")


class _Tokens(dict):
    """Token -> its hash and its shape's hash in one integer; emptied when full."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if token[0].isalpha():
            shape = "X" if token.isupper() and len(token) > 1 else "Xx" if token[0].isupper() else "x"
        else:
            shape = "0" if token[0].isdigit() else token[:4]
        value = xxhash.xxh32_intdigest(token.lower()) << 32 | xxhash.xxh32_intdigest(shape, 1)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = value
        return value


_tokens = _Tokens()


def _bucket(x: np.ndarray, stream: int, dims: int) -> np.ndarray:
    x = (x + np.uint64(stream)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(36)).astype(np.int64) % dims


def features(text: str | None, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a whole text, worked in chunks of CHUNK tokens."""
    packed = np.fromiter(map(_tokens.__getitem__, (m.group() for m in TOKEN.finditer(text or ""))), np.uint64)
    at, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for begin in range(0, len(packed), CHUNK):
        # three tokens of overlap: a shape trigram's first shape depends on the token before it
        fresh = min(begin, 3)
        part = packed[begin - fresh : begin + CHUNK]
        word, shape = part >> np.uint64(32), part & np.uint64(0xFFFFFFFF)
        same = np.r_[False, word[1:] == word[:-1]]
        shape = shape + same.astype(np.uint64) * np.uint64(0x5BD1E995)
        mix = lambda a, b: (a * np.uint64(0x94D049BB133111EB)) ^ b
        two, shape2 = mix(word[:-1], word[1:]), mix(shape[:-1], shape[1:])
        shape3 = mix(shape2[:-1], shape[2:])
        grams = [_bucket(g[max(0, fresh - k) :], s, dims) for s, (g, k) in enumerate(((word, 0), (two, 1), (shape, 0), (shape2, 1), (shape3, 2)))]
        new, n = np.unique(np.concatenate(grams), return_counts=True)
        if len(at):
            merged, back = np.unique(np.r_[at, new], return_inverse=True)
            counts = np.bincount(back, np.r_[counts, n], len(merged)).astype(np.int64)
            at = merged
        else:
            at, counts = new, n
    x = 1 + np.log(counts) if len(counts) else np.zeros(0)
    return at, x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, x = features(text, len(self.weights))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[at] + self.bias, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, dims: int = DIMS, max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES, epochs: int = 4, l1: float = 5e-3, l2: float = 1e-3) -> Model:
    """Learn from the learnable rows of labels(doc_id, quality) and the texts they name."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double")).where(learnable(F.col("doc_id")) & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    # at most max_rows pairs of numbers, so it can be broadcast
    chosen = known.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), dims) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["doc_id", "label", "at", "x"])

    rows = texts.select("doc_id", "label", "text").mapInArrow(task, "doc_id long, label int, at array<int>, x array<float>")
    rank = F.xxhash64(F.lit("quality"), "doc_id").alias("rank")
    rows = within(materialize(rows.select("*", rank), "quality-sample"), max_entries).drop("rank").toArrow()
    label = rows.column("label").to_pylist()
    if len(set(label)) < 2:
        return Model(np.zeros(dims, np.float32), 50.0 * (2 * label[0] - 1) if label else 0.0)
    # views of what was received, so that the sample is held once
    vectors = [(a.values.to_numpy(), x.values.to_numpy()) for a, x in zip(rows.column("at"), rows.column("x"))]
    order = settled(rows.column("doc_id").to_pylist(), lambda k: (vectors[k][0].tobytes(), vectors[k][1].tobytes(), label[k]))
    weights, bias = Ftrl(dims, 2, l1=l1, l2=l2).fit([vectors[k] for k in order], [label[k] for k in order], epochs)
    return Model((weights[:, 1] - weights[:, 0]).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs(doc_id, text); nothing but the text decides."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return source.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with a score of ``threshold`` or more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) >= threshold for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
