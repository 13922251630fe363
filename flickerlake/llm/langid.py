"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and all runs without letters become one blank; n-grams of one to three
characters are hashed into ``dims`` buckets over the whole text. Document frequencies are counted over
all learnable documents, by one vector for each task and a tree of sums. The regression is trained on
the driver with follow-the-regularised-leader under elastic-net penalties, on about ``per_language``
documents of each language and ``max_rows`` in all, but at least ``least_rows`` of each language, and
``max_entries`` n-grams (a bounded sample chosen by a hash of doc_id, its only use), and calibrated by a temperature on a fifth of
them that isn't trained on. Every language that the table holds is learned; the driver takes 0.25 MB for
each in training, a task 0.13 MB.

Defined results: ``und`` with score 0 for a null or empty text, one without a letter, or where nothing
could be learned; a null doc_id is never learned from and is not held out; repeated rows get equal
predictions; equal probabilities go to the first language in order; a very long text is counted in
chunks of CHUNK characters; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learnable, materialize, within
from .ftrl import Ftrl, settled, softmax, temperature

DIMS = 1 << 15
ORDERS = 3
PER_LANGUAGE = 800
MAX_ROWS = 8000
LEAST_ROWS = 10
MAX_ENTRIES = 16_000_000
UNDETERMINED = "und"
CHUNK = 1 << 20
FAN_IN = 64
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool)
    return _letters


def ngram_counts(text: str, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a whole text, None if it has no letter. Memory is bounded by CHUNK and dims."""
    total, seen = np.zeros(dims, np.int64), False
    tail = np.array([32], np.uint64)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[codes]
        seen = seen or bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint64)
        if at + CHUNK >= len(text):
            codes = np.r_[codes, np.uint64(32)]
        codes = codes[(codes != 32) | (np.r_[tail[-1:], codes[:-1]] != 32)]
        new, codes = len(codes), np.r_[tail, codes]
        mixed = codes * np.uint64(0x9E3779B97F4A7C15)
        grams = mixed[len(tail) :]
        for order in range(1, ORDERS + 1):
            if order > 1:
                if len(codes) < order:
                    break
                # grams that end in the new part; the tail has the characters before it
                ends = np.arange(max(order - 1, len(tail)), len(codes))
                grams = mixed[ends]
                for back in range(1, order):
                    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[ends - back]
            buckets = ((grams ^ (grams >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % dims
            total += np.bincount(buckets, minlength=dims)
        tail = codes[-(ORDERS - 1) :] if new else tail
    if not seen:
        return None
    at = np.flatnonzero(total)
    return at, total[at]


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = ngram_counts(text, len(self.idf)) if text and self.languages else None
        if found is None:
            return UNDETERMINED, 0.0
        p = softmax((tf_idf(*found, self.idf) @ self.weights[found[0]] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def document_frequencies(docs: DataFrame, dims: int = DIMS) -> tuple[int, np.ndarray]:
    """Number of texts with a letter and, by bucket, those that hold it; over all rows of ``docs``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, df = 0, np.zeros(dims, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                found = ngram_counts(text.as_py() or "", dims)
                if found:
                    n += 1
                    df[found[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([df], pa.list_(pa.int64()))], ["task", "n", "df"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        n, df = 0, np.zeros(dims, np.int64)
        for batch in rows.to_batches():
            n += sum(batch.column("n").to_pylist())
            for one in batch.column("df"):
                df += one.values.to_numpy()
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "df": pa.array([df], pa.list_(pa.int64()))})

    schema = "task long, n long, df array<long>"
    sums = materialize(docs.select("text").mapInArrow(task, schema), "df")
    while (tasks := sums.agg(F.max("task")).first()[0]) is not None and tasks > 0:
        sums = materialize(sums.groupBy((F.col("task") / FAN_IN).cast("long").alias("group")).applyInArrow(add, schema), "df")
    row = sums.first()
    return (row["n"], np.array(row["df"])) if row else (0, np.zeros(dims, np.int64))


def fit(
    docs: DataFrame,
    dims: int = DIMS,
    per_language: int = PER_LANGUAGE,
    max_rows: int = MAX_ROWS,
    least_rows: int = LEAST_ROWS,
    max_entries: int = MAX_ENTRIES,
    epochs: int = 3,
    l1: float = 2e-2,
    l2: float = 1e-3,
) -> Model:
    """Learn from the learnable rows of docs(doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(dims), np.zeros((dims, 0)), np.zeros(0), 1.0)
    n, df = document_frequencies(rows, dims)
    idf = np.log((1 + n) / (1 + df)) + 1

    chance = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    each = max(least_rows, min(per_language, max_rows / len(counts)))
    # one row a language, as many as the model has classes
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, each / c)) for k, c in counts.items()], "of string, rate double")
    chosen = rows.join(F.broadcast(rates), F.col("lang") == F.col("of")).where(chance < F.col("rate")).select("doc_id", "text", "lang")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t.as_py(), dims) for t in batch.column("text")]
            none = np.zeros(0, np.int64), np.zeros(0, np.int64)
            at, count = zip(*(f or none for f in found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], ["doc_id", "lang", "at", "counts"])

    sample = chosen.mapInArrow(task, "doc_id long, lang string, at array<int>, counts array<int>").where(F.size("at") > 0)
    rank = F.xxhash64(F.lit("langid-rank"), "doc_id").alias("rank")
    sample = within(materialize(sample.select("*", rank), "langid-sample"), max_entries)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5))).toArrow()
    place = {name: k for k, name in enumerate(languages)}
    labels, folds, vectors = [place[x] for x in sample.column("lang").to_pylist()], sample.column("fold").to_pylist(), []
    for at, count in zip(sample.column("at"), sample.column("counts")):
        at = at.values.to_numpy()
        vectors.append((at, tf_idf(at, count.values.to_numpy(), idf).astype(np.float32)))
    order = settled(sample.column("doc_id").to_pylist(), lambda k: (labels[k], vectors[k][0].tobytes(), vectors[k][1].tobytes()))
    labels, folds, vectors = ([x[k] for k in order] for x in (labels, folds, vectors))
    train = [k for k, f in enumerate(folds) if f or len(folds) < 20]
    model = Ftrl(dims, len(languages), l1=l1, l2=l2)
    weights, bias = model.fit([vectors[k] for k in train], [labels[k] for k in train], epochs)
    rest = [k for k, f in enumerate(folds) if not f]
    logits = np.array([vectors[k][1] @ weights[vectors[k][0]] + bias for k in rest]).reshape(len(rest), len(languages))
    return Model(languages, idf, weights.astype(np.float32), bias, temperature(logits, np.array([labels[k] for k in rest], np.int64)))


def _predictor(model: Model, names: list[str]) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [model.predict(t.as_py()) for t in batch.column("text")]
            arrays = [batch.column(c) for c in names] + [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "lang_pred", "score"])

    return task


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs(doc_id, text); nothing but the text decides."""
    source = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return source.mapInArrow(_predictor(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is determined with a score of ``least`` or more; all if no language was learned."""
    if not model.languages:
        return docs

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [model.predict(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([p[0] != UNDETERMINED and p[1] >= least for p in pairs], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
