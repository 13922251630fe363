"""Line dedup over whole corpora, in DataFrame operations alone.

A line's key is the line stripped of white space at both ends with A-Z lower-cased; keys are held as
two 64-bit hashes. The hashes are range-partitioned with their document, in order of document and
position, so a key that a third of all lines share is spread over several tasks. One stream over that
order numbers each document's occurrences; a pre-aggregated count then gives, for each key, its
documents and its first occurrence. What comes back is a run-length-coded keep bitmap for each
document with losses: lengths of alternating runs of kept and dropped lines, starting with kept.
``keep_lines`` applies the bitmaps to the texts.

Hashed lines are written once and read for the counts and for the losses. A key with a large share of
all lines is joined where its lines lie (``keyed_join``).

A document is a distinct pair of doc_id and text: repeated rows count once and share a bitmap.

Defined results: a null or empty text is one empty line; empty keys are never dropped; a null doc_id
is a value like any other; in ``keep='first'`` ties on doc_id go to the smaller text hash; a very long
text is one row, whose lines are hashed one by one; an empty table gives no rows. Columns named n_lines
or n_dropped, in any case, give way to the counts; others are untouched, and helper columns can't clash
with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, keyed_join, materialize

MIN_DOCS = 10
MIN_KEY_CHARS = 1


def _text(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _document(docs: DataFrame, text: str = "text") -> tuple[Column, Column]:
    return F.col("doc_id").cast("long").alias("d"), F.xxhash64(_text(text)).alias("th")


def line_keys(docs: DataFrame) -> DataFrame:
    """(d, th, pos, h1, h2): every line with a key, hashed."""
    # translate() leaves line breaks alone, so the whole text is lower-cased before it is split
    lines = docs.select(*_document(docs), F.posexplode(F.split(ascii_lower(_text()), "\n")).alias("pos", "line"))
    key = F.trim(F.col("line"), F.lit(SPACE_CHARS))
    keyed = lines.select("d", "th", "pos", key.alias("key")).where(F.length("key") >= MIN_KEY_CHARS)
    return keyed.select("d", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep: str = "none") -> DataFrame:
    """(d, th, keep_runs) for each document that loses lines.

    Keys found in ``min_docs`` documents or more lose all lines (``keep='none'``) or all but the
    first (``keep='first'``; with ``min_docs=1`` also repeats within a document).
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    keys = materialize(line_keys(docs), "line-keys")
    ordered = keys.repartitionByRange("h1", "h2", "d", "th")
    in_document = Window.partitionBy("h1", "h2", "d", "th").orderBy("pos")
    streamed = ordered.withColumn("nth", F.row_number().over(in_document))
    place = F.struct("d", "th", "pos")
    counted = streamed.groupBy("h1", "h2").agg(F.sum((F.col("nth") == 1).cast("long")).alias("docs"), F.min(place).alias("first"), F.count("*").alias("n"))
    enough = F.col("docs") >= min_docs
    frequent = materialize(counted.where(enough if keep == "none" else enough & (F.col("n") > 1)).select("h1", "h2", "first", "n"), "frequent-lines")
    hit = keyed_join(keys, frequent, ["h1", "h2"], keys.count())
    if keep == "first":
        hit = hit.where(place != F.col("first"))
    dropped = hit.groupBy("d", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return dropped.select("d", "th", _runs(F.col("dropped")).alias("keep_runs"))


def _runs(dropped: Column) -> Column:
    """Ascending dropped positions -> kept, dropped, kept, dropped, ... run lengths; the last kept run is implied."""
    def starts(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x - 1))

    def ends(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1) != x + 1))

    def lengths(s: Column, e: Column) -> Column:
        return F.flatten(F.transform(s, lambda x, i: F.array(x - F.when(i == 0, 0).otherwise(F.get(e, i - 1) + 1), F.get(e, i) - x + 1)))

    return F.element_at(F.transform(F.array(F.struct(starts(dropped).alias("s"), ends(dropped).alias("e"))), lambda r: lengths(r["s"], r["e"])), 1)


def _kept(text: Column, runs: Column) -> Column:
    """The kept lines of ``text``, joined: whole kept runs are cut out of the array of lines."""
    lines = F.split(text, "\n")

    def cut(a: Column) -> Column:
        # (next line, slices so far) over pairs of run lengths, then the tail
        even = F.filter(F.transform(runs, lambda x, i: F.struct(x.alias("keep"), F.coalesce(F.get(runs, i + 1), F.lit(0)).alias("drop"), (i % 2 == 0).alias("even"))), lambda r: r["even"])
        placed = F.aggregate(
            even,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,keep:int>>").alias("runs")),
            lambda acc, r: F.struct(
                (acc["at"] + r["keep"] + r["drop"]).alias("at"),
                F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("at"), r["keep"].alias("keep")))).alias("runs"),
            ),
        )
        return F.element_at(
            F.transform(
                F.array(placed),
                lambda p: F.concat(
                    F.flatten(F.transform(p["runs"], lambda r: F.slice(a, r["at"] + 1, r["keep"]))),
                    F.slice(a, p["at"] + 1, F.greatest(F.size(a) - p["at"], F.lit(0))),
                ),
            ),
            1,
        )

    return F.array_join(F.element_at(F.transform(F.array(lines), cut), 1), "\n")


def keep_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep: str = "none", into: str = "text") -> DataFrame:
    """``docs`` with the kept text in column ``into`` and counts in n_lines and n_dropped."""
    bitmaps = keep_bitmaps(docs, min_docs, keep)
    d, th = _document(docs)
    rows = docs.select(d, th, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # a document has one bitmap, so the side that is built has no hot key and is a small part of the texts streamed by it
    bitmaps = bitmaps.select(F.col("d").alias("bd"), F.col("th").alias("bth"), "keep_runs").hint("shuffle_hash")
    joined = rows.join(bitmaps, F.col("d").eqNullSafe(F.col("bd")) & (F.col("th") == F.col("bth")), "left")
    text = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
    kept = F.when(F.col("keep_runs").isNull(), text).otherwise(_kept(text, F.col("keep_runs")))
    dropped = F.aggregate(F.col("keep_runs"), F.struct(F.lit(0).alias("n"), F.lit(False).alias("drop")), lambda a, x: F.struct((a["n"] + F.when(a["drop"], x).otherwise(0)).alias("n"), (~a["drop"]).alias("drop")), lambda a: a["n"])
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    # the row's own columns come back in a step of their own, as their names may be those used here
    done = joined.select("row", kept.alias("kept_text"), n_lines.cast("long").alias("lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("gone"))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in (into.lower(), "n_lines", "n_dropped")]
    return done.select(*others, F.col("kept_text").alias(into), F.col("lines").alias("n_lines"), F.col("gone").alias("n_dropped"))
