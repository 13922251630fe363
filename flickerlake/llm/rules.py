"""Quality rules, in DataFrame operations alone: counts within a document and line frequency across documents.

Within a document, arrays stay arrays: nothing is exploded and nothing is shuffled. Across documents,
a line (white space stripped, A-Z lower-cased) is hashed, written once, and its distinct documents are
counted for each host, aggregated before every shuffle: first to one row for each host, line and
document, which spreads a line that all documents share, then to one for each host and line. Lines in
``max_docs`` or more documents of a host are removed: a mask of run lengths for each document that loses
lines, as in ``linedup``, is applied to its text. A document that keeps less than ``min_left`` of the
characters of its lines is depleted and rejected. A document is a distinct pair of doc_id and text, as
in ``linedup``: copies under other ids are documents of their own, so a host's page that is there
``max_docs`` times is boilerplate.

Defined results: a null or empty text has no words and fails the base rule; a null host is a host
like any other; a null doc_id is a value like any other; repeated rows get equal rows and count once; a
very long text is one row, whose arrays of words and lines are held while it is worked; an empty table
gives no rows; other columns are ignored, and helper columns can't clash with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, ascii_lower, keyed_join, materialize
from .linedup import _kept, _runs

MAX_DOCS = 20
MIN_LEFT = 0.3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated(grams: Column) -> Column:
    """Ascending positions of the values of an array that occur in it twice or more."""

    def twins(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    return _let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), twins)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words of an array that lie in windows found twice or more."""

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-window).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(positions, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(window), p - a["at"])).alias("n")), lambda a: a["n"])

    def counted(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(covered(_repeated(grams)))

    return F.when(F.size(words) > window, _let(words, lambda w: _let(hashed(w), counted))).otherwise(F.lit(0).cast("long"))


def base_counts(rows: DataFrame) -> DataFrame:
    """Every row of rows(doc_id, text, clean), with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of its text."""
    trimmed = F.trim("text", F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    return rows.select("doc_id", "text", "clean", words.alias("words")).select(
        "doc_id",
        "text",
        "clean",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def _row(docs: DataFrame, host: str) -> tuple[Column, Column, Column]:
    """A row's doc_id, the hash of its host and text, and its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of = F.col(host).cast("string")
    return F.col("doc_id").cast("long").alias("d"), F.xxhash64(of.isNull(), of, text).alias("th"), text.alias("text")


def host_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(d, th, pos, h1, h2): every line that isn't blank, hashed with its host."""
    d, th, text = _row(docs, host)
    of = F.col(host).cast("string").alias("host")
    lines = docs.select(d, th, of, F.posexplode(F.split(ascii_lower(text), "\n")).alias("pos", "line"))
    keyed = lines.select("d", "th", "host", "pos", F.trim(F.col("line"), F.lit(SPACE_CHARS)).alias("key")).where("key != ''")
    of = F.col("host").isNull(), F.col("host"), F.col("key")
    return keyed.select("d", "th", "pos", F.xxhash64(*of).alias("h1"), F.xxhash64(F.lit(1), *of).alias("h2"))


def line_masks(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """(d, th, keep_runs) of documents that lose lines."""
    lines = materialize(host_lines(docs, host), "host-lines")
    once = lines.groupBy("h1", "h2", "d", "th").agg(F.count("*").alias("k"))
    counted = once.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("k").alias("n"))
    frequent = materialize(counted.where(F.col("docs") >= max_docs).select("h1", "h2", "n"), "frequent-host-lines")
    hit = keyed_join(lines, frequent, ["h1", "h2"], lines.count())
    dropped = hit.groupBy("d", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return dropped.select("d", "th", _runs(F.col("dropped")).alias("keep_runs"))


def remove_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, text, clean) for each row, clean being the text without its host's frequent lines."""
    masks = line_masks(docs, host, max_docs).select(F.col("d").alias("md"), F.col("th").alias("mth"), "keep_runs").hint("shuffle_hash")
    on = F.col("d").eqNullSafe(F.col("md")) & (F.col("th") == F.col("mth"))
    clean = F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col("keep_runs")))
    return docs.select(*_row(docs, host)).join(masks, on, "left").select(F.col("d").alias("doc_id"), "text", clean.alias("clean"))


def _line_chars(text: str) -> Column:
    """Characters of all lines without white space at their ends."""
    return F.length(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS))), ""))


def apply_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text) for each row.

    The counts are of the text as given; the text returned has lost its host's frequent lines, and
    ``kept`` is decided by what it has left.
    """
    counts = base_counts(remove_lines(docs, host, max_docs))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # an untouched text, as most are, keeps all
    poor = (F.length("clean") < F.length("text")) & (_line_chars("clean") < F.lit(min_left) * _line_chars("text"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~poor).alias("kept"), F.col("clean").alias("text"))
