"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import discard, materialize, scratch_path  # noqa: F401

#: The white space that separates words, as a regular-expression class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_gap = re.compile(SPACE_CLASS)
#: A key of more than a HOT_KEYS-th of all rows is hot, so there are fewer than HOT_KEYS of them at any size.
HOT_KEYS = 1 << 14
LEAST_HOT = 1 << 16


def pieces(text: str, size: int = 1 << 22) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end behind white space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = at + size
        gap = _gap.search(text, end) if end < len(text) else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt anew where their files are planned as fewer tasks than there are cores.

    Only tables that would leave cores idle are moved; operators take tables as they lie.
    """
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def keyed_join(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, count: str = "n", least: int = LEAST_HOT) -> DataFrame:
    """rows joined with keyed(on, count, ...), one row a key, ``count`` being the key's rows and ``total`` all there are.

    Rows of hot keys stay where they are: hot keys are broadcast, and their counts, which add up to
    ``total`` at most, hold them below HOT_KEYS. All other keys are shuffled. Both read their inputs
    anew, which should be tables.
    """
    limit = max(least, total // HOT_KEYS)
    hot = keyed.where(F.col(count) > limit)
    here = rows.join(F.broadcast(hot), on)
    there = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(count) <= limit), on)
    return here.unionByName(there).drop(count)


def within(rows: DataFrame, most: int, entries: str = "at") -> DataFrame:
    """Of a bounded table, rows in order of ``rank`` while their arrays' entries add up to ``most`` at most."""
    sizes = sorted(rows.select("rank", F.size(entries).alias("size")).collect())
    total, last = 0, None
    for rank, size in sizes:
        total += size
        if total > most:
            break
        last = rank
    return rows if last is None or total <= most else rows.where(F.col("rank") <= last)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; the quick path is for texts in which ``lower`` can do nothing else."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def learnable(doc_id: Column) -> Column:
    """Rows a model may learn from: crc32 of the decimal doc_id is not a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(~learnable(doc_id), F.lit(False))
