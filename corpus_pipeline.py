"""From raw documents to packed token sequences: language, quality, lines, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flickerlake.llm import langid, linedup, neardup, packing, quality
from flickerlake.llm.common import discard, materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; those without a letter or a likely language go.

    Null and empty texts have no letter and go; a null doc_id is carried along; repeated rows share their
    fate; ties between languages go to the first in order; a very long text is judged whole; an empty
    table, or one without any lang, passes as it is; further columns are kept, whatever their names.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as the labels' good ones go on.

    Null and empty texts are scored by the intercept; a null doc_id is carried along; repeated rows share
    their fate; a score at the threshold stays; a very long text is scored whole; an empty table gives no
    rows; without labels of both kinds all score alike; further columns are kept, whatever their names.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; every document stays, its n_chars brought up to date.

    Null texts become empty; a null doc_id is a value like any other; repeated rows count once and lose
    the same lines; ties don't arise; a very long text is worked whole; an empty table gives no rows;
    columns named n_lines or n_dropped are carried around the operator, other columns are kept.
    """
    aside = {c: f"__kept_{k}" for k, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_dropped")}
    kept = linedup.keep_lines(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 in 5-word shingles stays, that with the smallest doc_id.

    Null, empty and blank texts are one group; a null doc_id stays only if its whole group has none;
    repeated rows and ties leave one row, ties on doc_id the smaller text hash; a very long text is compared
    whole; an empty table gives no rows; further columns are kept, whatever their names.
    """
    return neardup.keep_representatives(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in sequences.

    Null and empty texts are their end token; a null doc_id is carried along; repeated rows are packed
    once each; of windows that fit equally well the one opened first is taken; a very long text is cut;
    an empty table gives no rows; further columns are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality", good),
    ("lines", lines),
    ("near_duplicates", distinct),
    ("packing", sequences),
]

#: Trained models and tokens have no SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage was given goes when its own rows are there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        given, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(given)
    return docs
