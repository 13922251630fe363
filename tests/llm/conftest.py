import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the an er in on th ing ed sh wh re at", "fr": "le é eau oi ou que ç è tion aux vi ré", "de": "der ung sch ich keit ein ö ü ver zu ge tz"}


def prose(rng, lang="en", words=80):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words)) + "."


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, langs=None, sources=None, ids=None, extra=""):
        rows = [
            ((ids or range(len(texts)))[k], t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or ""))
            for k, t in enumerate(texts)
        ]
        df = spark.createDataFrame(rows, SCHEMA)
        for c in extra.split():
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit(7))
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, one word, repeats, control characters, other scripts, one very long word."""
    rng = random.Random(3)
    long = prose(rng, words=60_000)
    return [None, "", " \n\t ", "word", "word", "a b", "A\x1cb\x85c\xa0d  e", "日本語 テキスト 😀", "x" * 50_000, long, long, "l\n\nL \n l\nx", "\n", "123 456"]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes tables as <dir>/<name>.parquet and returns the directory."""

    def write(**frames):
        root = str(tmp_path_factory.mktemp("tables"))
        for name, df in frames.items():
            df.write.parquet(f"{root}/{name}.parquet")
        return root

    return write
