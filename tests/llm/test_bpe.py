import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from flickerlake.llm import bpe


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers as P

    own = bpe.codec(bpe.default_path())
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.words.ranks, special_tokens={})


def test_equals_the_library_on_random_text(pair):
    own, library = pair
    rng = random.Random(4)
    alphabet = "aàéñ1²\x1c\x85\xa0\n '’st.ll#日本語😀́ \r\t<|endoftext|>"
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 50)))
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 20_000, "é" * 9_000, " " * 30_000, "xyzzy" * 5_000, "\n" * 777])
def test_very_long_pretokens(pair, text):
    own, library = pair
    assert own.encode(text) == library.encode_ordinary(text)


def test_queue_order_and_equal_ranks():
    q = bpe.RankQueue()
    for rank, at in [(70_000, 1), (3, 9), (3, 2), (256, 5), (255, 6)]:
        q.push(rank, at)
    assert [q.pop() for _ in range(5)] == [(3, 2), (3, 9), (255, 6), (256, 5), (70_000, 1)]
    assert q.top == 0


def test_queries_and_edges(spark, make_docs, odd_texts, pair):
    own, library = pair
    df = make_docs(odd_texts, ids=[*range(len(odd_texts) - 1), None], extra="ids content n_tokens")
    rows = bpe.encode_digests(df).collect()
    assert len(rows) == len(odd_texts)
    by_id = {r.doc_id: r for r in rows}
    for k, text in enumerate(odd_texts[:-1]):
        ids = library.encode_ordinary(text or "")
        r = by_id[k]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df)).join(df.select("doc_id", "text"), "doc_id")
    assert back.where(F.col("content") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert bpe.encode_digests(df.where("false")).collect() == []


def test_query(spark, make_docs, tables, odd_texts):
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    from flickerlake.llm.registry import QUERIES

    with open(bpe.default_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op10_byte_bpe"](spark, tables(documents=make_docs(odd_texts))).collect():
        ids = library.encode_ordinary(odd_texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((odd_texts[r.doc_id] or "").encode()).hexdigest()
