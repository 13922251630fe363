import random
import re

import numpy as np
import pytest
import xxhash

from flickerlake.llm import simhash
from flickerlake.llm.common import LOWER, SPACE_CLASS, UPPER

from .conftest import prose


def slow_fingerprint(text):
    words = [w for w in re.split(SPACE_CLASS, (text or "").translate(str.maketrans(UPPER, LOWER))) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, budget=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(ids)):
        members.setdefault(find(i), []).append(ids[i])
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_fingerprints(odd_texts):
    rng = random.Random(7)
    for text in [t for t in odd_texts if len(t or "") < 60_000] + [prose(rng, words=n) for n in range(1, 40)]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.xxhash64(F.lit("le été ça")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("le été ça".encode(), 42)


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_trie_join_finds_every_pair(budget):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 40, (60, 2))]))
    found = set()
    simhash.trie_join(keys, 64 - 8, budget, lambda i, j: found.update(zip(i.tolist(), j.tolist())))
    expected = {(i, j) for i in range(len(keys)) for j in range(len(keys)) if i < j and keys[i] >> np.uint64(56) == keys[j] >> np.uint64(56) and int(keys[i] ^ keys[j]).bit_count() <= budget}
    assert {tuple(sorted(p)) for p in found} == expected


def test_links_across_all_blocks(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    for f in [*fps]:
        a, b = rng.sample(range(64), 2)
        fps |= {f ^ 1 << a, f ^ 1 << a ^ 1 << b, f ^ 0b111 << min(a, 61)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    rooted = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for f, c in zip(fps, brute_components(fps, fps)):
        groups.setdefault(c, set()).add(f)
    for members in groups.values():
        roots = {rooted.get(f, f) for f in members}
        assert len(roots) == 1 and roots <= members


def test_long_chain_and_hub(spark):
    chain = [(k, k + 1) for k in range(200)]
    hub = [(1000, k) for k in range(1001, 1400)]
    df = spark.createDataFrame(chain + hub, "a long, b long").repartition(4)
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and all(got[k] == 1000 for k in range(1001, 1400))


def test_near_duplicates_against_brute_force(spark, make_docs, odd_texts):
    rng = random.Random(10)
    texts = [*odd_texts]
    for _ in range(30):
        t = prose(rng, words=400)
        texts += [t, t, t.replace(" ", "  "), t + " end"][: rng.randint(1, 4)]
    ids = [None if k == 20 else 1000 - k for k in range(len(texts))]
    docs = make_docs(texts, ids=ids, extra="fp th root place none")
    fps = [simhash.fingerprint(t) for t in texts]
    expected = sorted(zip((i or -1 for i in ids), fps, (c or -1 for c in brute_components(ids, fps))))
    got = sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == expected


def test_repeated_rows_and_empty(spark, make_docs):
    docs = make_docs(["a b c d", "a b c d", "a b c d"], ids=[3, 3, 9])
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {3}
    assert simhash.near_duplicates(docs.where("false")).collect() == []


def test_texts_are_worked_in_parts_exactly(monkeypatch):
    from flickerlake.llm import common

    rng = random.Random(22)
    texts = [prose(rng, words=n) for n in (1, 2, 3, 4, 50)] + ["", " ", "a  b\tc\nd", "x" * 30]
    whole = [simhash.fingerprint(t) for t in texts]
    for size in (1, 5, 17):
        monkeypatch.setattr(simhash, "pieces", lambda t, size=size: common.pieces(t, size))
        assert [simhash.fingerprint(t) for t in texts] == whole
        assert all("".join(common.pieces(t, size)) == t for t in texts)


def test_one_hot_key_of_32_bits_in_bounded_memory():
    """Subtries are joined one after the other, a large one in bounded frontiers."""
    import tracemalloc

    rng = np.random.default_rng(42)
    low = np.unique(rng.integers(0, 1 << 32, 200_000, dtype=np.uint64))
    fps = (np.uint64(0xABCD1234) << np.uint64(32) | low)
    near = fps[:500] ^ np.uint64(1 << 7)
    keys = np.unique(np.concatenate([fps, near]))
    forest = simhash.Forest(len(keys))
    tracemalloc.start()
    simhash.trie_join(keys, 32, 2, forest.union)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    at, to = np.searchsorted(keys, fps[:500]), np.searchsorted(keys, near)
    assert (forest.roots(at) == forest.roots(to)).all()


def test_subtries_in_streams_of_any_chunk(spark, monkeypatch):
    rng = random.Random(43)
    fps = sorted({rng.getrandbits(64) for _ in range(300)} | {f ^ 3 << rng.randrange(60) for f in [rng.getrandbits(64)] * 60})
    fps += [f ^ 1 << 9 for f in fps[:40]]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(set(fps))], "fp long")
    whole = {(r.node, r.root) for r in simhash.components(simhash.links(df)).collect()}
    parts = df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {(r.node, r.root) for r in simhash.components(simhash.links(df)).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", parts)


def test_query(spark, make_docs, tables, odd_texts):
    from flickerlake.llm.registry import QUERIES

    fps = [simhash.fingerprint(t) for t in odd_texts]
    expected = sorted(zip(range(len(odd_texts)), (f"{f:016x}" for f in fps), brute_components([*range(len(fps))], fps)))
    got = QUERIES["op8_simhash"](spark, tables(documents=make_docs(odd_texts))).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
