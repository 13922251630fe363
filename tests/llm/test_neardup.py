import random

import numpy as np
import pytest

from flickerlake.llm import common, neardup

from .conftest import prose
from .test_simhash import brute_components


def words_of(text):
    return [w for w in common._gap.split((text or "").translate(str.maketrans(common.UPPER, common.LOWER))) if w]


def grams(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(ids, texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(ids[k])
    return sorted(min(g) for g in groups.values())


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_texts_beyond_two_bits_are_one_group(make_docs, odd_texts):
    rng = random.Random(31)
    texts = [t for t in odd_texts if len(t or "") < 60_000]
    for _ in range(40):
        base = prose(rng, words=rng.randint(60, 300))
        n = len(base.split()) // 50
        texts += [base, edited(rng, base, n), edited(rng, base, 2 * n), edited(rng, base, 4 * n), base.upper()]
    base = prose(rng, words=300)
    texts += [edited(rng, base, 2) for _ in range(100)]
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    docs = make_docs(texts, ids=ids, extra="th node root part row a b linked n key fp")
    kept = neardup.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == brute(ids, texts)
    # the fingerprints of op8 within two bits leave many of these
    from flickerlake.llm import simhash

    assert len(set(brute_components(ids, [simhash.fingerprint(t) for t in texts]))) > len(brute(ids, texts)) + 20


@pytest.mark.parametrize("all_pairs, block, part, batch", [(2, 3, 2, 5)])
def test_groups_beyond_all_pairs_lose_no_link(spark, make_docs, monkeypatch, all_pairs, block, part, batch):
    """Copies of a page at all similarities around the limit, in several groups: components as by brute force."""
    for name, value in (("ALL_PAIRS", all_pairs), ("BLOCK", block), ("PART", part)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(44)
    texts = []
    for _ in range(3):
        base = prose(rng, words=150)
        texts += [edited(rng, base, rng.randint(1, 9)) for _ in range(50)]
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        kept = sorted(r.doc_id for r in neardup.keep_representatives(make_docs(texts, ids=ids)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert kept == brute(ids, texts)


def test_blocks_settle_what_a_key_holds(spark):
    """Every similar pair of a key's components that touches a probe, and no other."""
    rng = random.Random(45)
    base = prose(rng, words=120)
    texts = {k: edited(rng, base, rng.randint(1, 5)) for k in range(1, 41)}
    root = {k: 1 if k <= 25 else k for k in texts}
    apart = spark.createDataFrame([(9, k, root[k], root[k] != 1) for k in texts], "key long, node long, root long, probe boolean")
    got = {(r.a, r.b) for r in neardup._settled(apart, spark.createDataFrame([*texts.items()], "node long, text string")).collect()}
    sets = {k: grams(t) for k, t in texts.items()}
    assert got == {(a, b) for a in texts for b in texts if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("similarity, least", [(0.8, 0.995), (0.9, 0.999)])
def test_recall_of_bands(similarity, least):
    rng = np.random.default_rng(33)
    n = 300
    shared = round(2 * similarity / (1 + similarity) * n)
    hit = 0
    for _ in range(1000):
        a, b = (np.concatenate([x, rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)]) for x in [rng.integers(0, 1 << 63, shared, dtype=np.uint64)] * 2)
        hit += bool((neardup.bands(a) == neardup.bands(b)).any())
    assert hit >= 1000 * least


def test_parts_repeats_and_empty(make_docs, monkeypatch):
    rng = random.Random(34)
    texts = [prose(rng, words=n) for n in (1, 4, 5, 6, 50)] + ["", " ", "a  b\tc\nd"]
    whole = [neardup.shingle_set(t).tolist() for t in texts]
    assert [len(x) for x in whole] == [len(grams(t)) for t in texts]
    for size in (1, 5, 17):
        monkeypatch.setattr(neardup, "pieces", lambda t, size=size: common.pieces(t, size))
        assert [neardup.shingle_set(t).tolist() for t in texts] == whole
    docs = make_docs(["a b c d", "A b  c d", "a b c d"], ids=[3, 9, 3])
    assert [r.doc_id for r in neardup.keep_representatives(docs).collect()] == [3]
    assert neardup.keep_representatives(docs.where("false")).collect() == []
