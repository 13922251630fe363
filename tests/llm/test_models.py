import random
import zlib

import numpy as np
import pytest

from flickerlake.llm import ftrl, langid, quality

from .conftest import SYLLABLES, prose


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(make_docs):
    rng = random.Random(15)
    langs = [rng.choice([*SYLLABLES]) for _ in range(300)]
    return make_docs([prose(rng, x, rng.randint(20, 120)) for x in langs], langs)


def test_language_on_held_out_rows(corpus):
    rows = langid.predict(corpus, langid.fit(corpus)).join(corpus, "doc_id").collect()
    assert len(rows) == 300
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 30 and np.mean(held) > 0.97


def test_language_ignores_everything_but_learnable_texts(spark, make_docs, corpus):
    """Changing held-out rows and null labels leaves the model as it is."""
    rows = corpus.collect()
    other = [(r.doc_id, r.text, "xx" if is_held_out(r.doc_id) else r.lang, "other", 0) for r in rows] + [(None, "abc", "zz", "s", 3), (1001, "abc def", None, "s", 7)]
    a, b = langid.fit(corpus), langid.fit(spark.createDataFrame(other, corpus.schema))
    assert a.languages == b.languages and np.allclose(a.weights, b.weights) and a.temperature == b.temperature


def test_language_edges(spark, make_docs, odd_texts, corpus):
    model = langid.fit(corpus)
    docs = make_docs(odd_texts, langs=[None] * len(odd_texts), extra="lang_pred score held_out")
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for k, t in enumerate(odd_texts):
        assert (rows[k].lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"und"}
    assert langid.keep_identified(docs, langid.fit(docs)).count() == len(odd_texts)
    kept = langid.keep_identified(docs, model, least=0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows.values())
    empty = corpus.where("false")
    assert langid.fit(empty).languages == [] and langid.predict(empty, model).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 200])
def test_ngram_counts_are_chunked_exactly(monkeypatch, n):
    rng = random.Random(n)
    text = "".join(rng.choices("abÉ é1 .,\n  zß", k=n))
    whole = langid.ngram_counts(text)
    for chunk in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        parts = langid.ngram_counts(text)
        assert (whole is None) == (parts is None)
        if whole:
            assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_document_frequencies_over_many_tasks(corpus):
    n, df = langid.document_frequencies(corpus.repartition(70).select("text"))
    expected = np.zeros(langid.DIMS, np.int64)
    for r in corpus.collect():
        expected[langid.ngram_counts(r.text)[0]] += 1
    assert n == 300 and np.array_equal(df, expected)


def noisy(rng):
    return " ".join(w + rng.choice(["***", "%%%", "&&&"]) for w in prose(rng, words=60).split())


@pytest.fixture(scope="module")
def graded(spark, make_docs):
    rng = random.Random(16)
    good = [rng.random() < 0.8 for _ in range(300)]
    docs = make_docs([prose(rng, words=60) if g else noisy(rng) for g in good])
    labels = spark.createDataFrame([(k, int(g), 0) for k, g in enumerate(good)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, good


def test_quality_on_held_out_rows(graded):
    docs, labels, good = graded
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    held = [r for r in rows if is_held_out(r.doc_id)]
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len(held) > 30 and np.mean([r.predicted == good[r.doc_id] for r in held]) > 0.95


def test_quality_learns_from_learnable_rows_alone(spark, graded):
    docs, labels, _ = graded
    flipped = [(r.doc_id, 1 - r.quality if r.doc_id is not None and r.quality is not None and is_held_out(r.doc_id) else r.quality, 1) for r in labels.collect()]
    a, b = quality.fit(docs, labels), quality.fit(docs, spark.createDataFrame(flipped, labels.schema))
    assert np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_quality_edges(spark, make_docs, odd_texts, graded):
    docs, labels, _ = graded
    model = quality.fit(docs, labels)
    odd = make_docs(odd_texts, extra="score predicted label")
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (0, 1)} == {model.score("")}
    assert quality.keep_good(odd, model).columns == odd.columns
    none = quality.fit(docs, labels.where("false"))
    assert none.score("anything") == 0.5
    assert quality.fit(docs, labels.where("quality = 1")).score("anything") > 0.99
    assert quality.score(odd.where("false"), model).collect() == []


def test_quality_features_are_chunked_exactly(monkeypatch):
    text = noisy(random.Random(17)) + " SHOUT SHOUT\n\nend 12 12"
    at, x = quality.features(text)
    for chunk in (1, 2, 5):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        other = quality.features(text)
        assert np.array_equal(at, other[0]) and np.allclose(x, other[1])


def test_ftrl_elastic_net_makes_sparse_weights():
    rng = np.random.default_rng(18)
    rows = [(np.array([y, 2 + rng.integers(50)]), np.ones(2)) for y in rng.integers(0, 2, 400)]
    labels = [int(r[0][0]) for r in rows]
    dense, _ = ftrl.Ftrl(60, 2, l1=0.0).fit(rows, labels)
    sparse, bias = ftrl.Ftrl(60, 2, l1=1.0).fit(rows, labels)
    assert (sparse != 0).sum() < (dense != 0).sum()
    assert all(int((x @ sparse[at] + bias).argmax()) == y for (at, x), y in zip(rows, labels))


def test_temperature_softens_wrong_certainty():
    logits = np.array([[9.0, 0.0]] * 10)
    assert ftrl.temperature(logits, np.array([0] * 7 + [1] * 3)) > 5
    assert ftrl.temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


M = (1 << 64) - 1


def slow_grams(text, dims):
    """Counts of hashed 1- to 3-grams, gram by gram."""
    codes = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    codes = [c for k, c in enumerate([32, *codes, 32]) if c != 32 or k == 0 or [32, *codes, 32][k - 1] != 32]
    if not any(chr(c).isalpha() for c in codes):
        return None
    mixed, counts = [c * 0x9E3779B97F4A7C15 & M for c in codes], {}
    for order in (1, 2, 3):
        for end in range(order - 1 if order > 1 else 1, len(codes)):
            g = mixed[end]
            for back in range(1, order):
                g = ((g ^ (g >> 29)) * 0xBF58476D1CE4E5B9 + mixed[end - back]) & M
            bucket = (((g ^ (g >> 32)) * 0x94D049BB133111EB & M) >> 40) % dims
            counts[bucket] = counts.get(bucket, 0) + 1
    return counts


def slow_ftrl(rows, labels, classes, dims, epochs, l1, l2, alpha=0.5, beta=1.0):
    """Follow-the-regularised-leader, coordinate by coordinate."""
    z = [[0.0] * classes for _ in range(dims + 1)]
    n = [[0.0] * classes for _ in range(dims + 1)]

    def weight(i, k):
        if i == dims:
            return -z[i][k] * alpha / (beta + n[i][k] ** 0.5)
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - (l1 if z[i][k] > 0 else -l1)) / ((beta + n[i][k] ** 0.5) / alpha + l2)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            x = {**rows[r], dims: 1.0}
            w = {i: [weight(i, k) for k in range(classes)] for i in x}
            logits = [sum(v * w[i][k] for i, v in x.items()) for k in range(classes)]
            e = [np.exp(v - max(logits)) for v in logits]
            for k in range(classes):
                p = e[k] / sum(e) - (k == labels[r])
                for i, v in x.items():
                    g = v * p
                    sigma = ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / alpha
                    z[i][k] += g - sigma * w[i][k]
                    n[i][k] += g * g
    return lambda x: [sum(v * weight(i, k) for i, v in {**x, dims: 1.0}.items()) for k in range(classes)]


def unit(counts, weight=lambda i: 1.0):
    x = {i: (1 + np.log(c)) * weight(i) for i, c in counts.items()}
    norm = sum(v * v for v in x.values()) ** 0.5
    return {i: v / norm for i, v in x.items()}


def test_language_scores_against_brute_force(make_docs):
    rng = random.Random(51)
    langs = [rng.choice([*SYLLABLES]) for _ in range(90)]
    texts = [prose(rng, x, 12) for x in langs]
    docs, dims = make_docs(texts, langs), 64
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs, dims, epochs=2)).collect()}
    learn = [k for k in range(90) if not is_held_out(k)]
    counts = [slow_grams(t, dims) for t in texts]
    df = [sum(b in counts[k] for k in learn) for b in range(dims)]
    x = [unit(c, lambda b: np.log((1 + len(learn)) / (1 + df[b])) + 1) for c in counts]
    names = sorted(SYLLABLES)
    import xxhash

    def fold(k):
        # two-step hash of Spark: the seed of a column is the hash of the one before
        h = xxhash.xxh64_intdigest(k.to_bytes(8, "little"), xxhash.xxh64_intdigest(b"fold", 42))
        return (h - (1 << 64) if h >> 63 else h) % 5

    train, rest = [k for k in learn if fold(k)], [k for k in learn if not fold(k)]
    logits = slow_ftrl([x[k] for k in train], [names.index(langs[k]) for k in train], 3, dims, 2, 2e-2, 1e-3)
    soft = lambda v, t: np.exp((np.array(v) - max(v)) / t) / np.exp((np.array(v) - max(v)) / t).sum()
    right, losses = (len(rest) + 1) / (len(rest) + 2), []
    grid = np.geomspace(0.02, 20, 200)
    for t in grid:
        p = np.clip([soft(logits(x[k]), t)[names.index(langs[k])] for k in rest], 1e-12, 1 - 1e-12)
        losses.append(-(right * np.log(p) + (1 - right) * np.log(1 - p)).mean())
    t = grid[int(np.argmin(losses))]
    for k in range(90):
        p = soft(logits(x[k]), t)
        assert got[k][0] == names[int(p.argmax())] and abs(got[k][1] - p.max()) < 2e-3


def slow_quality(text, dims):
    import xxhash

    tokens = [m.group() for m in quality.TOKEN.finditer(text)]
    word = [xxhash.xxh32_intdigest(t.lower()) for t in tokens]
    shape = []
    for k, t in enumerate(tokens):
        if t[0].isalpha():
            s = "X" if t.isupper() and len(t) > 1 else "Xx" if t[0].isupper() else "x"
        else:
            s = "0" if t[0].isdigit() else t[:4]
        shape.append(xxhash.xxh32_intdigest(s, 1) + (0x5BD1E995 if k and word[k] == word[k - 1] else 0))
    mix = lambda a, b: (a * 0x94D049BB133111EB & M) ^ b
    two = [mix(a, b) for a, b in zip(word, word[1:])]
    shape2 = [mix(a, b) for a, b in zip(shape, shape[1:])]
    shape3 = [mix(a, b) for a, b in zip(shape2, shape[2:])]
    counts = {}
    for stream, grams in enumerate((word, two, shape, shape2, shape3)):
        for g in grams:
            h = (g + stream) * 0x9E3779B97F4A7C15 & M
            bucket = (((h ^ (h >> 32)) * 0xBF58476D1CE4E5B9 & M) >> 36) % dims
            counts[bucket] = counts.get(bucket, 0) + 1
    return unit(counts)


def test_quality_scores_against_brute_force(spark, make_docs):
    rng = random.Random(52)
    texts = [prose(rng, words=15) if k % 3 else noisy(rng)[:120] for k in range(60)]
    docs, dims = make_docs(texts), 128
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(50)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, dims, epochs=2)).collect()}
    learn = [k for k in range(50) if not is_held_out(k)]
    x = [slow_quality(t, dims) for t in texts]
    logits = slow_ftrl([x[k] for k in learn], [int(k % 3 > 0) for k in learn], 2, dims, 2, 5e-3, 1e-3)
    for k in range(60):
        a, b = logits(x[k])
        assert abs(got[k] - 1 / (1 + np.exp(a - b))) < 2e-3


def test_more_languages_than_any_cap(spark, make_docs):
    """520 languages, each of letters of its own, are all learned from a few rows each."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1040)]
    texts = [(letters[2 * k] + letters[2 * k + 1]) * 5 for k in range(520)]
    docs = make_docs([t for t in texts for _ in range(8)], [f"l{k:03}" for k in range(520) for _ in range(8)])
    model = langid.fit(docs, dims=4096, l1=1e-4, epochs=2)
    assert len(model.languages) == 520
    rows = langid.predict(docs, model).join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9


def test_sample_is_bounded_in_entries(spark):
    from flickerlake.llm.common import within

    rows = spark.createDataFrame([(k, [1] * k) for k in range(1, 11)], "rank long, at array<int>")
    assert sorted(r.rank for r in within(rows, 10).collect()) == [1, 2, 3, 4]
    assert within(rows, 1000).count() == 10 and within(rows.where("false"), 5).count() == 0


def test_queries(spark, make_docs, tables):
    from flickerlake.llm.registry import QUERIES

    rng = random.Random(53)
    langs = [rng.choice([*SYLLABLES]) for _ in range(60)]
    docs = make_docs([prose(rng, x, 20) for x in langs] + [None, ""], [*langs, None, None])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    root = tables(documents=docs, labels=labels)
    found = QUERIES["op6_langid"](spark, root).collect()
    assert sorted(r.doc_id for r in found) == list(range(62)) and {r.lang_pred for r in found if r.doc_id >= 60} == {"und"}
    scored = QUERIES["op9_quality"](spark, root).collect()
    assert sorted(r.doc_id for r in scored) == list(range(62)) and all((r.score >= 0.3) == r.predicted for r in scored)
