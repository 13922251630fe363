"""The stages' rows against brute force over what each stage was given."""

import random

from flickerlake.llm import langid, packing, quality

from .conftest import prose
from .test_linedup import brute as brute_lines
from .test_models import noisy
from .test_packing import check
from .test_neardup import brute as brute_near


def test_stages_and_run(spark, make_docs, tables, odd_texts):
    import corpus_pipeline

    rng = random.Random(21)
    texts = [t for t in odd_texts if len(t or "") < 10_000]
    texts += [prose(rng, rng.choice(["en", "fr", "de"]), 70) if rng.random() < 0.8 else noisy(rng) for _ in range(200)]
    texts += [texts[40], texts[40], texts[41].replace(" ", "  ")] + ["Shared line of many\n" + prose(rng, words=60) for _ in range(12)]
    langs = ["de" if "ch" in (t or "") else "fr" if "é" in (t or "") else "en" for t in texts]
    docs = make_docs(texts, langs)
    labels = spark.createDataFrame([(k, int("***" not in (t or "") and "%%%" not in (t or "")), 0) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    root = tables(documents=docs, labels=labels)

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "lines", "near_duplicates", "packing"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    given = spark.read.parquet(f"{root}/documents.parquet")

    model = langid.fit(given)
    rows = [(d, t) for d, t in rows if model.predict(t)[0] != "und" and model.predict(t)[1] >= 0.5]
    given = corpus_pipeline.language(spark, given, root)
    assert sorted((r.doc_id, r.text) for r in given.collect()) == sorted(rows) and given.columns == docs.columns

    grader = quality.fit(given, labels)
    rows = [(d, t) for d, t in rows if grader.score(t) >= 0.3]
    given = corpus_pipeline.good(spark, given, root)
    assert sorted((r.doc_id, r.text) for r in given.collect()) == sorted(rows) and given.columns == docs.columns

    kept = brute_lines(rows, 10)
    rows = [(d, kept[d, t][0]) for d, t in rows]
    given = corpus_pipeline.lines(spark, given, root)
    got = given.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows) and given.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got)

    least = set(brute_near([d for d, _ in rows], [t for _, t in rows]))
    rows = [(d, t) for d, t in rows if d in least]
    given = corpus_pipeline.distinct(spark, given, root)
    assert sorted((r.doc_id, r.text) for r in given.collect()) == sorted(rows) and given.columns == docs.columns

    got = corpus_pipeline.run(spark, root).collect()
    assert check(got, dict(rows), packing.WINDOW) == 0


def test_empty_documents(spark, make_docs, tables):
    import corpus_pipeline

    docs = make_docs(["x"]).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, tables(documents=docs, labels=labels)).collect() == []


def test_stages_on_odd_tables(spark, make_docs, tables, odd_texts):
    """Null, empty and very long texts, null and repeated ids, repeated rows, columns of all kinds of names."""
    import corpus_pipeline

    rng = random.Random(23)
    texts = [*odd_texts, prose(rng, words=30), prose(rng, words=30)] + [prose(rng, "fr", 30) for _ in range(10)]
    ids = [None, *range(1, len(texts) - 1), 5]
    extra = "n_lines N_DROPPED th node row root key fp keep_runs d score lang_pred label rank n"
    docs = make_docs(texts + texts[-3:], ["en"] * 16 + ["fr"] * 13, ids=ids + ids[-3:], extra=extra)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(None, None, 0)], "doc_id long, quality int, toxic int")
    root = tables(documents=docs, labels=labels)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        rows = out.collect()
        if name == "packing":
            assert sum(r.length for r in rows if r.doc_id == 7) > 0 and len({r.sequence_id for r in rows}) >= 1
            continue
        assert out.columns == docs.columns, name
        assert all(r.n_lines == 7 and r.N_DROPPED == 7 and r.th == 7 for r in rows), name
        if name == "lines":
            assert len(rows) == len(texts) + 3 and all(r.text is not None for r in rows)
        if name == "near_duplicates":
            assert sum(not (r.text or "").strip() for r in rows) == 1 and sum(r.text == odd_texts[8] for r in rows) == 1
