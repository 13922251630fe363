import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flickerlake.llm import linedup
from flickerlake.llm.common import LOWER, SPACE_CHARS, UPPER

LOW = str.maketrans(UPPER, LOWER)


def key(line):
    return line.strip(SPACE_CHARS).translate(LOW)


def brute(docs, min_docs, keep="none"):
    """{(doc_id, text): (kept, n_lines, n_dropped)}."""
    seen, first = defaultdict(set), {}
    for d, t in sorted(set(docs), key=lambda x: x[0]):
        for pos, line in enumerate((t or "").split("\n")):
            if key(line):
                seen[key(line)].add((d, t or ""))
                first.setdefault(key(line), (d, pos))
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [bool(key(x)) and len(seen[key(x)]) >= min_docs and (keep == "none" or first[key(x)] != (d, p)) for p, x in enumerate(lines)]
        out[d, t] = "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)
    return out


@pytest.mark.parametrize(("min_docs", "keep"), [(3, "none"), (1, "first"), (2, "first")])
def test_against_brute_force(spark, make_docs, odd_texts, min_docs, keep):
    rng = random.Random(6)
    pool = ["one", " One\t", "two", "ÉTÉ", "été", "", "  ", "three", "four four"] + [f"line {k}" for k in range(40)]
    texts = [*odd_texts, *("\n".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(80))]
    docs = make_docs(texts, extra="d th pos row keep_runs n_lines dropped")
    rows = linedup.keep_lines(docs, min_docs, keep).collect()
    expected = brute([*enumerate(texts)], min_docs, keep)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.text, r.n_lines, r.n_dropped) == expected[r.doc_id, texts[r.doc_id]], r.doc_id


def test_repeated_rows_count_once_and_ids_may_clash(spark, make_docs):
    docs = make_docs(["a\nb", "a\nb", "a\nc", "a"], ids=[1, 1, 1, None])
    rows = sorted((r.doc_id or 0, r.text) for r in linedup.keep_lines(docs, 3).collect())
    assert rows == [(0, ""), (1, "b"), (1, "b"), (1, "c")]
    rows = sorted((r.doc_id or 0, r.text) for r in linedup.keep_lines(docs, 4).collect())
    assert rows == [(0, "a"), (1, "a\nb"), (1, "a\nb"), (1, "a\nc")]


@pytest.mark.parametrize("name", ["n_lines", "N_LINES", "N_Dropped"])
def test_columns_of_the_counts_names_give_way(spark, make_docs, name):
    docs = linedup.keep_lines(make_docs(["a\nb"], extra=name))
    assert [c.lower() for c in docs.columns].count(name.lower()) == 1
    assert (docs.first().n_lines, docs.first().n_dropped) == (2, 0)


def test_hot_keys_are_joined_where_they_lie(spark, make_docs, monkeypatch):
    from flickerlake.llm import common

    monkeypatch.setattr(common.keyed_join, "__defaults__", ("n", 5))
    texts = [f"same\nown {k}\nten {k % 4}" for k in range(40)]
    expected = brute([*enumerate(texts)], 10)
    for r in linedup.keep_lines(make_docs(texts)).collect():
        assert (r.text, r.n_lines, r.n_dropped) == expected[r.doc_id, texts[r.doc_id]]


def test_hot_line_and_empty_table(spark, make_docs):
    docs = make_docs([f"same\nown {k}" for k in range(300)])
    assert {r.text for r in linedup.keep_lines(docs).collect()} == {f"own {k}" for k in range(300)}
    assert linedup.keep_lines(docs.where("false")).collect() == []
    assert linedup.keep_bitmaps(docs).agg(F.count("*")).first()[0] == 300


def test_query(spark, make_docs, tables, odd_texts):
    from flickerlake.llm.registry import QUERIES

    rows = QUERIES["op5_line_dedup"](spark, tables(documents=make_docs(odd_texts))).collect()
    expected = brute([*enumerate(odd_texts)], 10)
    for r in rows:
        text, n, dropped = expected[r.doc_id, odd_texts[r.doc_id]]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())


def test_no_python_in_the_plan(spark, make_docs):
    plan = linedup.keep_lines(make_docs(["a\nb"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
