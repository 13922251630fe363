import random
import re

import numpy as np
import pytest

from flickerlake.llm import license_scan as L

from .conftest import prose


def words_of(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


def brute(text, containment=L.CONTAINMENT):
    """{template: spans of words} by exact containment at every window that the scan looks at."""
    words = words_of(text)
    shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    index, out = L.Index(L.TEMPLATES), set()
    for t, (name, template) in enumerate(L.TEMPLATES.items()):
        tw = words_of(template)
        own = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
        step = next(s for (s, w), tables in index.geometry.items() if t in {x for ts in tables[0].values() for x in ts})
        for at in range(0, len(shingles), step):
            if len(own & set(shingles[at : at + index.windows[t]])) >= containment * len(own):
                out.add(name)
    return out


def test_templates_anywhere_whole_or_nearly(spark):
    rng = random.Random(11)
    texts, expected = [], []
    for k in range(150):
        body = prose(rng, rng.choice(["en", "de"]), rng.randint(0, 400)).split()
        name = rng.choice([*L.TEMPLATES])
        notice = L.TEMPLATES[name].split()
        if k % 3 == 1 and len(notice) > 30:
            notice[rng.randrange(len(notice))] = "changed"
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + notice + body[at:]).replace(" ", "\n" if k % 5 == 0 else "  "))
        expected.append(name)
    found = L.Index(L.TEMPLATES).scan(texts)
    for text, name, matches in zip(texts, expected, found):
        assert {m[0] for m in matches} == brute(text)
        if "changed" not in text:
            best = next(m for m in matches if m[0] == name)
            assert best[3] == 1.0 and words_of(text[best[4] : best[5]]) == words_of(L.TEMPLATES[name])


def test_clean_texts_have_no_match():
    rng = random.Random(12)
    assert not any(L.Index(L.TEMPLATES).scan([prose(rng, words=300) for _ in range(50)]))


def test_long_text_across_chunks():
    rng = random.Random(13)
    body = prose(rng, words=150_000).split()
    for at in (0, 65_520, 65_600, 131_060, 149_990):
        body[at:at] = L.TEMPLATES["GPL-notice"].split()
    matches = L.Index(L.TEMPLATES).scan([" ".join(body)])[0]
    assert [m[0] for m in matches] == ["GPL-notice"] * 5 and all(m[3] == 1.0 for m in matches)


def test_collision_bound():
    """The stated chance for the least similarity that must be found."""
    assert 1 - (1 - 0.8 / 1.7) ** L.BANDS > 0.9999


def test_edges(spark, make_docs, odd_texts):
    texts = [*odd_texts, L.TEMPLATES["MIT"], L.TEMPLATES["MIT"].upper()]
    rows = L.scan(make_docs(texts, ids=[*range(len(texts) - 1), None], extra="template containment h")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.template, r.start_word, r.n_words, r.containment) for r in rows) == [(-1, "MIT", 0, 5, 1.0), (len(texts) - 2, "MIT", 0, 5, 1.0)]
    assert L.scan(make_docs(["x"]).where("false")).collect() == []
    with pytest.raises(ValueError):
        L.Index({"short": "too few words"})


def test_shingles_use_lower_case():
    assert np.array_equal(L.shingle_hashes("A b C d E f"), L.shingle_hashes("a B c D e F"))


@pytest.mark.parametrize("name", [*L.TEMPLATES])
def test_notices_in_a_row_are_all_found(name):
    rng = random.Random(36)
    notice = words_of(L.TEMPLATES[name])
    texts, starts = [], []
    for lead in range(9):
        for copies in (1, 2, 5, 40):
            for gap in (0, 1, 3):
                words, own = prose(rng, words=lead).split()[:lead], []
                for _ in range(copies):
                    own.append(len(words))
                    words += notice + ["gap"] * gap
                texts.append(" ".join(words + ["end"] * 20))
                starts.append(own)
    for found, own in zip(L.Index(L.TEMPLATES).scan(texts), starts):
        got = [(m[1], m[2], m[3]) for m in found if m[0] == name]
        assert got == [(at, len(notice), 1.0) for at in own]


def test_changed_notice_beside_a_whole_one():
    notice = words_of(L.TEMPLATES["GPL-notice"])
    changed = [*notice]
    changed[2] = "changed"
    for first, second, shares in ((changed, notice, (False, True)), (notice, changed, (True, False))):
        found = [m for m in L.Index(L.TEMPLATES).scan([" ".join(["x"] + first + second)])[0] if m[0] == "GPL-notice"]
        assert [m[3] == 1.0 for m in found] == [*shares]


def test_query_against_its_sql(spark, make_docs, tables, odd_texts):
    """The registered query, on notices whole, edited, cut and far apart, against exact containment without retrieval."""
    import duckdb

    from flickerlake.llm.registry import ORACLES, QUERIES

    rng = random.Random(81)
    texts = [t for t in odd_texts if len(t or "") < 60_000]
    for name, notice in L.TEMPLATES.items():
        words = notice.split()
        edited = [w if rng.random() > 0.04 else "other" for w in words]
        for body in (words, edited, words[: len(words) // 2]):
            texts.append(f"{prose(rng, words=rng.randint(0, 70))} {' '.join(body)} {prose(rng, words=80)} {notice.upper()}")
    root = tables(documents=make_docs(texts))
    columns = ("doc_id", "template", "start_word", "n_words", "containment")
    got = sorted(tuple(r[c] for c in columns) for r in QUERIES["op1_license_scan"](spark, root).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{root}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op1_license_scan']})").fetchall())
    assert len(got) > 2 * len(L.TEMPLATES)
