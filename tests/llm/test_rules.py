import random
import re
from collections import Counter, defaultdict

from flickerlake.llm import rules
from flickerlake.llm.common import LOWER, SPACE_CHARS, UPPER

from .conftest import prose

LOW = str.maketrans(UPPER, LOWER)


def brute(rows, max_docs=rules.MAX_DOCS, min_left=rules.MIN_LEFT):
    hosts = defaultdict(set)
    key = lambda x: x.strip(SPACE_CHARS).translate(LOW)
    for doc_id, text, host in rows:
        for line in (text or "").split("\n"):
            if key(line):
                hosts[host, key(line)].add((doc_id, text or ""))
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        lines = [x for x in text.split("\n") if x.strip(SPACE_CHARS)]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
        every = sum(len(key(x)) for x in lines)
        left = sum(len(key(x)) for x in lines if len(hosts[host, key(x)]) < max_docs)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append((-1 if doc_id is None else doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and not left < min_left * every))
    return sorted(out)


def run(docs, **options):
    rows = rules.apply_rules(docs, **options).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows)


def test_against_brute_force(make_docs, odd_texts):
    rng = random.Random(19)
    texts, hosts = [*odd_texts], ["s"] * len(odd_texts)
    for _ in range(120):
        body = prose(rng, words=rng.randint(5, 60)).split()
        if rng.random() < 0.4:
            at = rng.randrange(len(body))
            body += body[at : at + rng.randint(1, 9)] * rng.randint(1, 4)
        if rng.random() < 0.3:
            body.insert(0, "#*$%&|<>é")
        lines = [" ".join(body[i : i + 12]) for i in range(0, len(body), 12)]
        lines += rng.choices(["Share this page\t", "share THIS page", "Footer of every page of this host", "", "x x x x x x x x"], k=rng.randint(0, 6))
        texts.append("\n".join(lines))
        hosts.append(rng.choice(["a", "a", "a", "b", None]))
    ids = [None if k == 30 else k for k in range(len(texts))]
    docs = make_docs(texts, sources=hosts, ids=ids, extra="d th host h1 words kept count")
    assert run(docs, max_docs=5, min_left=0.5) == brute([*zip(ids, texts, hosts)], 5, 0.5)


def boilerplate_pages():
    """A host's shared pages under ids of their own, pages of mostly shared lines, clean pages, and repeated rows."""
    rng = random.Random(20)
    clean, shared = prose(rng, words=40), "menu home about contact help terms privacy and imprint of this host"
    texts = [clean] * 19 + [prose(rng, words=40) + f"\n{shared}" for _ in range(15)] + [f"{shared}\nword {k}" for k in range(30)]
    page = prose(rng, words=30)
    return [(k, t, "s") for k, t in enumerate(texts)] + [(100 + k, page, "t") for k in range(20)] + [(200, clean, "u")] * 40


def test_the_method_itself_rejects(spark, make_docs, tables):
    """Through the registered query and its SQL."""
    import duckdb

    from flickerlake.llm.registry import ORACLES, QUERIES

    rows = boilerplate_pages()
    docs = make_docs([t for _, t, _ in rows], ids=[d for d, _, _ in rows], sources=[h for _, _, h in rows])
    root = tables(documents=docs)
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in QUERIES["op7_rules"](spark, root).collect())
    assert got == brute(rows)
    kept = {d: k for d, *_, k in got}
    # 19 copies stay, those of a page that the host has 20 times go, repeated rows are one document
    assert all(kept[d] for d in (*range(34), 200)) and not any(kept[d] for d in (*range(34, 64), *range(100, 120)))
    assert not any(f for d, *_, f, _ in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{root}/documents.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({ORACLES['op7_rules']})").fetchall()) == got


def test_repeated_words_in_one_text(make_docs):
    text = " ".join(["a b c d e f"] * 3 + [f"w{k}" for k in range(40)])
    assert run(make_docs([text, "a " * 12, "a b c d e a b c d", None])) == brute([(0, text, "s"), (1, "a " * 12, "s"), (2, "a b c d e a b c d", "s"), (3, None, "s")])


def test_empty_table_and_plan(make_docs):
    docs = make_docs(["x"])
    assert run(docs.where("false")) == []
    plan = rules.apply_rules(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_frequent_lines_are_removed_from_the_texts(make_docs):
    rng = random.Random(35)
    shared = "menu home about contact"
    texts = [f"{prose(rng, words=30)}\n {shared.upper()}\t\n\n{prose(rng, words=30)}\n{shared}" for _ in range(20)]
    texts += [None, shared, f"{shared}\nother host", "no shared line\n\nat all"]
    hosts = ["a"] * 22 + ["b", "a"]
    rows = {r.doc_id: r for r in rules.apply_rules(make_docs(texts, sources=hosts)).collect()}
    for k, text in enumerate(texts):
        lines = (text or "").split("\n")
        assert rows[k].text == "\n".join(x for x in lines if hosts[k] == "b" or x.strip(SPACE_CHARS).translate(LOW) != shared)
    assert rows[0].text != texts[0] and rows[0].kept and rows[21].text == "" and rows[22].text == texts[22]
