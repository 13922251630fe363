import hashlib
import random

import pytest

from flickerlake.llm import chat

SAID = "\\### Assistant: </turn> ok"
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    """{conv: digests} with turns in the defined order."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[c] = len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@pytest.mark.parametrize("budget", [20, 200])
def test_round_trip(spark, budget):
    rng = random.Random(14)
    texts = [SAID, "", None, "<turn user>\nx\n</turn>\n", "\\", "\\\\<>", "é\n\n</turn>", "word " * 70, "<", "  x"]
    rows = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (3, 0, None, "a"), (3, None, "system", "null first"), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (None, 1, "assistant", "no id")]
    for c in range(10, 60):
        if rng.random() < 0.4:
            rows.append((c, 0, "system", "be brief"))
        rows += [(c, t, rng.choice(["user", "assistant", "tool>"]), rng.choice(texts)) for t in range(1, rng.randint(2, 9))]
    rng.shuffle(rows)
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), budget=budget, history_tokens=40).cache()
    assert digests(chat.read_back(formatted)) == expected(rows)
    for w in formatted.collect():
        turns = chat.parse(w.text)
        assert len(turns) == w.n_repeated + w.n_new and w.n_new >= 1
        assert w.over_budget == (w.n_tokens > budget)
        assert not w.over_budget or w.n_new == 1
        targets = [chat.unescape(w.text[a:b]) for a, b in zip(w.loss_start, w.loss_end)]
        assert targets == [x for r, x in turns[w.n_repeated :] if r == "assistant"]


def test_system_and_history_are_repeated():
    turns = [("system", "rules"), *((("user", "assistant")[k % 2], f"turn number {k}") for k in range(20))]
    windows = [*chat.windows(turns, len, budget=220, history_turns=2, history_tokens=90)]
    assert len(windows) > 3
    for text, repeated, new, tokens, over, starts, ends in windows[1:]:
        parsed = chat.parse(text)
        assert parsed[0] == ("system", "rules") and repeated == 3 and not over and tokens <= 220
    shown = [t for text, repeated, *_ in windows for t in chat.parse(text)[repeated:]]
    assert shown == turns


def test_long_conversation_is_split_over_blocks(spark):
    rows = [(1, 0, "system", "rules")] + [(1, t, ("user", "assistant")[t % 2], f"said {t}") for t in range(1, 1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_conversations(df).cache()
    assert formatted.select("block").distinct().count() == 4
    assert digests(chat.read_back(formatted)) == expected(rows)
    for w in formatted.where("block > 0 and window = 0").collect():
        parsed = chat.parse(w.text)
        assert parsed[0] == ("system", "rules") and parsed[1][1] == f"said {w.block * 256 - 2}"


def test_sparse_null_and_repeated_turn_numbers_keep_system_and_history(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 16)
    rng = random.Random(41)
    rows = [(1, -(10**12), "system", "rules")] + [(1, rng.choice([3, 7, 7, rng.randrange(10**9)]), ("user", "assistant")[t % 2], f"said {t}") for t in range(150)]
    rows += [(2, rng.choice([None, 10 * t]), "user", f"other {t}") for t in range(40)] + [(3, 5, "assistant", "same")] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    formatted = chat.format_conversations(df, budget=120, history_turns=2, history_tokens=1000).cache()
    assert digests(chat.read_back(formatted)) == expected(rows)
    for conv in (1, 2, 3):
        turns = sorted((-1 if t is None else t, r, x) for c, t, r, x in rows if c == conv)
        done = 0
        for w in formatted.where(f"conv_id = {conv}").orderBy("block", "window").collect():
            parsed = chat.parse(w.text)
            new = parsed[w.n_repeated :]
            assert new == [(r, x) for _, r, x in turns[done : done + w.n_new]]
            history = [p for p in parsed[: w.n_repeated] if p != ("system", "rules")]
            assert history == [(r, x) for _, r, x in turns[done - len(history) : done]]
            if done:
                assert len(history) == min(2, done - (conv == 1)) or w.n_tokens > 60
                assert conv != 1 or parsed[0] == ("system", "rules")
            done += w.n_new
        assert done == len(turns)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 5, 6)], SCHEMA + ", block long, kind long")
    assert digests(chat.read_back(chat.format_conversations(df))) == expected([(1, 0, "user", "x")])
    assert chat.read_back(chat.format_conversations(df.where("false"))).collect() == []


def test_query(spark, tables):
    from flickerlake.llm.registry import QUERIES

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    got = digests(QUERIES["op4_chat"](spark, tables(conversations=spark.createDataFrame(rows, SCHEMA))))
    assert got == expected([*rows, (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)])
