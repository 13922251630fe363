import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

from flickerlake.llm import packing

from .conftest import prose


def check(rows, texts, window):
    """Every id once, ids right, sequences gapless and within the window; returns the padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for k, x in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == zlib.crc32(ids[k][at : at + r.length].tobytes())
            if r.ids is not None:
                assert r.ids == ids[k][at : at + r.length].tolist()
            at += r.length
        assert at == len(ids[k])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        if at & (at - 1):
            padding += window - at
    return padding


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_every_id_once_and_no_padding(spark, make_docs, odd_texts, parts):
    rng = random.Random(1)
    texts = odd_texts + [prose(rng, rng.choice(["en", "fr", "de"]), rng.randint(1, 900)) for _ in range(60)]
    df = make_docs(texts, extra="ids offset leftover").repartition(parts)
    rows = packing.pack(df, window=256, open_windows=4, fan_in=2).collect()
    assert check(rows, dict(enumerate(texts)), 256) == 0


def test_without_ids_and_empty(spark, make_docs):
    df = make_docs(["hello there"])
    rows = packing.pack(df, with_ids=False).collect()
    assert all(r.ids is None for r in rows) and sum(r.length for r in rows) == 3
    assert packing.pack(df.where("false")).collect() == []


def test_null_id_and_repeated_rows(spark, make_docs):
    df = make_docs(["same text", "same text", "other"], ids=[5, 5, None])
    rows = packing.pack(df).collect()
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * 3
    assert sum(r.length for r in rows if r.doc_id is None) == 2


def test_quick_encoder_equals_the_file(odd_texts):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode, rng = packing.encoder(path), random.Random(2)
    alphabet = "abcXYZ  \n\t'stl019²éßÀ.,#\x1c\x85\xa0<|endoftext|>"
    for text in [x or "" for x in odd_texts if len(x or "") < 100_000] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_bounded_open_windows():
    packer, rng = packing.Packer(100, 8, 0, False), random.Random(5)
    for k in range(500):
        n = rng.randint(1, 180)
        packer.add(k, 0, np.zeros(n, "<u4"), n)
        assert len(packer.open) <= 8 and sum(len(p[2]) for ps in packer.open.values() for p in ps) < 800
    packer.close(final=True)
    assert not packer.open


def test_very_long_texts_have_the_files_ids():
    """Both libraries beyond a million characters, and white space that only one of them can take."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    encode = packing.encoder(path)
    for text in ("the cat sat on 12 mats, été. " * 40_000, "a" + " " * 1_100_000 + "b", "x\n" * 9_000 + "\n" * 10_000, " " * 9_999 + "word"):
        assert encode(text) == own.encode(text, add_special_tokens=False).ids


def test_query(spark, make_docs, tables, odd_texts):
    from flickerlake.llm.registry import QUERIES

    rows = QUERIES["op3_packing"](spark, tables(documents=make_docs(odd_texts))).collect()
    rows = [SimpleNamespace(**r.asDict(), ids=None) for r in rows]
    assert check(rows, dict(enumerate(odd_texts)), packing.WINDOW) == 0
