import hashlib
import os
import zlib

import pytest

from flickerlake.llm import media


def pad(text):
    b = (text or "").encode()
    return b + b"\0" * (-len(b) % 64 if b else 64)


def test_round_trip(spark, make_docs, odd_texts):
    ids = [*range(len(odd_texts) - 1), None]
    rows = {r.doc_id: r for r in media.round_trip(make_docs(odd_texts, ids=ids, extra="key content media").repartition(3)).collect()}
    assert set(rows) == set(ids)
    for k, text in zip(ids, odd_texts):
        r, p = rows[k], pad(text)
        wav = media.to_wav((text or "").encode())
        assert (r.n_bytes, r.payload_bytes) == (len((text or "").encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
        assert r.media_bytes == len(wav) and r.media_sha256 == hashlib.sha256(wav).hexdigest()
        assert r.feature == media.feature(p)


def test_wav_is_lossless_and_standard(tmp_path):
    import wave

    content = bytes(range(256)) * 3 + b"x"
    path = tmp_path / "x.wav"
    path.write_bytes(media.to_wav(content))
    with wave.open(str(path)) as w:
        assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
        assert w.readframes(w.getnframes()) == content + b"\0" * (-len(content) % 64)
    assert media.from_wav(path.read_bytes()) == (content + b"\0" * (-len(content) % 64), len(content))


@pytest.mark.parametrize("range_bytes", [1, 500, 1 << 30])
def test_every_member_in_one_range(spark, make_docs, tmp_path, range_bytes):
    docs = make_docs([f"text {k} " * k for k in range(60)]).repartition(2)
    media.store_texts(docs, f"file://{tmp_path}/a", archive_bytes="2000")
    assert len([f for f in os.listdir(tmp_path / "a") if f.endswith(".zip")]) > 2
    rows = media.load(spark, f"file://{tmp_path}/a", range_bytes=str(max(range_bytes, 100))).collect()
    assert sorted(int(r.key) for r in rows) == list(range(60))
    assert all(media.from_wav(r.media)[0] == pad(f"text {r.key} " * int(r.key)) for r in rows)


def test_members_fail_alone(spark, make_docs, tmp_path):
    media.store_texts(make_docs([f"text number {k}" for k in range(20)]).coalesce(1), str(tmp_path / "a"))
    name = next(f for f in os.listdir(tmp_path / "a") if f.endswith(".zip"))
    good = media.load(spark, str(tmp_path / "a")).collect()
    hurt = sorted(r.offset for r in good)[7]
    with open(tmp_path / "a" / name, "r+b") as f:
        f.seek(hurt + 60)
        f.write(b"\xff\xff\xff")
    rows = media.load(spark, str(tmp_path / "a"), on_error="report", attempts="2").collect()
    assert [r.offset for r in rows if r.error] == [hurt] and len(rows) == 20
    with pytest.raises(Exception, match="damaged|zlib|Error"):
        media.load(spark, str(tmp_path / "a"), attempts="1").collect()


def test_a_passing_failure_is_retried(monkeypatch, tmp_path, spark, make_docs):
    media.store_texts(make_docs(["one", "two", "three"]).coalesce(1), str(tmp_path / "a"))
    reader = media.ArchiveReader({"path": str(tmp_path / "a")})
    failures, real = [1, 1], zlib.decompress

    def flaky(*a):
        if failures:
            failures.pop()
            raise zlib.error("passing")
        return real(*a)

    monkeypatch.setattr(media.zlib, "decompress", flaky)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 3 and not any(r["error"] for r in rows)


def test_uncommitted_archives_are_invisible(spark, make_docs, tmp_path):
    media.store_texts(make_docs(["a", "b"]), str(tmp_path / "a"))
    (tmp_path / "a" / "left-by-a-lost-task.zip").write_bytes(b"half")
    assert media.load(spark, str(tmp_path / "a")).count() == 2
    assert media.round_trip(make_docs(["x"]).where("false")).collect() == []


def test_errors_are_described(spark, make_docs, tmp_path):
    media.store_texts(make_docs(["one", "two"]).coalesce(1), str(tmp_path / "a"))
    name = next(f for f in os.listdir(tmp_path / "a") if f.endswith(".zip"))
    hurt = max(r.offset for r in media.load(spark, str(tmp_path / "a")).collect())
    with open(tmp_path / "a" / name, "r+b") as f:
        f.seek(hurt + 60)
        f.write(b"\xff\xff\xff")
    rows = media.describe(media.load(spark, str(tmp_path / "a"), on_error="report", attempts="1")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.error is None) for r in rows if r.error is None) == [(0, 3, True)]
    assert [(r.doc_id, r.n_bytes, r.feature) for r in rows if r.error] == [(1, None, None)]


def slow_feature(payload):
    """The feature by plain loops."""
    x = [b - 128 for b in payload]
    env = []
    for k in range(16):
        part = x[k * len(x) // 16 : (k + 1) * len(x) // 16]
        env.append(sum(part) // len(part) + 128)
    cross = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
    return f"env={bytes(env).hex()};dev={sum(map(abs, x)) // len(x)};cross={cross}"


def test_query_against_brute_force(spark, make_docs, tables, odd_texts):
    from flickerlake.llm.registry import QUERIES

    texts = [*odd_texts, "ÿþé" * 100, "\x00" * 64, "a" * 63, "a" * 65]
    rows = {r.doc_id: r for r in QUERIES["op2_media"](spark, tables(documents=make_docs(texts))).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        r, p = rows[k], pad(text)
        assert (r.payload_bytes, r.payload_sha256, r.feature) == (len(p), hashlib.sha256(p).hexdigest(), slow_feature(p))


def test_overwrite_leaves_no_orphan(spark, make_docs, tmp_path):
    path = f"file://{tmp_path}/over"
    media.store_texts(make_docs(["a", "b"], ids=[1, 2]), path)
    media.store_texts(make_docs(["c"], ids=[3]), path)
    media.store_texts(make_docs(["d", "e"], ids=[4, 5]).coalesce(1), path, mode="overwrite")
    assert sorted(r.key for r in media.load(spark, path).collect()) == ["4", "5"]
    assert sorted(f.rsplit(".", 1)[1] for f in os.listdir(tmp_path / "over") if not f.startswith(".")) == ["json", "zip"]


def test_a_second_write_keeps_the_first(spark, make_docs, tmp_path):
    path = f"file://{tmp_path}/twice"
    media.store_texts(make_docs(["a", "b"], ids=[1, 2]), path)
    media.store_texts(make_docs(["c"], ids=[3]), path)
    assert sorted(r.key for r in media.load(spark, path).collect()) == ["1", "2", "3"]
