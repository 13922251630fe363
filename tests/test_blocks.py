import random

import pytest

from flickerlake.operators import blocks as B
from flickerlake.operators.codec import placed
from flickerlake.operators.entropy import Context, Decoder, Encoder
from flickerlake.sources.streams import Header


@pytest.mark.parametrize("n", [1, 2, 5, 256, 513])
def test_coder_round_trip(n):
    rng = random.Random(n)
    symbols = [min(n - 1, int(rng.expovariate(0.2))) for _ in range(3000)]
    out, context = Encoder(), Context(n)
    for s in symbols:
        out.put(context, s)
    source, context = Decoder(out.done()), Context(n)
    assert [source.take(context) for _ in symbols] == symbols


def test_skewed_symbols_cost_less_than_a_byte():
    out, context = Encoder(), Context(256)
    for k in range(5000):
        out.put(context, 200 if k % 50 else k % 256)
    assert len(out.done()) < 1500


def test_counts_are_halved(monkeypatch):
    monkeypatch.setattr("flickerlake.operators.entropy.MOST", 64)
    symbols = [k * k % 7 for k in range(500)]
    out, context = Encoder(), Context(7)
    for s in symbols:
        out.put(context, s)
    source, context = Decoder(out.done()), Context(7)
    assert [source.take(context) for _ in symbols] == symbols


@pytest.mark.parametrize("n", [0, 1, 40, 900])
def test_units_round_trip(n):
    rng = random.Random(n)
    header = Header(version=3, width=35, height=20, channels=2, ref_interval=100, adu_interval=30)
    events = {}
    for _ in range(n):
        spot = rng.randrange(2), rng.randrange(20), rng.randrange(35)
        events.setdefault(spot, []).append((rng.choice([*range(12), 128, 255]), 6000 + rng.randrange(1, 3001)))
    events = {s: sorted(es, key=lambda e: e[1]) for s, es in events.items()}
    assert B.decode_unit(B.encode_unit(events, 6000, 3000, header), 6000, 3000, header) == events


def test_stream_round_trip_is_smaller(spark, tmp_path):
    rng = random.Random(3)
    rows, seq = [], 0
    for x in range(12):
        for y in range(9):
            t = rng.randrange(1, 50)
            while t < 4000:
                rows.append((x, y, rng.choice([5, 6, 6, 6]), t, seq))
                seq += 1
                t += rng.randrange(40, 60)
    df = spark.createDataFrame(rows, "x long, y long, d long, t long, seq long").selectExpr("*", "cast(null as int) as c")
    header = Header(version=3, width=12, height=9, ref_interval=100, adu_interval=10)
    B.save(df, header, str(tmp_path / "s"))
    back = B.load(spark, str(tmp_path / "s"))
    assert sorted((r.x, r.y, r.d, r.t) for r in back.collect()) == sorted(r[:4] for r in rows)
    size = sum(f.stat().st_size for f in (tmp_path / "s").glob("*.units"))
    assert size < len(rows) * header.event_size
    units = B.compress(df, header)
    assert B.decompress(units, header).count() == len(rows)


def test_units_append_and_overwrite(spark, tmp_path):
    header = Header(version=3, width=4, height=4, ref_interval=10, adu_interval=1)

    def save(t, mode):
        df = spark.createDataFrame([(1, 1, 5, t, 0), (2, 1, 6, t, 1)], "x long, y long, d long, t long, seq long").selectExpr("*", "cast(null as int) as c")
        B.save(df, header, str(tmp_path / "u"), mode)

    save(5, "append")
    save(15, "append")
    assert sorted(r.t for r in B.load(spark, str(tmp_path / "u")).collect()) == [5, 5, 15, 15]
    save(25, "overwrite")
    assert sorted(r.t for r in B.load(spark, str(tmp_path / "u")).collect()) == [25, 25]
    assert len([*(tmp_path / "u").glob("*.json")]) == 1


def test_streams_are_opened_by_their_first_bytes(spark, tmp_path):
    from flickerlake.sources import streams as S

    S.register(spark)
    header = Header(version=3, width=4, height=4, ref_interval=10, adu_interval=1)
    df = spark.createDataFrame([(1, 1, 5, 5, 0), (2, 1, 6, 15, 1)], "x long, y long, d long, t long, seq long").selectExpr("*", "cast(null as int) as c")
    B.save(df, header, str(tmp_path / "u"))
    df.selectExpr("cast(x as int) x", "cast(y as int) y", "c", "cast(d as int) d", "t").write.format("pixel_events").mode("append").options(path=str(tmp_path / "r"), width="4", height="4").save()
    expected = [(1, 1, 5, 5), (2, 1, 6, 15)]
    units, raw = [*(tmp_path / "u").glob("*.units")], [*(tmp_path / "r").glob("*.events")]
    for path in (tmp_path / "u", tmp_path / "r"):
        assert sorted((r.x, r.y, r.d, r.t) for r in B.open_events(spark, str(path)).collect()) == expected
    for files in (units, raw):
        assert sorted((r.x, r.y, r.d, r.t) for f in files for r in B.open_events(spark, str(f)).collect()) == expected
    (tmp_path / "x").write_bytes(b"something else")
    with pytest.raises(ValueError, match="no event stream"):
        B.open_events(spark, str(tmp_path / "x"))


def test_message_models():
    from flickerlake.operators.entropy import FixedLength, MaxLength, OneShot

    rng = random.Random(5)
    for n in (0, 1, 5, 8):
        message = [rng.randrange(6) for _ in range(n)]
        assert MaxLength(6, 8).decode(MaxLength(6, 8).encode(message)) == message
        assert FixedLength(6, n).decode(FixedLength(6, n).encode(message)) == message
    assert OneShot(300).decode(OneShot(300).encode([257])) == [257]
    for wrong in (lambda: FixedLength(3, 2).encode([1]), lambda: MaxLength(3, 2).encode([1, 1, 1]), lambda: OneShot(3).encode([])):
        with pytest.raises(ValueError):
            wrong()


def test_symbols_are_those_that_a_unit_is_coded_in(spark, monkeypatch):
    from pyspark.sql import functions as F

    from flickerlake.operators import codec

    rng = random.Random(6)
    rows = [(rng.randrange(20), rng.randrange(9), rng.choice([3, 5, 128, 255]), rng.randrange(1, 3000)) for _ in range(400)]
    rows = [(x, y, d, t, k) for k, (x, y, d, t) in enumerate(sorted(rows, key=lambda r: r[3]))]
    df = spark.createDataFrame(rows, "x long, y long, d long, t long, seq long")
    got = {}
    for r in codec.symbols(df, 1000, F.lit(20), F.lit(9)).collect():
        got[r.adu, r.kind, r.symbol] = r.n
    seen = {}

    class Spy:
        def put(self, context, symbol):
            kind = "d" if context is self.model.d else "t" if context is self.model.t else "shift"
            key = self.adu, kind, symbol - B.OFFSET if kind == "d" else symbol
            seen[key] = seen.get(key, 0) + 1

        def done(self):
            return b""

    header = Header(version=3, width=20, height=9, ref_interval=1000, adu_interval=1)
    for adu in range(3):
        own = {}
        for r in codec.placed(df, 1000).where(f"adu = {adu}").orderBy("t", "seq").collect():
            own.setdefault((0, r.y, r.x), []).append((r.d, r.t))
        spy = Spy()
        spy.adu = adu
        monkeypatch.setattr(B, "Encoder", lambda spy=spy: spy)
        monkeypatch.setattr(B, "Model", lambda spy=spy: spy.__dict__.setdefault("model", B_MODEL()))
        B.encode_unit(own, adu * 1000, 1000, header)
    assert got == seen


B_MODEL = B.Model


def test_likely_symbols_are_cheap_from_the_start():
    def cost(context, symbols):
        out = Encoder()
        for s in symbols:
            out.put(context, s)
        return len(out.done())

    small = [B.OFFSET + k % 5 for k in range(40)]
    assert cost(B.Model().d, small) < cost(Context(513), small)
    # 21 + 20 + 21 symbols of 10, 21 of 20, the marks of 20 and 10, and 1 for each other
    assert B.Model().d.total == 62 * 10 + 21 * 20 + 20 + 10 + (513 - 62 - 21 - 2)


@pytest.mark.parametrize("cuts", [[], [700], [100, 101, 512, 513, 2000]])
def test_parts_of_a_unit_round_trip(cuts):
    rng = random.Random(len(cuts))
    header = Header(version=3, width=35, height=20, channels=2, ref_interval=100, adu_interval=30)
    spots = [s for block in B._spots(header) for s in block]
    assert len(spots) == len({*spots}) == 35 * 20 * 2
    places = [p for p in range(6 * 512) if B._spot(p, header)[1] < 20 and B._spot(p, header)[2] < 35]
    assert [B._spot(p, header) for p in places] == spots
    events = {p: [(rng.choice([3, 5, 128, 255]), 6000 + t) for t in sorted(rng.sample(range(1, 3001), rng.randrange(1, 4)))] for p in rng.sample(places, 200)}
    got = {}
    for begin, end in zip([0, *cuts], [*cuts, 6 * 512]):
        own = sorted(p for p in events if begin <= p < end)
        part = {B._spot(p, header): events[p] for p in own}
        back = B.decode_unit(B.encode_unit(part, 6000, 3000, header, own[0], own[-1]), 6000, 3000, header, own[0], own[-1]) if own else {}
        assert back == part and not got.keys() & back.keys()
        got |= back
    assert got == {B._spot(p, header): es for p, es in events.items()}


def test_no_part_holds_more_than_its_share_of_a_full_unit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "PART_EVENTS", 50)
    rng = random.Random(8)
    header = Header(version=3, width=20, height=18, channels=2, ref_interval=100, adu_interval=20)
    # two units; one pixel alone has more events than a part
    rows = [(rng.randrange(20), rng.randrange(18), rng.randrange(2), rng.choice([3, 5, 128, 255]), rng.randrange(1, 4001)) for _ in range(500)]
    rows += [(17, 3, 1, rng.choice([3, 5, 6]), 2000 + 9 * k) for k in range(1, 200)]
    rows = [(*r, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "x long, y long, c long, d long, t long, seq long")
    units = B.compress(df, header)
    counts = [(r.adu, r.n) for r in units.select("adu", "n").collect()]
    assert {adu for adu, _ in counts} == {0, 1} and max(n for _, n in counts) <= 50 and len(counts) >= sum(n for _, n in counts) / 50
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning" not in plan
    expected = sorted((r.x, r.y, r.c, r.d, r.t) for r in placed(df, 2000, ("x", "y", "c")).collect())
    assert sorted((r.x, r.y, r.c, r.d, r.t) for r in B.decompress(units, header).collect()) == expected
    B.save(df, header, str(tmp_path / "p"))
    assert sorted((r.x, r.y, r.c, r.d, r.t) for r in B.load(spark, str(tmp_path / "p")).collect()) == expected


def test_stretches_cover_a_stream(tmp_path, monkeypatch):
    monkeypatch.setattr(B, "STRETCH_BYTES", 300)
    header = Header(version=3, width=16, height=16, ref_interval=100, adu_interval=10)
    units = [(adu, {(0, y, 1): [(5, 1000 * adu + 3 + y)] for y in range(10)}) for adu in range(20)]
    batch = [B.pa.record_batch({"adu": [adu], "first": [1], "last": [9 * 16 + 1], "payload": [B.encode_unit(es, 1000 * adu, 1000, header, 1, 9 * 16 + 1)]}) for adu, es in units]
    path = str(tmp_path / "s")
    writer = B.UnitWriter({"path": path, "header": B.json.dumps(B.asdict(header))}, False)
    writer.commit([writer.write(iter(batch))])
    expected = [(adu, 1, y, t) for adu, es in units for (_, y, _), [(_, t)] in es.items()]
    for opened in (path, str(next((tmp_path / "s").glob("*.units")))):
        reader = B.UnitReader({"path": opened})
        stretches = reader.partitions()
        assert 1 < len(stretches) < len(units)
        assert [(r["adu"], r["x"], r["y"], r["t"]) for s in stretches for b in reader.read(s) for r in b.to_pylist()] == expected


def test_streams_of_whole_units_are_still_read(spark, tmp_path):
    header = Header(version=3, width=20, height=20, ref_interval=100, adu_interval=10)
    units = [(adu, {(0, 3, 2): [(5, 1000 * adu + 7), (6, 1000 * adu + 9)], (0, 18, 17): [(4, 1000 * adu + 8)]}) for adu in range(3)]
    data = B.COMPRESSED_MAGIC + header.pack()[5:]
    for adu, events in units:
        payload = B.encode_unit(events, 1000 * adu, 1000, header)
        data += B.UNIT_HEAD.pack(adu, len(payload)) + payload
    (tmp_path / "old.units").write_bytes(data)
    got = sorted((r.adu, r.x, r.y, r.d, r.t) for r in B.load(spark, str(tmp_path / "old.units")).collect())
    assert got == sorted((adu, x, y, d, t) for adu, events in units for (_, y, x), es in events.items() for d, t in es)


def test_an_encoder_packs_its_bits_as_it_goes():
    from flickerlake.operators.entropy import LOOSE

    rng = random.Random(9)
    symbols = [rng.randrange(256) for _ in range(5000)]
    out, context, most = Encoder(), Context(256), 0
    for s in symbols:
        out.put(context, s)
        most = max(most, len(out.bits))
    assert most <= LOOSE
    source, context = Decoder(out.done()), Context(256)
    assert [source.take(context) for _ in symbols] == symbols
