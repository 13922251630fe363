import struct

import pytest

from flickerlake.sources import streams as S


@pytest.mark.parametrize(("version", "size"), [(0, 25), (1, 29), (2, 33), (3, 37)])
def test_header_sizes_and_round_trip(version, size):
    h = S.Header(version=version, width=50, height=100, tps=1000, camera="Dvs", adu_interval=7)
    data = h.pack()
    assert len(data) == h.size == size
    back = S.Header.parse(data + b"\0" * 12)
    assert (back.width, back.height, back.tps, back.version) == (50, 100, 1000, version)
    if version >= 3:
        assert back == h
    assert len(data + S.end_record()) == size + 11


def test_bad_headers_and_seeks():
    with pytest.raises(ValueError):
        S.Header.parse(b"nonsense" + b"\0" * 40)
    h = S.Header()
    assert S.record_at(h.size + 18, h) == 2
    with pytest.raises(ValueError):
        S.record_at(h.size + 4, h)


@pytest.mark.parametrize("channels", [1, 3])
def test_write_and_read_in_ranges(spark, tmp_path, channels):
    S.register(spark)
    rows = [(k % 50, k % 30, k % 3 if channels > 1 else None, k % 256, k * 100_000) for k in range(1000)]
    df = spark.createDataFrame(rows, "x int, y int, c int, d int, t long")
    options = {"width": "50", "height": "30", "channels": str(channels)}
    df.coalesce(1).write.format("pixel_events").mode("append").options(path=str(tmp_path / "s"), **options).save()
    read = spark.read.format("pixel_events").option("range_records", "130").load(str(tmp_path / "s"))
    assert read.rdd.getNumPartitions() == 8
    got = sorted((r.x, r.y, r.c, r.d, r.t) for r in read.collect()) if channels > 1 else [(r.x, r.y, r.c, r.d, r.t) for r in read.orderBy("seq").collect()]
    assert got == (sorted(rows) if channels > 1 else rows)


def test_empty_stream(spark, tmp_path):
    S.register(spark)
    (tmp_path / "e.events").write_bytes(S.Header().pack() + S.end_record())
    assert spark.read.format("pixel_events").load(str(tmp_path / "e.events")).collect() == []


def test_polarity_file(spark, tmp_path):
    S.register(spark)
    events = [(5, 3, 7, 1), (9, 1023, 200, 0)]
    body = b"".join(struct.pack("<II", t, p << 28 | y << 14 | x) for t, x, y, p in events)
    (tmp_path / "a.dat").write_bytes(b"% Height 300\n% Width 1024\n\x00\x08" + body)
    rows = spark.read.format("polarity_events").load(str(tmp_path / "a.dat")).collect()
    assert [tuple(r) for r in rows] == events


def test_json_events(spark, tmp_path):
    from flickerlake.sources.tables import json_events

    (tmp_path / "e.json").write_text('[{"coord": {"x": 0, "y": 186, "c": null}, "d": 254, "delta_t": 255}, {"coord": {"x": 0, "y": 186, "c": 1}, "d": 7, "delta_t": 300}]')
    rows = json_events(spark, str(tmp_path / "e.json")).orderBy("seq").collect()
    assert [(r.x, r.y, r.c, r.d, r.delta_t) for r in rows] == [(0, 186, None, 128, 255), (0, 186, 1, 7, 300)]


def test_log_names(spark):
    from flickerlake.sources.tables import log_names

    df = spark.createDataFrame([("park_run_3_05_11_2023_10_20_30.log",), ("other.txt",)], "name string")
    (r,) = log_names(df).collect()
    assert (r.video, r.crf, str(r["at"])) == ("park_run", 3, "2023-11-05 10:20:30")


def test_append_keeps_and_overwrite_replaces(spark, tmp_path):
    S.register(spark)
    path = tmp_path / "twice"

    def write(first, mode):
        df = spark.createDataFrame([(k, 0, None, 1, k) for k in range(first, first + 10)], "x int, y int, c int, d int, t long")
        df.repartition(2).write.format("pixel_events").mode(mode).options(path=str(path), width="99", height="1").save()

    read = lambda: sorted(r.x for r in spark.read.format("pixel_events").load(str(path)).collect())
    write(0, "append")
    write(20, "append")
    assert read() == [*range(10), *range(20, 30)]
    write(50, "overwrite")
    assert read() == [*range(50, 60)]
    names = [p.name for p in path.iterdir() if not p.name.startswith(".")]
    assert len([n for n in names if n.endswith(".events")]) == 2 and len([n for n in names if n.endswith(".json")]) == 1


@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize("ended", [True, False])
@pytest.mark.parametrize("n", [0, 1, 3])
def test_streams_with_and_without_end_record(spark, tmp_path, channels, ended, n):
    import numpy as np

    S.register(spark)
    k = np.arange(n)
    body = S.encode(k, k, k * 0, k + 1, k * 10, channels)
    (tmp_path / "s.events").write_bytes(S.Header(channels=channels, width=9, height=9).pack() + body + (S.end_record() if ended else b""))
    rows = spark.read.format("pixel_events").load(str(tmp_path / "s.events")).orderBy("seq").collect()
    assert [(r.x, r.d, r.t) for r in rows] == [(i, i + 1, i * 10) for i in range(n)]


def test_reading_from_a_byte(spark, tmp_path):
    import numpy as np

    S.register(spark)
    k, h = np.arange(10), S.Header(width=20, height=20)
    (tmp_path / "s.events").write_bytes(h.pack() + S.encode(k, k, k, k, k, 1) + S.end_record())
    reader = spark.read.format("pixel_events").option("start_byte", h.size + 4 * h.event_size)
    assert sorted(r.seq for r in reader.load(str(tmp_path / "s.events")).collect()) == [4, 5, 6, 7, 8, 9]
    with pytest.raises(Exception, match="no record begins"):
        spark.read.format("pixel_events").option("start_byte", h.size + 1).load(str(tmp_path / "s.events")).collect()


def test_polarity_files_are_written_in_order_of_time(spark, tmp_path):
    rows = [(k * 37 % 500, k % 640, k % 480, k % 2) for k in range(500)]
    df = spark.createDataFrame(rows, "t long, x long, y long, p long").repartition(3)
    S.save_polarity(df, str(tmp_path / "d"), 640, 480)
    read = spark.read.format("polarity_events").load(str(tmp_path / "d"))
    got = [tuple(r) for r in read.collect()]
    assert [r[0] for r in got] == sorted(r[0] for r in rows) and sorted(got) == sorted(rows)
    head = min((tmp_path / "d").glob("*.dat")).read_bytes().split(b"\n")
    assert head[0] == b"% Height 480" and head[2] == b"% Width 640" and head[3][:2] == b"\x00\x08"
    S.save_polarity(df.limit(4), str(tmp_path / "d"), 640, 480, "overwrite")
    assert spark.read.format("polarity_events").load(str(tmp_path / "d")).count() == 4


def test_log_names(spark):
    from flickerlake.sources.tables import log_names

    names = ["3_raw_features_VIRAT_S_01_02_11_2023_13_14_15.log", "0_compressed_nofeatures_a_01_01_2023_00_00_09.log", "other.log", "x_raw_features_v_01_01_2023_00_00_09.log"]
    rows = log_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert [(r.video, r.crf, r.compressed, r.features, str(r.at)) for r in rows] == [("VIRAT_S_01", 3, False, True, "2023-11-02 13:14:15"), ("a", 0, True, False, "2023-01-01 00:00:09")]


def log_bytes():
    import pickle

    put = lambda v: pickle.dumps(v, 3)
    out = b"10x8x1\n" + b"META: Ticks per second: 7650\nMETA: ticks per source interval: 255\nMETA: t_max: 510\n"
    for k in range(3):
        out += put(5 + k) + put(f"\nOwn FAST: {100 + k}") + put(f"\nOpenCV FAST: {50 + k}") + put(7 + k)
        out += put("Feature results:") + put(0.5) + put(0.25) + put(0.75)
        out += put({"psnr": 70.0 + k, "mse": 1.5, "ssim": None}) + put(f"\nbps: {1048576.0 * (k + 1)}")
    out += put(99) + put("RECONSTRUCTION") + b"".join(put({"psnr": 30.0 + k, "mse": 2.0, "ssim": 90.0}) for k in range(3))
    return out + put("Compressed adu sizes") + put(1048576) + put(2097152)


def test_run_logs(spark, tmp_path):
    from flickerlake.sources.logs import parse, run_logs

    (tmp_path / "a.log").write_bytes(log_bytes())
    (tmp_path / "b.txt").write_bytes(b"no log")
    rows = run_logs(spark, str(tmp_path)).orderBy("interval").collect()
    assert [(r.interval, r.own_features, r.peer_features, r.own_time, r.peer_time, r.event_bitrate) for r in rows] == [(k, 5 + k, 7 + k, 100 + k, 50 + k, k + 1.0) for k in range(3)]
    assert [(r.psnr, r.recon_psnr, r.recon_ssim, r.precision, r.accuracy, r.width, r.tps) for r in rows] == [(60.0, 30.0 + k, 90.0, 0.5, 0.75, 10, 7650) for k in range(3)]
    assert [r.compressed_bitrate for r in rows] == [8.0, 8.0, 16.0]
    with pytest.raises(Exception, match="plain values"):
        import os
        import pickle

        parse(b"1x1x1\n" + pickle.dumps(os.getcwd, 3))
