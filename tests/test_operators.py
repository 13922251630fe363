"""Operators on worked examples and against sequential walks."""

import random

import pytest
from pyspark.sql import functions as F

from flickerlake.functions import events as E
from flickerlake.operators import codec, features, folds, frames, metrics
from flickerlake.operators import windows as W

SCHEMA = "x long, y long, d long, t long, seq long, v8 long, p long"


def events(spark, rows):
    return spark.createDataFrame([(x, y, d, t, k, v, k % 2) for k, (x, y, d, t, v) in enumerate(rows)], SCHEMA)


def test_migration_vector(spark):
    e = spark.createDataFrame([(0, 0, k, k, dt) for k, dt in enumerate([600, 600, 600, 123])], "x long, y long, t long, seq long, dt long")
    got = [r.a for r in e.select("seq", W.delta_to_absolute(e, 255).alias("a")).orderBy("seq").collect()]
    assert got == [600, 1365, 2130, 2418]


def test_frame_value_vector(spark):
    row = spark.range(1).select(E.frame_value(F.lit(5), F.lit(1000), 1000).alias("v"), E.magnitude(F.lit(127)).alias("m"), E.magnitude(F.lit(128)).alias("z"), E.magnitude(F.lit(0)).alias("o")).first()
    assert tuple(row) == (32.0, 2.0**127, 0.0, 1.0)


def test_plane_fills_six_frames(spark):
    e = events(spark, [(x, y, 5, 5100, 0) for x in range(5) for y in range(5)])
    rows = frames.reconstruct(e, 1000, 1000).collect()
    assert len(rows) == 6 * 25 and {r.frame for r in rows} == set(range(6))


def test_frames_against_a_walk(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(2), rng.choice([0, 3, 7, 128, 255]), rng.randrange(1, 5000), 0) for _ in range(300)]
    rows = [*dict.fromkeys(rows)]
    expected, by = {}, {}
    for k, (x, y, d, t, _) in enumerate(rows):
        by.setdefault((x, y), []).append((t, k, d))
    for (x, y), es in by.items():
        done, value, run = -1, 0, 0
        for t, _, d in sorted(es):
            if t <= run:
                continue
            if d != 255:
                new = min(255, int((2.0**d if d <= 127 else 0) / max(t - run, 1) * 100))
            f = (t - 1) // 250
            if f > done:
                if d != 255:
                    value = new
                for k in range(done + 1, f + 1):
                    expected[x, y, k] = value
                done = f
            run = -(-t // 100) * 100
    got = {(r.x, r.y, r.frame): r.v for r in frames.reconstruct(events(spark, rows), 100, 250).collect()}
    assert got == expected


def test_corners_against_a_walk(spark):
    rng = random.Random(2)
    w, h = 14, 12
    image = {(x, y): rng.choice([0, 10, 120, 200]) for x in range(w) for y in range(h)}
    for x, y in features.RING[:9]:
        image[6 + x, 6 + y] = 255
    image[6, 6] = 100

    def corner(x, y):
        ring = [image[x + a, y + b] for a, b in features.RING]
        for test in (lambda r: r < image[x, y] - 30, lambda r: r > image[x, y] + 30):
            marks = "".join("1" if test(r) else "0" for r in ring)
            if "1" * 9 in marks * 2:
                return True
        return False

    df = spark.createDataFrame([(0, x, y, v) for (x, y), v in image.items()], "frame long, x long, y long, v long")
    got = {(r.x, r.y) for r in features.fast_corners(df, F.lit(w), F.lit(h)).collect()}
    assert (6, 6) in got and got == {(x, y) for x in range(3, w - 3) for y in range(3, h - 3) if corner(x, y)}


def test_clusters_join_chains(spark):
    points = [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 1), (0, 9, 9), (1, 1, 1), (1, 1, 2), (1, 2, 1)]
    df = spark.createDataFrame(points, "frame long, x long, y long")
    got = {}
    for r in features.clusters(df, F.lit(1.0)).collect():
        got.setdefault((r.frame, r.cluster), set()).add((r.x, r.y))
    assert got == {(0, 65536 + 2): {(2, 1), (3, 1)}, (1, 65536 + 1): {(1, 1)}}


def test_ssim_of_equal_windows_is_one(spark):
    a = F.array(*(F.lit(float(k * 3 % 256)) for k in range(64)))
    assert spark.range(1).select(metrics.ssim(a, a).alias("s")).first().s == pytest.approx(1.0)


def test_residuals_decode(spark):
    rng = random.Random(3)
    rows = [*dict.fromkeys((rng.randrange(40), rng.randrange(40), rng.randrange(9), rng.randrange(1, 3000), 0) for _ in range(500))]
    coded = codec.intra(events(spark, rows), 1000).collect()
    blocks = {}
    for r in coded:
        blocks.setdefault((r.adu, r.by, r.bx), []).append(r)
    for (adu, *_), rs in blocks.items():
        d, t = 0, adu * 1000
        for r in sorted(rs, key=lambda r: (r.y, r.x)):
            d, t = d + r.d_residual, t + r.t_residual
            assert (d, t) == (r.d, r.t)


def test_fold_streams_pixels_one_by_one(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), 0, 0, t, rng.randrange(256)) for t in range(400)]
    expected, base = [], {}
    for k, (x, y, _, _, v) in enumerate(rows):
        if abs(v - base.get(x, 0)) > 50:
            base[x] = v
            expected.append((x, y, k, v))
    got = [tuple(r) for r in folds.send_on_delta(events(spark, rows), 50).collect()]
    assert sorted(got) == sorted(expected)


def test_operators_on_no_events(spark):
    e = events(spark, [(0, 0, 1, 1, 1)]).where("false")
    assert frames.reconstruct(e, 10, 10).collect() == [] and codec.inter(e, 10).collect() == []
    assert folds.send_on_delta(e, 1).collect() == [] and folds.contrast_events(e, 10).collect() == []


def test_frame_ssim_over_all_windows(spark):
    import random

    from flickerlake.operators import metrics

    rng = random.Random(71)
    a = {(x, y): rng.randrange(256) for x in range(13) for y in range(11)}
    b = {k: min(255, max(0, v + rng.randint(-40, 40))) for k, v in a.items()}
    del b[12, 0]
    frames = [spark.createDataFrame([(0, *k, v) for k, v in m.items()], "frame long, x long, y long, v long") for m in (a, b)]
    scores = []
    for x in range(6):
        for y in range(4):
            spots = [(x + i, y + j) for i in range(8) for j in range(8)]
            if any(s not in b for s in spots):
                continue
            ma, mb = (sum(m[s] for s in spots) / 64 for m in (a, b))
            va, vb, cov = (sum((p[s] - mp) * (q[s] - mq) for s in spots) for p, mp, q, mq in ((a, ma, a, ma), (b, mb, b, mb), (a, ma, b, mb)))
            scores.append((2 * ma * mb + metrics.C1) * (2 * cov + metrics.C2) / ((ma * ma + mb * mb + metrics.C1) * (va + vb + metrics.C2)))
    row = metrics.frame_ssim(*frames).first()
    assert row.windows == len(scores) and abs(row.ssim - 100 * sum(scores) / len(scores)) < 1e-6


def test_third_events_that_are_not_later_are_dropped(spark):
    from flickerlake.operators import codec

    rows = [(0, 0, 1, 5, 0), (0, 0, 2, 5, 1), (0, 0, 3, 5, 2), (0, 0, 4, 6, 3), (0, 0, 5, 6, 4), (0, 0, 6, 20, 5), (0, 0, 7, 20, 6)]
    df = spark.createDataFrame(rows, "x long, y long, d long, t long, seq long")
    assert sorted((r.adu, r.k, r.d) for r in codec.placed(df, 10).collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 4), (1, 0, 6), (1, 1, 7)]


def test_overlays_and_resets(spark):
    from pyspark.sql import functions as F

    from flickerlake.operators import features

    points = spark.createDataFrame([(0, 5, 5), (1, 0, 9)], "frame long, x long, y long")
    cross = {(r.frame, r.x, r.y) for r in features.crosses(points).collect()}
    assert cross == {(f, x + i * a, y + i * b) for f, x, y in ((0, 5, 5), (1, 0, 9)) for i in range(-2, 3) for a, b in ((0, 1), (1, 0))}
    boxes = spark.createDataFrame([(0, 1, 2, 4, 5), (1, 3, 3, 3, 3)], "frame long, x0 long, y0 long, x1 long, y1 long")
    sides = {(r.frame, r.x, r.y) for r in features.outlines(boxes).collect()}
    assert sides == {(0, x, y) for x in range(1, 5) for y in range(2, 6) if x in (1, 4) or y in (2, 5)} | {(1, 3, 3)}
    resets = {(r.frame, r.x, r.y, r.threshold) for r in features.threshold_resets(points, F.lit(2), F.lit(7), F.lit(10), 5).collect()}
    assert resets == {(f, x, y, 2) for f, px, py in ((0, 5, 5), (1, 0, 9)) for x in range(7) for y in range(10) if abs(x - px) <= 2 and abs(y - py) <= 2}
    assert features.threshold_resets(points, F.lit(0), F.lit(7), F.lit(10), 5).count() == 0


def test_intervals_bin_by_frame(spark):
    from pyspark.sql import functions as F

    from flickerlake.operators import windows

    events = spark.createDataFrame([(k, k % 20) for k in range(60)], "t long, x long")
    exposures = spark.createDataFrame([(0, 5, 12), (2, 40, 59)], "frame long, opens long, closes long")
    got = {(r.t, r.side) for r in windows.outside_exposures(events, exposures, F.floor(F.col("t") / 20)).collect()}
    assert got == {(t, "before") for t in range(5)} | {(t, "after") for t in range(13, 20)}
