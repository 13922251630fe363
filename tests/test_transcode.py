"""Worked examples of the pixel tree, in double precision."""

import pytest

from flickerlake.operators.transcode import Node, Options, Pixel, exponent


def state(p):
    return [(n.d, round(n.light, 4), round(n.ticks, 4)) for n in p.nodes]


def tree(**options):
    return Pixel(Options(ref=options.pop("ref", 20), dtm=options.pop("dtm", 10_000), **options))


def test_two_equal_intervals_make_three_nodes():
    p = tree(absolute=False)
    p.integrate(100, 20)
    p.integrate(100, 20)
    assert state(p) == [(8, 200.0, 40.0), (7, 72.0, 14.4), (6, 8.0, 1.6)]
    assert p.pop_best(0) == [(7, 25), (6, 12)]


def test_root_climbs_and_pops_one_event():
    p = tree(absolute=False)
    for light, ticks in ((100, 20), (100, 20), (30, 34), (26, 34)):
        p.integrate(light, ticks)
    assert state(p)[0] == (9, 256.0, 108.0)
    assert p.pop_best(0) == [(8, 108)]


def test_longest_interval_forces_a_pop_once_a_run():
    p = Pixel(Options(ref=1000, dtm=2000, continuous=False, absolute=False))
    p.integrate(245, 1000)
    p.integrate(245, 1000)
    assert p.due
    p.pop_top(245)
    for _ in range(48):
        p.integrate(245, 1000)
    assert not p.due and p.nodes[0].ticks == 48_000


def test_absolute_times():
    p = tree()
    for light, ticks in ((101, 20), (40, 30), (140, 30), (103, 30)):
        p.integrate(light, ticks)
    assert p.pop_best(0) == [(8, 74), (7, 110)]


def test_weaker_light_ends_with_an_empty_event():
    p = tree()
    for light, ticks in ((101, 20), (40, 30), (140, 30), (107, 30)):
        p.integrate(light, ticks)
    p.pop_best(0)
    assert p.aim(10.0) == [(255, 110)]


@pytest.mark.parametrize(("light", "d"), [(0, 128), (0.9, 128), (1, 0), (2, 1), (255, 7), (256, 8), (2.0**127, 127)])
def test_exponent(light, d):
    assert exponent(light) == d


def test_zero_light_pops_a_zero_event():
    p = Pixel(Options(absolute=False), nodes=[Node(128, 0.0, 50.0)])
    assert p.pop_top(0) == [(128, 50)]


def test_constant_pixel_needs_few_events():
    p = Pixel(Options(baseline=2, most=7, velocity=7), threshold=2)
    events = [e for _ in range(200) for e in p.step(100, 100.0, 255.0)]
    assert len(events) < 10
    assert p.step(200, 200.0, 255.0)


def rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.x, r.y, r.n)):
        out.setdefault((r.x, r.y), []).append((r.d, r.t))
    return out


def test_polarity_events_move_the_value(spark):
    from flickerlake.operators import transcode as X

    up = [(0, 0, t, k, 1, 0) for k, t in enumerate(range(10, 400, 10))]
    down = [(1, 0, t, k, 0, 0) for k, t in enumerate(range(10, 400, 10))]
    df = spark.createDataFrame(up + down, "x long, y long, t long, seq long, p long, v8 long")
    got = rows(X.transcode_polarity(df, X.Options(baseline=2, most=7, velocity=7)))
    assert set(got) == {(0, 0), (1, 0)}
    for events in got.values():
        times = [t for _, t in events]
        assert times == sorted(times) and times[-1] <= 400 * 255
    # light gathered in a tick grows with ON events and shrinks with OFF events
    rate = lambda events: sum(2.0**d for d, _ in events if d <= 127) / events[-1][1]
    assert rate(got[0, 0]) > rate(got[1, 0])


def test_sensor_rows_before_a_frame_are_ignored_and_time_ascends(spark):
    from flickerlake.operators import transcode as X

    data = [(0, 0, 5, 0, 1, 0, False)]
    data += [(0, 0, 1000 * k, 10 * k, 0, 40 * k % 256, True) for k in range(1, 9)]
    data += [(0, 0, 1000 * k + 300 + 50 * j, 10 * k + j, j % 2, 0, False) for k in range(1, 9) for j in range(1, 6)]
    df = spark.createDataFrame(data, "x long, y long, t long, seq long, p long, v8 long, frame boolean")
    got = rows(X.transcode_sensor(df, X.Options(baseline=2, most=7, velocity=7)))[0, 0]
    times = [t for _, t in got]
    assert len(got) > 8 and times == sorted(times) and times[-1] <= 9000
    assert rows(X.transcode_sensor(df.where("not frame"), X.Options())) == {}
