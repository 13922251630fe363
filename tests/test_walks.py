"""The transcoding queries against walks over plain lists, written apart from the operators."""

import math
from collections import defaultdict

import pytest

from flickerlake.operators import transcode as X
from flickerlake.plans.catalogue import QUERIES
from flickerlake.sources import tables as T

SF = "/root/testdata/sf0.001"
REF, DTM = 255, 7650


def expo(light):
    return 128 if light < 1 else min(int(light).bit_length() - 1, 127)


def full(d):
    return 2.0**d if d < 128 else 0.0


class Walk:
    """A pixel as nested lists [d, light, ticks, best]; events pile up in ``out``."""

    def __init__(self, baseline, most, velocity):
        self.baseline, self.most, self.velocity = baseline, most, velocity
        self.chain, self.out = [], []
        self.time = self.all_ticks = 0.0
        self.center, self.limit, self.calm = 0, baseline, 1
        self.waiting = self.forced = False

    def fire(self, d, ticks):
        self.time += ticks
        self.out.append((d, int(self.time)))

    def force(self, coming):
        self.waiting, self.forced = False, True
        d, light, ticks, best = self.chain[0]
        if best is not None:
            self.fire(*best)
            self.chain = self.chain[1:] or [[expo(coming), 0.0, 0.0, None]]
        elif light > 0:
            self.fire(expo(light), ticks)
            self.chain = [[expo(coming), 0.0, 0.0, None]]
        else:
            if ticks > 0:
                self.fire(128, ticks)
            self.chain[0][2] = 0.0

    def flush(self, coming):
        told = [n[3] if n[3] is not None else (128, n[2]) for n in self.chain if n[3] is not None or (n[1] == 0 and n[2] > 0)]
        if self.forced and told:
            self.fire(*told[0])
            self.out.append((255, int(self.all_ticks)))
            self.time = self.all_ticks
            self.chain = [[expo(coming), 0.0, 0.0, None]]
        else:
            for event in told:
                self.fire(*event)
            last = self.chain[-1]
            last[3] = None
            if told and last[1] == 0:
                last[2] = 0.0
            self.chain = [last]
        self.waiting = self.forced = False

    def retarget(self, coming):
        head = self.chain[0]
        if expo(coming) < head[0] and head[2] > 0:
            self.fire(255, head[2])
            head[1] = head[2] = 0.0
        head[0] = expo(coming)

    def pour(self, light, ticks):
        whole = ticks
        if not self.chain:
            self.chain = [[expo(light), 0.0, 0.0, None]]
        if self.chain[-1][1:3] == [0.0, 0.0]:
            self.chain[-1][0] = expo(light)
        self.all_ticks += ticks
        at = 0
        while at < len(self.chain):
            node = self.chain[at]
            total = node[1] + light
            if total >= full(node[0]):
                d = expo(total)
                part = 1.0 if 128 in (d, node[0]) or light < 2.0**-23 else (full(d) - node[1]) / light
                node[3] = (d, node[2] + ticks * part)
                if d < 127:
                    node[1], node[2] = total, node[2] + ticks
                    node[0] = max(d + 1, int(total).bit_length())
                self.chain = [*self.chain[: at + 1], [expo(light), 0.0, 0.0, None]]
                light, ticks = light - light * part, ticks - ticks * part
                if light == 0:
                    break
                if ticks > REF:
                    self.chain[at + 1][0] = expo(light)
            else:
                node[1], node[2] = total, node[2] + ticks
            if self.forced:
                break
            at += 1
        self.waiting = self.chain[0][0] == 127 or (self.chain[0][2] >= DTM and not self.forced)
        if self.limit < self.most:
            if self.calm >= self.velocity - 1:
                self.limit, self.calm = self.limit + 1, 0
            else:
                self.calm += int(whole) // REF

    def see(self, value, light, ticks):
        if not self.chain:
            self.chain = [[expo(light), 0.0, 0.0, None]]
        if self.waiting:
            self.force(light)
        if not max(self.center - self.limit, 0) <= value <= min(self.center + self.limit, 255):
            self.flush(light)
            self.center, self.limit = value, self.baseline
            self.retarget(light)
        self.pour(light, ticks)
        if self.waiting:
            self.force(light)


def by_pixel(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r.x, r.y].append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def check(got, expected):
    found = {k: [e[1:] for e in v] for k, v in by_pixel(got, "n", "d", "t").items()}
    assert sum(map(len, expected.values())) > 20
    assert found == {k: v for k, v in expected.items() if v}


@pytest.fixture(scope="module")
def images(spark):
    return by_pixel(T.daily_image(T.pixel_events(spark, SF)), "frame", "v")


def test_pixel_integrate(spark, images):
    expected = {}
    for spot, values in images.items():
        w = Walk(10, 10, 1)
        for _, v in values:
            w.pour(float(v), float(REF))
        w.flush(0.0)
        expected[spot] = w.out
    check(QUERIES["pixel_integrate"](spark, SF), expected)


def test_transcode_frames(spark, images):
    expected = {}
    for spot, values in images.items():
        w = Walk(2, 7, 7)
        for _, v in values:
            w.see(v, float(v), float(REF))
        expected[spot] = w.out
    check(QUERIES["transcode_frames"](spark, SF), expected)


def test_transcode_feedback(spark, images):
    e = T.pixel_events(spark, SF)
    from flickerlake.operators import features

    corners = {(r.frame, r.x, r.y) for r in features.fast_corners(T.daily_image(e), *T.plane(e)).collect()}
    expected = {}
    for (x, y), values in images.items():
        w = Walk(9, 25, 5)
        for frame, v in values:
            w.see(v, float(v), float(REF))
            if any((frame, x + i, y + j) in corners for i in (-1, 0, 1) for j in (-1, 0, 1)):
                w.limit = 2
        expected[x, y] = w.out
    check(QUERIES["transcode_feedback"](spark, SF), expected)


def test_feedback_and_level_changes(spark):
    import random

    rng = random.Random(61)
    rows = [(f, x, 0, 100 + rng.randint(-12, 12)) for f in range(60) for x in range(3)]
    frames = spark.createDataFrame(rows, "frame long, x long, y long, v long")
    resets = spark.createDataFrame([(f, 1, 0, 2) for f in range(0, 60, 3)], "frame long, x long, y long, threshold long")
    levels = spark.createDataFrame([(40, 0, 0, 5), (20, 15, 25, 1)], "frame long, baseline long, most long, velocity long")
    expected = {}
    for x in range(3):
        w = Walk(9, 9, 6)
        for f, px, _, v in rows:
            if px != x:
                continue
            if f in (20, 40):
                w.baseline, w.most, w.velocity = {20: (15, 25, 1), 40: (0, 0, 5)}[f]
                w.limit, w.calm = w.baseline, 0
            w.see(v, float(v), float(REF))
            if x == 1 and f % 3 == 0:
                w.limit = 2
        expected[x, 0] = w.out
    got = X.transcode(frames, X.Options.of_level(4, baseline=9), resets, levels)
    check(got, expected)
    assert len(expected[1, 0]) > len(expected[2, 0])


def shown(log):
    return (math.exp(log) - 1) * 255


def test_polarity_transcode(spark):
    middle, expected = math.log1p(128 / 255), {}
    for spot, values in by_pixel(T.pixel_events(spark, SF), "t", "seq", "p").items():
        w, last, log = Walk(2, 7, 7), 2, middle
        for t, _, p in sorted((t // 3600, s, p) for t, s, p in values):
            if t < last:
                continue
            if t - last > 1:
                v = shown(log) if 0 <= shown(log) <= 255 else 128.0
                log = log if 0 <= shown(log) <= 255 else middle
                w.see(int(v), v * (t - last - 1), float((t - last - 1) * REF))
            log += 0.02 if p else -0.02
            if t > last:
                v = shown(log) if 0 <= shown(log) <= 255 else 128.0
                log = log if 0 <= shown(log) <= 255 else middle
                w.see(int(v), v, float(REF))
            last = t
        expected[spot] = w.out
    check(QUERIES["polarity_transcode"](spark, SF), expected)


def test_sensor_transcode(spark):
    expected = {}
    for spot, values in by_pixel(T.pixel_events(spark, SF), "t", "seq", "p", "v8").items():
        w, last, log = Walk(2, 7, 7), None, 0.0
        for t, seq, p, v8 in sorted((t // 60, s, p, v) for t, s, p, v in values):
            frame = seq % 5 == 0
            if (last is None and not frame) or (last is not None and t < last):
                continue
            gap = 0 if last is None else t - last
            held = min(max(shown(log), 0.0), 255.0)
            log = math.log1p(held / 255)
            if frame:
                if gap:
                    w.see(int(held), held / REF * gap, float(gap))
                log = math.log1p(v8 / 255)
                w.see(v8, float(v8), float(REF))
                last = t + REF
                continue
            if gap:
                if w.waiting:
                    w.force(held / REF * gap)
                w.pour(held / REF * gap, float(gap))
                if w.waiting:
                    w.force(held / REF * gap)
            log *= math.exp(0.15 if p else -0.15)
            new = min(max(shown(log), 0.0), 255.0)
            log = math.log1p(new / 255)
            if abs(int(new) - w.center) > w.limit:
                w.flush(new)
                w.center = int(new)
                w.retarget(new)
            last = t
        expected[spot] = w.out
    check(QUERIES["sensor_transcode"](spark, SF), expected)
