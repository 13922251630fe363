"""Intensity to events: the tree of integrating nodes that each pixel holds.

A node gathers light until it has 2^d; it then remembers the event that says so as its best, aims at
the next power of two above, and hands what is left to a fresh node below. Popping emits the best
events from the root down. A pixel of constant light is described by fewer and fewer events as the
root climbs. State is kept in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.events import D_EMPTY, D_MAX, D_ZERO, QUALITY_LEVELS
from .folds import LOG_MIDDLE, LOG_STEP, fold

TINY = 2.0**-23


def exponent(light: float) -> int:
    return D_ZERO if light < 1 else min(int(math.floor(math.log2(math.floor(light)))), D_MAX)


def quantum(d: int) -> float:
    return 2.0**d if d <= D_MAX else 0.0


@dataclass
class Node:
    d: int
    light: float = 0.0
    ticks: float = 0.0
    best: tuple[int, float] | None = None


@dataclass
class Options:
    ref: int = 255
    dtm: int = 7650
    continuous: bool = True
    collapse: bool = True
    absolute: bool = True
    baseline: int = 10
    most: int = 10
    velocity: int = 1

    @classmethod
    def of_level(cls, level: int, **others: Any) -> Options:
        """The thresholds of a quality level; keyword arguments set anything by hand."""
        _, baseline, most, velocity, _ = QUALITY_LEVELS[level]
        return cls(**{"baseline": baseline, "most": most, "velocity": velocity, **others})


@dataclass
class Pixel:
    """State of one pixel; ``step`` takes an 8-bit value, its light and how long it lasted."""

    options: Options
    nodes: list[Node] = field(default_factory=list)
    last_fired: float = 0.0
    running: float = 0.0
    base: int = 0
    threshold: int = 10
    quiet: int = 1
    due: bool = False
    popped: bool = False

    def _emit(self, d: int, ticks: float) -> tuple[int, int]:
        o = self.options
        if not o.absolute:
            return d, int(ticks)
        t = self.last_fired + ticks
        if not o.continuous:
            t = math.ceil(t / o.ref) * o.ref
        self.last_fired = t
        return d, int(t)

    def _gather(self, node: Node, light: float, ticks: float) -> tuple[bool, float, float]:
        """Whether the node filled, and the light and ticks that are left over."""
        total = node.light + light
        if total < quantum(node.d):
            node.light, node.ticks = total, node.ticks + ticks
            return False, 0.0, 0.0
        d = exponent(total)
        share = 1.0 if D_ZERO in (d, node.d) or light < TINY else (quantum(d) - node.light) / light
        node.best = d, node.ticks + ticks * share
        if d < D_MAX:
            node.light, node.ticks = total, node.ticks + ticks
            # light is at least 2^d here, so the next aim is the first power above it
            node.d = max(d + 1, int(math.floor(node.light)).bit_length())
        if not self.options.continuous:
            return True, 0.0, 0.0
        return True, light - light * share, ticks - ticks * share

    def integrate(self, light: float, ticks: float) -> None:
        o, span = self.options, ticks
        if not self.nodes:
            self.nodes = [Node(exponent(light))]
        tail = self.nodes[-1]
        if tail.light == 0 and tail.ticks == 0:
            tail.d = exponent(light)
        self.running += ticks
        k = 0
        while k < len(self.nodes):
            filled, rest, rest_ticks = self._gather(self.nodes[k], light, ticks)
            if filled:
                del self.nodes[k + 1 :]
                self.nodes.append(Node(exponent(light)))
                light, ticks = rest, rest_ticks
                if not o.continuous or light == 0:
                    break
                if ticks > o.ref:
                    self.nodes[k + 1].d = exponent(light)
            if self.popped and o.collapse:
                break
            k += 1
        root = self.nodes[0]
        self.due = root.d == D_MAX or (root.ticks >= o.dtm and not self.popped)
        if self.threshold < o.most:
            if self.quiet >= o.velocity - 1:
                self.threshold, self.quiet = self.threshold + 1, 0
            else:
                self.quiet += int(span) // o.ref

    def pop_top(self, upcoming: float) -> list[tuple[int, int]]:
        """The root's event, forced."""
        root = self.nodes[0]
        self.due, self.popped = False, True
        if root.best:
            out = [self._emit(*root.best)]
            self.nodes = self.nodes[1:] or [Node(exponent(upcoming))]
        elif root.light == 0:
            out = [self._emit(D_ZERO, root.ticks)] if root.ticks > 0 else []
            root.ticks = 0.0
        else:
            out = [self._emit(exponent(root.light), root.ticks)]
            self.nodes = [Node(exponent(upcoming))]
        return out

    def pop_best(self, upcoming: float) -> list[tuple[int, int]]:
        """All best events, root first; after a forced pop in collapse mode one event and an empty one."""
        fired = []
        for node in self.nodes:
            if node.best:
                fired.append(node.best)
            elif node.ticks > 0 and node.light == 0:
                fired.append((D_ZERO, node.ticks))
        if self.popped and self.options.collapse and fired:
            out = [self._emit(*fired[0])]
            out.append((D_EMPTY, int(self.running)))
            self.last_fired = self.running
            self.nodes = [Node(exponent(upcoming))]
        else:
            out = [self._emit(*f) for f in fired]
            self.nodes = self.nodes[-1:] or [Node(exponent(upcoming))]
            for node in self.nodes:
                node.best = None
                if fired and node.light == 0:
                    node.ticks = 0.0
        self.due = self.popped = False
        return out

    def aim(self, upcoming: float) -> list[tuple[int, int]]:
        """In continuous mode, a weaker light ends what was being gathered with an empty event."""
        root, d, out = self.nodes[0], exponent(upcoming), []
        if d < root.d and root.ticks > 0:
            out.append(self._emit(D_EMPTY, root.ticks))
            root.light = root.ticks = 0.0
        root.d = d
        return out

    def step(self, value: int, light: float, ticks: float) -> list[tuple[int, int]]:
        if not self.nodes:
            self.nodes = [Node(exponent(light))]
        out = self.pop_top(light) if self.due else []
        if value < max(self.base - self.threshold, 0) or value > min(self.base + self.threshold, 255):
            out += self.pop_best(light)
            self.base, self.threshold = value, self.options.baseline
            if self.options.continuous:
                out += self.aim(light)
        self.integrate(light, ticks)
        if self.due:
            out += self.pop_top(light)
        return out


_EVENTS = pa.schema([("n", pa.int64()), ("d", pa.int64()), ("t", pa.int64())])


def integrate_pixels(images: DataFrame, options: Options) -> DataFrame:
    """(x, y, n, d, t): all light of images(frame, x, y, v) gathered without a threshold, popped at the end."""

    def step(p: Pixel, row: tuple) -> Iterable[tuple]:
        p.integrate(float(row[0]), float(options.ref))
        return ()

    def finish(p: Pixel) -> Iterable[tuple]:
        return [(n, *e) for n, e in enumerate(p.pop_best(0.0))]

    return fold(images, ["v"], lambda: Pixel(options), step, _EVENTS, finish, ("frame",))


def transcode(images: DataFrame, options: Options, resets: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """(x, y, n, d, t): events of images(frame, x, y, v), each shown for one reference interval.

    ``resets`` (frame, x, y, threshold) are the features' feedback: after that frame's value a pixel's
    threshold is the one given. ``levels`` (frame, baseline, most, velocity) change the quality from a
    frame on; every pixel's threshold then starts anew from the baseline. They are one row a change.
    """
    plain = F.lit(None).cast("long")
    rows = images.select("frame", "x", "y", "v")
    rows = rows.join(resets.select("frame", "x", "y", "threshold"), ["frame", "x", "y"], "left") if resets is not None else rows.withColumn("threshold", plain)
    changes = [] if levels is None else sorted((r["frame"], r["baseline"], r["most"], r["velocity"]) for r in levels.collect())

    def start() -> dict:
        return {"pixel": Pixel(replace(options), threshold=options.baseline), "n": 0, "level": 0}

    def step(s: dict, row: tuple) -> Iterable[tuple]:
        v, frame, threshold = row
        pixel = s["pixel"]
        while s["level"] < len(changes) and changes[s["level"]][0] <= frame:
            _, baseline, most, velocity = changes[s["level"]]
            pixel.options = replace(pixel.options, baseline=baseline, most=most, velocity=velocity)
            pixel.threshold, pixel.quiet = baseline, 0
            s["level"] += 1
        for event in pixel.step(int(v), float(v), float(options.ref)):
            yield s["n"], *event
            s["n"] += 1
        if threshold is not None:
            pixel.threshold = threshold

    return fold(rows, ["v", "frame", "threshold"], start, step, _EVENTS, order=("frame",))


def _shown(log: float) -> float:
    return (math.exp(log) - 1) * 255


class _Numbered:
    """A pixel with the count of events it has given."""

    def __init__(self, options: Options):
        self.pixel, self.n = Pixel(options, threshold=options.baseline), 0

    def give(self, events: list[tuple[int, int]]) -> Iterable[tuple]:
        for event in events:
            yield self.n, *event
            self.n += 1


def transcode_polarity(events: DataFrame, options: Options, theta: float = LOG_STEP) -> DataFrame:
    """(x, y, n, d, t): events of a pixel that only polarity events (t, p) are known of.

    Its logarithm starts in the middle of the range. Before each event the value held so far is
    gathered for the ticks in between, after it the moved value for one; a value out of range becomes
    the middle. Each source tick lasts one reference interval.
    """

    def start() -> _Numbered:
        s = _Numbered(options)
        s.last, s.log = 2, LOG_MIDDLE
        return s

    def settle(s: _Numbered) -> float:
        if not 0 <= _shown(s.log) <= 255:
            s.log = LOG_MIDDLE
            return 128.0
        return _shown(s.log)

    def step(s: _Numbered, row: tuple) -> Iterable[tuple]:
        t, p = row
        if t < s.last:
            return
        gap, moved = t - s.last - 1, t > s.last
        if gap > 0:
            v = settle(s)
            yield from s.give(s.pixel.step(int(v), v * gap, float(gap * options.ref)))
        s.log += theta if p else -theta
        s.last = t
        if moved:
            v = settle(s)
            yield from s.give(s.pixel.step(int(v), v, float(options.ref)))

    return fold(events, ["t", "p"], start, step, _EVENTS)


def transcode_sensor(events: DataFrame, options: Options, contrast: float = 0.15) -> DataFrame:
    """(x, y, n, d, t): events of a pixel that has both frames and polarity events.

    ``frame`` marks rows whose v8 is a frame's value at t. Such a row first fills the gap since the
    pixel's last row with the value held so far, then is shown for one reference interval. A polarity
    event also fills the gap, then scales the held logarithm by exp(+-contrast); if the value leaves
    the threshold around its base, what has been gathered is popped. Values are held in range.
    """

    def start() -> _Numbered:
        s = _Numbered(options)
        s.last, s.log = None, 0.0
        return s

    def value(s: _Numbered) -> float:
        v = min(max(_shown(s.log), 0.0), 255.0)
        s.log = math.log1p(v / 255)
        return v

    def step(s: _Numbered, row: tuple) -> Iterable[tuple]:
        t, p, v8, frame = row
        pixel = s.pixel
        gap = 0 if s.last is None else t - s.last
        if gap < 0 or (s.last is None and not frame):
            return
        held = value(s)
        light = held / options.ref * gap
        if frame:
            if gap:
                yield from s.give(pixel.step(int(held), light, float(gap)))
            s.log = math.log1p(v8 / 255)
            yield from s.give(pixel.step(v8, float(v8), float(options.ref)))
            s.last = t + options.ref
            return
        if gap:
            if pixel.due:
                yield from s.give(pixel.pop_top(light))
            pixel.integrate(light, float(gap))
            if pixel.due:
                yield from s.give(pixel.pop_top(light))
        s.log *= math.exp(contrast if p else -contrast)
        new = value(s)
        if abs(int(new) - pixel.base) > pixel.threshold:
            yield from s.give(pixel.pop_best(new))
            pixel.base = int(new)
            yield from s.give(pixel.aim(new))
        s.last = t

    return fold(events, ["t", "p", "v8", "frame"], start, step, _EVENTS)
