"""Recurrences by pixel that have no closed form.

Events are dealt by pixel and sorted; each task streams them once and holds the state of one pixel at
a time, whatever the pixel's share of the events.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from .windows import ORDER

BATCH = 4096
# The middle of the 8-bit range as a logarithm, and bounds that tell it from others.
LOG_MIDDLE = math.log1p(128 / 255)
MIDDLE_BAND = (0.406, 0.407)
LOG_STEP = 0.02
# How far a level must be towards an end of the range for a reset at the same tick to count.
NEAR_FULL, NEAR_DARK = 0.6, 0.3

Step = Callable[[Any, tuple], Iterable[tuple]]


def fold(events: DataFrame, columns: list[str], start: Callable[[], Any], step: Step, schema: pa.Schema, finish: Callable[[Any], Iterable[tuple]] | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows (x, y, *what step and finish yield) of a pass over each pixel's events in order.

    ``step`` gets the state from ``start`` and the values of ``columns``; it changes the state in place.
    """
    full = pa.schema([("x", pa.int64()), ("y", pa.int64()), *schema])
    sql = ", ".join(f"{f.name} {_sql(f.type)}" for f in full)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pixel = state = None
        for batch in batches:
            for x, y, *row in zip(*(batch.column(c).to_pylist() for c in ("x", "y", *columns))):
                if (x, y) != pixel:
                    if pixel and finish:
                        out += [(*pixel, *r) for r in finish(state)]
                    pixel, state = (x, y), start()
                out += [(x, y, *r) for r in step(state, row)]
            if len(out) >= BATCH:
                yield _batch(out, full)
                out = []
        if pixel and finish:
            out += [(*pixel, *r) for r in finish(state)]
        yield _batch(out, full)

    wanted = [*dict.fromkeys(["x", "y", *columns, *order])]
    dealt = events.select(*wanted).repartition("x", "y").sortWithinPartitions("x", "y", *order)
    return dealt.mapInArrow(task, sql)


def _sql(kind: pa.DataType) -> str:
    return {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}[kind]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema([*fields.items()])


def send_on_delta(events: DataFrame, threshold: int) -> DataFrame:
    """(x, y, seq, base): events whose value differs from the last one sent by more than ``threshold``."""

    def step(s: list, row: tuple) -> Iterable[tuple]:
        seq, v = row
        if abs(v - s[0]) > threshold:
            s[0] = v
            yield seq, v

    return fold(events, ["seq", "v8"], lambda: [0], step, _schema(seq=pa.int64(), base=pa.int64()))


def threshold_growth(events: DataFrame, ref: int, baseline: int, most: int, velocity: int) -> DataFrame:
    """(x, y, seq, c): a threshold that grows by one after ``velocity`` quiet intervals, up to ``most``.

    An event whose value moved by more than the threshold sets it back to the baseline.
    """

    def step(s: dict, row: tuple) -> Iterable[tuple]:
        seq, t, v = row
        if s["c"] < most:
            if s["count"] >= velocity - 1:
                s["c"] += 1
                s["count"] = 0
            else:
                s["count"] += (t - s["t"]) // ref
        if abs(v - s["base"]) > s["c"]:
            s.update(base=v, c=baseline, count=0)
        s["t"] = t
        yield seq, s["c"]

    return fold(events, ["seq", "t", "v8"], lambda: {"c": baseline, "count": 1, "t": 0, "base": 0}, step, _schema(seq=pa.int64(), c=pa.int64()))


def contrast_events(events: DataFrame, ref: int, theta: float = 0.01) -> DataFrame:
    """(x, y, t, p): polarity events from intensity events, with a hysteresis of half of theta.

    The first lit event of a pixel sets its level. An empty event only moves time. A value in the
    middle band is a reset after clamping: it counts as ON or OFF by how near the old level was to its
    end of the range. A polarity event's time is one tick after the event before.
    """

    def step(s: dict, row: tuple) -> Iterable[tuple]:
        d, t = row
        if "level" not in s:
            if d <= 128:
                s.update(level=_log_light(d, t, ref), t=t)
            return
        old, s["t"] = s["t"], t
        if d > 128:
            return
        new, level, still = _log_light(d, t - old, ref), s["level"], t == old
        middle = MIDDLE_BAND[0] < new < MIDDLE_BAND[1]
        if middle and (level > math.log(2) - theta or (still and level > NEAR_FULL)):
            p = 1
        elif middle and (level < theta or (still and level < NEAR_DARK)):
            p = 0
        elif new > level + theta / 2:
            p = 1
        elif new < level - theta / 2:
            p = 0
        else:
            return
        s["level"] = new
        yield old + 1, p

    return fold(events, ["d", "t"], dict, step, _schema(t=pa.int64(), p=pa.int64()))


def _log_light(d: int, dt: int, ref: int) -> float:
    return math.log(1 + (2.0**d if d <= 127 else 0.0) / max(dt, 1) * ref / 255.0)


def log_accumulate(events: DataFrame) -> DataFrame:
    """(x, y, seq, v): 8-bit value of a pixel whose logarithm each polarity event moves by LOG_STEP.

    A value that leaves the range becomes the middle, at the time it would be shown.
    """

    def shown(log: float) -> tuple[float, float]:
        v = (math.exp(log) - 1) * 255
        return (v, log) if 0 <= v <= 255 else (128.0, LOG_MIDDLE)

    def step(s: list, row: tuple) -> Iterable[tuple]:
        seq, t, p = row
        last, log = s
        if t < last:
            return
        if t > last + 1:
            log = shown(log)[1]
        log += LOG_STEP if p else -LOG_STEP
        v = (math.exp(log) - 1) * 255
        if t > last:
            v, log = shown(log)
        s[:] = t, log
        yield seq, v

    return fold(events, ["seq", "t", "p"], lambda: [2, LOG_MIDDLE], step, _schema(seq=pa.int64(), v=pa.float64()))


def rate_drop(events: DataFrame, alpha: float, target: float) -> DataFrame:
    """(x, y, seq, rate): events kept while a pixel's smoothed rate stays within ``target``, in event time."""

    def step(s: list, row: tuple) -> Iterable[tuple]:
        seq, t = row
        rate = alpha * s[0] + (1 - alpha) / max(t - s[1], 1)
        if rate > target:
            s[0] = alpha * s[0]
        else:
            s[:] = rate, t
            yield seq, rate

    return fold(events, ["seq", "t"], lambda: [0.0, 0], step, _schema(seq=pa.int64(), rate=pa.float64()))
