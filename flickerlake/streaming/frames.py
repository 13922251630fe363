"""Live event streams: frame statistics under a watermark, and folds with keyed state.

A frame's counts leave when the watermark passes its end; the delay stands for the longest time that
a framer waits before it gives a frame up. Events that are later than that are dropped. ``frames`` gives a
frame as soon as all its pixels are there, and what there is of it when the wait is over; ``held_pixels``
gives a pixel that has been silent for too long; a stream that ends leaves behind what no timer has
reached, so a source closes with an event later than all waits, which flushes every frame and pixel.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.events import long


def frame_counts(events: DataFrame, frame: str = "1 day", wait: str = "2 days") -> DataFrame:
    """(start, pixels, n): events and pixels of each frame of a stream with ts, x and y."""
    # one row a pixel first, so that pixels are counted exactly
    pixels = events.withWatermark("ts", wait).groupBy(F.window("ts", frame).alias("w"), "x", "y").agg(F.count("*").alias("n"))
    counts = pixels.groupBy("w").agg(F.sum("n").alias("n"), F.count("*").alias("pixels"))
    return counts.select(F.col("w.start").alias("start"), long(F.col("pixels")).alias("pixels"), "n")


class SendOnDelta(StatefulProcessor):
    """Passes on a pixel's value when it differs from the last one passed on by more than ``threshold``."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "base long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        base = self.base.get()[0] if self.base.exists() else 0
        frame = pd.concat(rows).sort_values(["t", "seq"])
        sent = []
        for t, seq, v in zip(frame["t"], frame["seq"], frame["v8"]):
            if abs(v - base) > self.threshold:
                base = int(v)
                sent.append((key[0], key[1], int(t), int(seq), base))
        self.base.update((base,))
        yield pd.DataFrame(sent, columns=["x", "y", "t", "seq", "base"]).astype("int64")

    def close(self) -> None:
        pass


def send_on_delta(events: DataFrame, threshold: int) -> DataFrame:
    """The fold of operators.folds over a stream; order holds within a batch and between batches."""
    return events.groupBy("x", "y").transformWithStateInPandas(SendOnDelta(threshold), "x long, y long, t long, seq long, base long", "Append", "None")


class Frames(StatefulProcessor):
    """A frame's pixels, each the last value by (t, seq), until all are there or the timer forces it out."""

    def __init__(self, pixels: int, length: int, wait: int):
        self.pixels, self.length, self.wait = pixels, length, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "x long, y long", "t long, seq long, v long")
        self.meta = handle.getValueState("meta", "n long, done boolean")

    def _out(self, frame: int, complete: bool) -> pd.DataFrame:
        rows = [(frame, k[0], k[1], v[2], complete) for k, v in self.seen.iterator()]
        self.seen.clear()
        return pd.DataFrame(rows, columns=["frame", "x", "y", "v", "complete"]).astype({"frame": "int64", "x": "int64", "y": "int64", "v": "int64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, done = self.meta.get() if self.meta.exists() else (0, False)
        if done:  # later events of a frame that has left
            return
        if not n:
            self.handle.registerTimer((key[0] + 1) * self.length * 1000 + self.wait * 1000)
        for part in rows:
            for x, y, t, seq, v in zip(part["x"], part["y"], part["t"], part["seq"], part["v8"]):
                spot = int(x), int(y)
                old = self.seen.getValue(spot) if self.seen.containsKey(spot) else None
                n += old is None
                if old is None or (old[0], old[1]) < (t, seq):
                    self.seen.updateValue(spot, (int(t), int(seq), int(v)))
        if n >= self.pixels:
            self.meta.update((n, True))
            yield self._out(int(key[0]), True)
        else:
            self.meta.update((n, False))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, done = self.meta.get() if self.meta.exists() else (0, True)
        self.meta.clear()
        if not done:
            yield self._out(int(key[0]), n >= self.pixels)

    def close(self) -> None:
        pass


def frames(events: DataFrame, pixels: int, length: int, wait: int) -> DataFrame:
    """(frame, x, y, v, complete) of events(ts, x, y, t, seq, v8): frames of ``length`` seconds on a plane of ``pixels``.

    A frame leaves when all pixels have a value, or ``wait`` seconds of event time after its end.
    """
    keyed = events.withWatermark("ts", "0 seconds").withColumn("frame", long(F.floor(F.col("t") / length)))
    return keyed.groupBy("frame").transformWithStateInPandas(Frames(pixels, length, wait), "frame long, x long, y long, v long, complete boolean", "Append", "EventTime")


class HeldPixels(StatefulProcessor):
    """Remembers a pixel's last event; if none follows within ``longest`` seconds, says that it still holds."""

    def __init__(self, longest: int):
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long, seq long, v long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = tuple(self.last.get()) if self.last.exists() else None
        for part in rows:
            for event in zip(part["t"], part["seq"], part["v8"]):
                event = tuple(int(v) for v in event)
                best = event if best is None or event[:2] > best[:2] else best
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((best[0] + self.longest) * 1000)
        self.last.update(best)
        yield pd.DataFrame([], columns=["x", "y", "t", "v"]).astype("int64")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        t, _, v = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], key[1], t + self.longest, v)], columns=["x", "y", "t", "v"]).astype("int64")

    def close(self) -> None:
        pass


def held_pixels(events: DataFrame, longest: int) -> DataFrame:
    """(x, y, t, v): pixels without an event for ``longest`` seconds of event time, at the time that this is so."""
    keyed = events.withWatermark("ts", "0 seconds")
    return keyed.groupBy("x", "y").transformWithStateInPandas(HeldPixels(longest), "x long, y long, t long, v long", "Append", "EventTime")


def unit_counts(events: DataFrame, length: int, wait: str = "0 seconds") -> DataFrame:
    """(adu, n): events of each unit of ``length`` seconds, closed on the right: an event on the border ends its unit."""
    # windows are closed on the left, so a microsecond less puts a border's event before it
    early = F.col("ts") - F.expr("INTERVAL '0.000001' SECOND")
    counts = events.withColumn("ts", F.when(F.col("t") > 0, early).otherwise(F.col("ts"))).withWatermark("ts", wait).groupBy(F.window("ts", f"{length} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.select(long(F.floor(F.unix_timestamp("w.start") / length)).alias("adu"), "n")


class RateDrop(StatefulProcessor):
    """Passes on events while a pixel's smoothed rate stays within ``target``, in event time."""

    def __init__(self, alpha: float, target: float):
        self.alpha, self.target = alpha, target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "rate double, t long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rate, last = self.state.get() if self.state.exists() else (0.0, 0)
        frame = pd.concat(rows).sort_values(["t", "seq"])
        kept = []
        for t, seq in zip(frame["t"], frame["seq"]):
            new = self.alpha * rate + (1 - self.alpha) / max(t - last, 1)
            if new > self.target:
                rate *= self.alpha
            else:
                rate, last = new, int(t)
                kept.append((key[0], key[1], int(seq), new))
        self.state.update((float(rate), int(last)))
        yield pd.DataFrame(kept, columns=["x", "y", "seq", "rate"]).astype({"x": "int64", "y": "int64", "seq": "int64", "rate": "float64"})

    def close(self) -> None:
        pass


def rate_drop(events: DataFrame, alpha: float, target: float) -> DataFrame:
    """The fold of operators.folds over a stream."""
    return events.groupBy("x", "y").transformWithStateInPandas(RateDrop(alpha, target), "x long, y long, seq long, rate double", "Append", "None")
