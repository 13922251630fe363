"""Ordered operators by pixel, as windows over (x, y) in order of time and arrival.

All of them share one partitioning, so a chain of them is shuffled once. A pixel with a very large
share of all events is bounded by the sort of its own events, which spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.events import round_up

ORDER = ("t", "seq")


def by_pixel(order: tuple[str, ...] = ORDER) -> WindowSpec:
    return Window.partitionBy("x", "y").orderBy(*order)


def before(order: tuple[str, ...] = ORDER) -> WindowSpec:
    return by_pixel(order).rowsBetween(Window.unboundedPreceding, -1)


def upto(order: tuple[str, ...] = ORDER) -> WindowSpec:
    return by_pixel(order).rowsBetween(Window.unboundedPreceding, 0)


def with_delta(events: DataFrame) -> DataFrame:
    """Adds dt, ticks since the pixel's last event (or since zero)."""
    return events.withColumn("dt", F.col("t") - F.lag("t", 1, 0).over(by_pixel()))


def delta_to_absolute(events: DataFrame, ref: int | None = None, dt: str = "dt") -> Column:
    """Absolute ticks from dt; with ``ref`` every event but the last counts as whole intervals, as for framed sources."""
    step = round_up(F.col(dt), ref) if ref else F.col(dt)
    return F.coalesce(F.sum(step).over(before()), F.lit(0)) + F.col(dt)


def outside_exposures(events: DataFrame, exposures: DataFrame, frame: Column) -> DataFrame:
    """Events before or after the exposure of their frame, with ``side``; exposures(frame, opens, closes).

    An interval join binned by frame: an exposure lies within its frame, so equal frames are joined and
    the two comparisons follow. Events of frames without an exposure are left out.
    """
    t = F.col("t")
    both = events.withColumn("frame", frame).join(exposures, "frame").where((t < F.col("opens")) | (t > F.col("closes")))
    return both.withColumn("side", F.when(t < F.col("opens"), "before").otherwise("after"))


def frame_aligned(events: DataFrame, ref: int) -> DataFrame:
    """Events whose time lies after every earlier event's, rounded up to a multiple of ``ref``.

    ``start`` is that rounded time (0 if there is none), ``dt`` what the event took.
    """
    start = F.coalesce(F.max(round_up(F.col("t"), ref)).over(before()), F.lit(0))
    placed = events.withColumn("start", start).where(F.col("t") > F.col("start"))
    return placed.withColumn("dt", F.col("t") - F.col("start"))
