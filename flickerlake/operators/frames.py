"""Frames from sparse events, in closed form.

An event that ends in a later frame than every earlier one of its pixel fills the frames between with
its value; an empty event (D_EMPTY) repeats the last value. Runs of frames are kept as ranges until
they must be exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.events import D_EMPTY, frame_value, long, whole
from . import windows as W


def frame_runs(events: DataFrame, ref: int, tpf: int) -> DataFrame:
    """(x, y, first, last, v): ranges of frames and the value they show."""
    kept = W.frame_aligned(events, ref)
    reached = whole(F.greatest(F.col("t") - 1, F.lit(0)), tpf)
    framed = kept.withColumn("last", reached)
    crossing = framed.withColumn("first", F.coalesce(F.max("last").over(W.before()), F.lit(-1)) + 1).where("last >= first")
    shown = F.when(F.col("d") != D_EMPTY, frame_value(F.col("d"), F.col("dt"), ref))
    value = F.coalesce(F.last(shown, ignorenulls=True).over(W.upto()), F.lit(0.0))
    return crossing.select("x", "y", "first", "last", long(value).alias("v"))


def explode_runs(runs: DataFrame) -> DataFrame:
    return runs.select("x", "y", F.explode(F.sequence("first", "last")).alias("frame"), "v")


def reconstruct(events: DataFrame, ref: int, tpf: int) -> DataFrame:
    """(x, y, frame, v): frames that events fill."""
    return explode_runs(frame_runs(events, ref, tpf))


def forward_fill(events: DataFrame, ref: int, tpf: int) -> DataFrame:
    """As ``reconstruct``, each pixel's last value held up to the last frame of any pixel."""
    from pyspark.sql import Window

    runs = frame_runs(events, ref, tpf)
    # read from time alone
    end = events.agg(whole(F.greatest(F.max("t") - 1, F.lit(0)), tpf)).scalar()
    w = Window.partitionBy("x", "y").orderBy("first")
    final = F.lead("first").over(w).isNull()
    held = runs.withColumn("final", final)
    return explode_runs(held.withColumn("last", F.when(F.col("final"), F.greatest(F.col("last"), end)).otherwise(F.col("last"))))
