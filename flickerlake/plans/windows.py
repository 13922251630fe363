"""Queries of per-pixel windows, orders and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..operators import windows as W
from ..sources import tables as T
from ..sources.tables import pixel_events
from .catalogue import query


@query("abs_to_delta", " SELECT x, y, seq, dt FROM delta")
def abs_to_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_delta(pixel_events(spark, sf_dir)).select("x", "y", "seq", "dt")


@query("delta_to_abs", " SELECT x, y, seq, (sum(dt) OVER (PARTITION BY x, y ORDER BY t, seq))::BIGINT AS t FROM delta")
def delta_to_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.with_delta(pixel_events(spark, sf_dir))
    return e.select("x", "y", "seq", W.delta_to_absolute(e).alias("t"))


@query("delta_to_abs_framed", " SELECT x, y, seq, (coalesce(sum((dt + 3599) // 3600 * 3600) OVER (PARTITION BY x, y ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + dt)::BIGINT AS t FROM delta")
def delta_to_abs_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.with_delta(pixel_events(spark, sf_dir))
    return e.select("x", "y", "seq", W.delta_to_absolute(e, T.REF).alias("t"))


_ALIGNED = """, placed AS (
    SELECT *, coalesce(max((t + 3599) // 3600 * 3600) OVER (PARTITION BY x, y ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM px
), aligned AS (SELECT *, t - start AS dt FROM placed WHERE t > start)"""


@query("monotone_filter", _ALIGNED + " SELECT x, y, seq, t, start, dt FROM aligned")
def monotone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.frame_aligned(pixel_events(spark, sf_dir), T.REF).select("x", "y", "seq", "t", "start", "dt")


@query("instant_rate", " SELECT x, y, seq, round(1.0 / dt, 12) AS rate FROM delta WHERE dt > 0")
def instant_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.with_delta(pixel_events(spark, sf_dir)).where("dt > 0")
    return e.select("x", "y", "seq", F.round(1.0 / F.col("dt"), 12).alias("rate"))


@query("last_of_run", """, chunk AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx FROM px WINDOW w AS (PARTITION BY y, t // 86400 ORDER BY t, seq))
    SELECT x, y, seq, t // 86400 AS frame FROM chunk WHERE nx <> x""")
def last_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a row's daily buffer, events whose successor (the first after the last) is another pixel's."""
    day = E.whole(F.col("t"), T.DAY)
    w = Window.partitionBy("y", "frame").orderBy("t", "seq")
    e = pixel_events(spark, sf_dir).withColumn("frame", day)
    follower = F.coalesce(F.lead("x").over(w), F.first("x").over(w))
    return e.withColumn("nx", follower).where("nx <> x").select("x", "y", "seq", "frame")


@query("latest_pixel_value", """, up AS (SELECT *, (t + 3599) // 3600 * 3600 AS r FROM px WHERE d <= 128),
    s AS (SELECT *, r - coalesce(lag(r) OVER (PARTITION BY x, y ORDER BY t, seq), 0) AS gap FROM up)
    SELECT x, y, last(r ORDER BY t, seq) AS t, round(last(CASE WHEN d <= 127 THEN pow(2.0, d) ELSE 0 END / greatest(gap, 1) * 3600 ORDER BY t, seq), 6) AS v FROM s GROUP BY x, y""")
def latest_pixel_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a player shows: each pixel's last playable intensity, with times rounded up to intervals."""
    e = pixel_events(spark, sf_dir).where(F.col("d") <= E.D_ZERO).withColumn("r", E.round_up(F.col("t"), T.REF))
    gap = F.col("r") - F.lag("r", 1, 0).over(W.by_pixel())
    v = E.intensity(F.col("d"), F.col("gap")) * T.REF
    last = F.max_by(F.struct("r", "v"), F.struct("t", "seq")).alias("last")
    return e.withColumn("gap", gap).withColumn("v", v).groupBy("x", "y").agg(last).select("x", "y", F.col("last.r").alias("t"), F.round("last.v", 6).alias("v"))


@query("asof_hold", """, held AS (SELECT x, y, t, seq, v8, lag(v8) OVER w AS was, lag(t) OVER w AS since FROM px WINDOW w AS (PARTITION BY x, y ORDER BY t, seq))
    SELECT x, y, seq, coalesce(was, 128)::BIGINT AS held, (t - coalesce(since, 0))::BIGINT AS ticks FROM held""")
def asof_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that a pixel held up to each of its events, and for how long."""
    w = W.by_pixel()
    held, ticks = F.lag("v8", 1, 128).over(w), F.col("t") - F.lag("t", 1, 0).over(w)
    return pixel_events(spark, sf_dir).select("x", "y", "seq", held.alias("held"), ticks.alias("ticks"))


@query("interleave_sort", " SELECT x, y, t, seq, row_number() OVER (PARTITION BY t // 86400 ORDER BY t, seq) AS nth, t // 86400 AS frame FROM px")
def interleave_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in time order, numbered within days.

    Events are numbered within intervals, and each interval begins where the counts of those before it in
    its day end, so a day isn't one task's work.
    """
    interval = E.whole(F.col("t"), T.REF)
    e = pixel_events(spark, sf_dir).select("x", "y", "t", "seq", E.whole(F.col("t"), T.DAY).alias("frame"), interval.alias("interval"))
    before = F.sum("n").over(Window.partitionBy("frame").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1))
    starts = e.groupBy("frame", "interval").agg(F.count("*").alias("n")).select("interval", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("interval").orderBy("t", "seq"))
    numbered = e.withColumn("own", own).join(starts, "interval")
    return numbered.select("x", "y", "t", "seq", E.long(F.col("start") + F.col("own")).alias("nth"), "frame").orderBy("t", "seq")


@query("frame_limit", " SELECT x, y, t, seq FROM px WHERE t // 86400 >= 5 AND t // 86400 < 15")
def frame_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten daily frames from the sixth on."""
    frame = E.whole(F.col("t"), T.DAY)
    return pixel_events(spark, sf_dir).where((frame >= 5) & (frame < 15)).select("x", "y", "t", "seq")


@query("exposure_gap_events", """, exposure AS (SELECT t // 86400 AS frame, min(t) + 600 AS opens, max(t) - 600 AS closes FROM px WHERE p = 1 GROUP BY ALL)
    SELECT x, y, seq, t // 86400 AS frame, CASE WHEN t < opens THEN 'before' ELSE 'after' END AS side FROM px JOIN exposure e ON t // 86400 = e.frame AND (t < opens OR t > closes)""")
def exposure_gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside their day's exposure, which opens 600 ticks after its first ON event and closes 600 before its last."""
    e = pixel_events(spark, sf_dir)
    day = E.whole(F.col("t"), T.DAY)
    exposures = e.where("p = 1").groupBy(day.alias("frame")).agg((F.min("t") + 600).alias("opens"), (F.max("t") - 600).alias("closes"))
    return W.outside_exposures(e, exposures, day).select("x", "y", "seq", "frame", "side")


@query("flatten_chunks", " SELECT x, y, seq, d FROM px")
def flatten_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events gathered by row and interval, as a transcoder hands them on, and laid flat again.

    An interval's events of a row are what a chunk may hold.
    """
    e = pixel_events(spark, sf_dir)
    chunks = e.groupBy("y", E.whole(F.col("t"), T.REF).alias("frame")).agg(F.collect_list(F.struct("x", "seq", "d")).alias("chunk"))
    return chunks.select("y", F.explode("chunk").alias("e")).select("e.x", "y", "e.seq", "e.d")
