"""Queries of recurrences by pixel; their SQL walks each pixel's events one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from ..operators import folds as O
from ..operators import transcode as X
from ..sources import tables as T
from ..sources.tables import pixel_events
from .catalogue import query

_O = ", o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY t, seq) AS rn FROM px)"
_NEXT = "f JOIN o ON o.x = f.x AND o.y = f.y AND o.rn = f.rn + 1"


@query("send_on_delta", _O + f""", f AS (
    SELECT x, y, seq, rn, v8 > 30 AS fired, CASE WHEN v8 > 30 THEN v8 ELSE 0 END AS base FROM o WHERE rn = 1
    UNION ALL SELECT o.x, o.y, o.seq, o.rn, abs(o.v8 - base) > 30, CASE WHEN abs(o.v8 - base) > 30 THEN o.v8 ELSE base END FROM {_NEXT})
    SELECT x, y, seq, base FROM f WHERE fired""", recursive=True)
def send_on_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.send_on_delta(pixel_events(spark, sf_dir), 30)


_GROWN = "CASE WHEN c < 7 AND n >= 6 THEN c + 1 ELSE c END"
_COUNTED = "CASE WHEN c < 7 THEN CASE WHEN n >= 6 THEN 0 ELSE n + (o.t - f.t) // 3600 END ELSE n END"


@query("threshold_growth", _O + f""", f AS (
    SELECT x, y, 0::BIGINT AS seq, 0::BIGINT AS rn, 2::BIGINT AS c, 1::BIGINT AS n, 0::BIGINT AS t, 0::BIGINT AS base FROM o WHERE rn = 1
    UNION ALL SELECT o.x, o.y, o.seq, o.rn, CASE WHEN abs(o.v8 - base) > {_GROWN} THEN 2 ELSE {_GROWN} END, CASE WHEN abs(o.v8 - base) > {_GROWN} THEN 0 ELSE {_COUNTED} END, o.t, CASE WHEN abs(o.v8 - base) > {_GROWN} THEN o.v8 ELSE base END FROM {_NEXT})
    SELECT x, y, seq, c FROM f WHERE rn > 0""", recursive=True)
def threshold_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.threshold_growth(pixel_events(spark, sf_dir), T.REF, 2, 7, 7)


_LOG = "ln(1 + CASE WHEN o.d <= 127 THEN pow(2.0, o.d) ELSE 0 END / greatest({dt}, 1) * 3600 / 255.0)"
_POLARITY = """CASE WHEN o.d > 128 THEN NULL WHEN lev IS NULL THEN NULL
    WHEN new > 0.406 AND new < 0.407 AND (lev > ln(2) - 0.01 OR (o_t = f_t AND lev > 0.6)) THEN 1
    WHEN new > 0.406 AND new < 0.407 AND (lev < 0.01 OR (o_t = f_t AND lev < 0.3)) THEN 0
    WHEN new > lev + 0.005 THEN 1 WHEN new < lev - 0.005 THEN 0 END"""


@query("dvs_from_events", ", lit AS MATERIALIZED (SELECT * FROM px WINDOW w AS (PARTITION BY x, y ORDER BY t, seq) QUALIFY count(*) FILTER (WHERE d <= 128) OVER w > 0), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY t, seq) AS rn FROM lit)" + f""", f AS (
    SELECT x, y, rn, t, t AS old, NULL::BIGINT AS p, {_LOG.format(dt="o.t")} AS lev FROM o WHERE rn = 1
    UNION ALL SELECT x, y, rn, o_t, f_t, pol, CASE WHEN pol IS NULL THEN lev ELSE new END FROM (
        SELECT *, ({_POLARITY.replace("o.d", "d")})::BIGINT AS pol FROM (SELECT o.x, o.y, o.rn, o.d, o.t AS o_t, f.t AS f_t, f.lev, {_LOG.format(dt="(o.t - f.t)")} AS new FROM {_NEXT})))
    SELECT x, y, old + 1 AS t, p FROM f WHERE p IS NOT NULL""", recursive=True)
def dvs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.contrast_events(pixel_events(spark, sf_dir), T.REF)


_OUT = "(exp({l}) - 1) * 255 < 0 OR (exp({l}) - 1) * 255 > 255"
_MID = "ln(1 + 128 / 255.0::DOUBLE)"


@query("dvs_log_accumulate", _O + f""", f AS (
    SELECT x, y, 0::BIGINT AS seq, 0::BIGINT AS rn, 2::BIGINT AS last_t, {_MID} AS lg, NULL::DOUBLE AS v, false AS used FROM o WHERE rn = 1
    UNION ALL SELECT x, y, seq, rn, CASE WHEN t < last_t THEN last_t ELSE t END, CASE WHEN t < last_t THEN lg WHEN t > last_t AND ({_OUT.format(l="moved")}) THEN {_MID} ELSE moved END,
        CASE WHEN t > last_t AND ({_OUT.format(l="moved")}) THEN 128.0 ELSE (exp(moved) - 1) * 255 END, t >= last_t FROM (
        SELECT *, CASE WHEN t > last_t + 1 AND ({_OUT.format(l="lg")}) THEN {_MID} ELSE lg END + CASE WHEN p = 1 THEN 0.02::DOUBLE ELSE -0.02::DOUBLE END AS moved FROM (SELECT o.x, o.y, o.seq, o.rn, o.t, o.p, f.last_t, f.lg FROM {_NEXT})))
    SELECT x, y, seq, round(v, 6) AS v FROM f WHERE used""", recursive=True)
def dvs_log_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.log_accumulate(pixel_events(spark, sf_dir)).withColumn("v", F.round("v", 6))


@query("rate_drop", _O + f""", f AS (
    SELECT x, y, 0::BIGINT AS seq, 0::BIGINT AS rn, 0::DOUBLE AS r, 0::BIGINT AS last_t, false AS kept FROM o WHERE rn = 1
    UNION ALL SELECT x, y, seq, rn, CASE WHEN nr > 0.00002 THEN 0.9::DOUBLE * r ELSE nr END, CASE WHEN nr > 0.00002 THEN last_t ELSE t END, nr <= 0.00002 FROM (
        SELECT o.x, o.y, o.seq, o.rn, o.t, f.r, f.last_t, 0.9::DOUBLE * f.r + (1 - 0.9::DOUBLE) / greatest(o.t - f.last_t, 1) AS nr FROM {_NEXT}))
    SELECT x, y, seq, round(r, 12) AS rate FROM f WHERE kept""", recursive=True)
def rate_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.rate_drop(pixel_events(spark, sf_dir), 0.9, 0.00002).withColumn("rate", F.round("rate", 12))


@query("pixel_integrate")
def pixel_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.integrate_pixels(T.daily_image(pixel_events(spark, sf_dir)), X.Options())


@query("transcode_frames")
def transcode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.transcode(T.daily_image(pixel_events(spark, sf_dir)), X.Options(baseline=2, most=7, velocity=7))


@query("transcode_feedback")
def transcode_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above with the corners' feedback: thresholds of pixels near a frame's corner fall to 2 after it."""
    e = pixel_events(spark, sf_dir)
    images = T.daily_image(e)
    corners = features.fast_corners(images, *T.plane(e))
    w, h = T.plane(e)
    resets = features.threshold_resets(corners, F.lit(1), w, h, 9)
    return X.transcode(images, X.Options.of_level(5, baseline=9, most=25), resets)


@query("polarity_transcode")
def polarity_transcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of pixels known by polarity alone, on ticks of an hour."""
    e = pixel_events(spark, sf_dir).withColumn("t", F.floor(F.col("t") / T.REF))
    return X.transcode_polarity(e, X.Options(baseline=2, most=7, velocity=7))


@query("sensor_transcode")
def sensor_transcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of pixels with frames (every fifth row) and polarity between them, a row's gap within its frame."""
    e = pixel_events(spark, sf_dir).withColumn("frame", F.col("seq") % 5 == 0).withColumn("t", F.floor(F.col("t") / 60))
    return X.transcode_sensor(e, X.Options(baseline=2, most=7, velocity=7))
