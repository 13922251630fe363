"""Queries of stream statistics, image quality and evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..operators import metrics as O
from ..operators.windows import with_delta
from ..sources import tables as T
from ..sources.tables import pixel_events
from .catalogue import query
from .frames import FILLED, filled

_LIGHT = "(CASE WHEN d <= 127 THEN pow(2.0, d) ELSE 0 END / greatest(dt, 1))"


@query("stream_info", f" SELECT count(*) AS n_events, count(*) * 9 + 33 + 11 AS n_bytes, round(count(*) / (w * h)::DOUBLE, 9) AS per_pixel, round(min({_LIGHT}) FILTER (WHERE d < 128), 12) AS least, round(max({_LIGHT}) FILTER (WHERE d < 128), 12) AS greatest FROM delta, plane GROUP BY w, h")
def stream_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, bytes of a version 2 stream with end marker, events a pixel, extreme intensities."""
    e = pixel_events(spark, sf_dir)
    lit = F.when(F.col("d") < E.D_ZERO, E.intensity(F.col("d"), F.col("dt")))
    sums = with_delta(e).agg(F.count("*").alias("n_events"), F.min(lit).alias("a"), F.max(lit).alias("b"))
    w, h = T.plane(e)
    return sums.select("n_events", (F.col("n_events") * 9 + 33 + 11).alias("n_bytes"), F.round(F.col("n_events") / (w * h), 9).alias("per_pixel"), F.round("a", 12).alias("least"), F.round("b", 12).alias("greatest"))


@query("dynamic_range", f", r AS (SELECT min({_LIGHT}) AS lo, max({_LIGHT}) AS hi FROM delta WHERE d < 128) SELECT round(20 * log10(pow(2.0, 127) / (1.0 / 86400)), 6) AS theoretical_db, round(log2(pow(2.0, 127) / (1.0 / 86400)), 6) AS theoretical_bits, round(20 * log10(hi / lo), 6) AS realized_db, round(log2(hi / lo), 6) AS realized_bits FROM r")
def dynamic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_delta(pixel_events(spark, sf_dir)).where(F.col("d") < E.D_ZERO)
    light = E.intensity(F.col("d"), F.col("dt"))
    most = F.lit(2.0**127 / (1.0 / T.DTM))
    ratio = F.col("hi") / F.col("lo")
    db, bits = (lambda r: F.round(20 * F.log10(r), 6)), (lambda r: F.round(F.log2(r), 6))
    return e.agg(F.min(light).alias("lo"), F.max(light).alias("hi")).select(db(most).alias("theoretical_db"), bits(most).alias("theoretical_bits"), db(ratio).alias("realized_db"), bits(ratio).alias("realized_bits"))


@query("event_count_heatmap", ", n AS (SELECT x, y, count(*) AS n FROM px GROUP BY ALL) SELECT x, y, n, trunc(n * 255.0::DOUBLE / (SELECT max(n) FROM n))::BIGINT AS heat FROM n")
def event_count_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pixel_events(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).scalar()
    return counts.select("x", "y", "n", E.long(F.floor(F.col("n") * 255.0 / most)).alias("heat"))


@query("event_rate", """, s AS (SELECT t // 3600 AS interval_no, count(*) AS n FROM px GROUP BY ALL)
    SELECT interval_no, n, round(n / 3600.0, 9) AS per_second, round(n * 72 / 3600.0, 9) AS bits_per_second, round(n / 3600.0 / (w * h), 12) AS per_pixel_second, (sum(n) OVER (ORDER BY interval_no))::BIGINT AS total FROM s, plane""")
def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by interval, and their running total; the running sum is over intervals, not events."""
    e = pixel_events(spark, sf_dir)
    counts = e.groupBy(E.whole(F.col("t"), T.REF).alias("interval_no")).agg(F.count("*").alias("n"))
    # totals by day first, so that no window holds more than a day of intervals or the days themselves
    counts = counts.withColumn("day", E.whole(F.col("interval_no"), 24))
    days = counts.groupBy("day").agg(F.sum("n").alias("of_day"))
    earlier = days.select("day", F.coalesce(F.sum("of_day").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.sum("n").over(Window.partitionBy("day").orderBy("interval_no"))
    rows, (w, h) = counts.withColumn("within", within).join(earlier, "day"), T.plane(e)
    return rows.select(
        "interval_no",
        "n",
        F.round(F.col("n") / 3600.0, 9).alias("per_second"),
        F.round(F.col("n") * 72 / 3600.0, 9).alias("bits_per_second"),
        F.round(F.col("n") / 3600.0 / (w * h), 12).alias("per_pixel_second"),
        (F.col("earlier") + F.col("within")).alias("total"),
    )


@query("mse_psnr", FILLED + """, e AS (SELECT frame, count(*) AS n, avg(((a.v - b.v) * (a.v - b.v))::DOUBLE) AS mse FROM img a JOIN filled b USING (frame, x, y) GROUP BY frame)
    SELECT frame, n, round(mse, 6) AS mse, round(20 * log10(255.0) - 10 * log10(CASE WHEN mse = 0 THEN 1e-7 ELSE mse END), 6) AS psnr FROM e""")
def mse_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = O.image_error(T.daily_image(pixel_events(spark, sf_dir)), filled(spark, sf_dir))
    return errors.select("frame", "n", F.round("mse", 6).alias("mse"), F.round("psnr", 6).alias("psnr"))


@query("frame_ssim", FILLED + """, both_v AS (SELECT frame, x, y, v AS a, v // 16 * 16 AS b FROM filled),
    across AS (SELECT frame, x, y, count(*) OVER w AS n, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a * a) OVER w AS aa, sum(b * b) OVER w AS bb, sum(a * b) OVER w AS ab FROM both_v
        WINDOW w AS (PARTITION BY frame, y ORDER BY x RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    sums AS (SELECT frame, sum(n) OVER w AS n, sum(a) OVER w / 64.0::DOUBLE AS ma, sum(b) OVER w / 64.0::DOUBLE AS mb, (sum(aa) OVER w)::DOUBLE AS aa, (sum(bb) OVER w)::DOUBLE AS bb, (sum(ab) OVER w)::DOUBLE AS ab FROM across
        WINDOW w AS (PARTITION BY frame, x ORDER BY y RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING))
    SELECT frame, count(*) AS windows, round(avg((2 * ma * mb + 6.5025) * (2 * (ab - 64 * ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - 64 * ma * ma + bb - 64 * mb * mb + 58.5225))) * 100, 6) AS ssim FROM sums WHERE n = 64 GROUP BY frame""")
def frame_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstructed frames against themselves in steps of 16 values, over all 8 x 8 windows."""
    frames = filled(spark, sf_dir)
    coarse = frames.withColumn("v", E.whole(F.col("v"), 16) * 16)
    return O.frame_ssim(frames, coarse).select("frame", "windows", F.round("ssim", 6).alias("ssim"))


@query("ssim_window", """, w AS (SELECT vec_id, list_transform(embedding, lambda e: trunc((e::DOUBLE + 1) * 127.5)) AS a FROM embeddings),
    p AS (SELECT w.vec_id, w.a, v.a AS b, list_sum(w.a) / 64 AS ma, list_sum(v.a) / 64 AS mb FROM w JOIN w v ON v.vec_id = w.vec_id + 1),
    s AS (SELECT vec_id, ma, mb, list_sum(list_transform(a, lambda x, i: x * x)) - 64 * ma * ma AS va, list_sum(list_transform(b, lambda x, i: x * x)) - 64 * mb * mb AS vb, list_sum(list_transform(a, lambda x, i: x * b[i])) - 64 * ma * mb AS cov FROM p)
    SELECT vec_id, round(100 * (2 * ma * mb + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)), 6) AS ssim FROM s""")
def ssim_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 window against the next one, as a percentage."""
    v = T.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("double")).alias("a"))
    follower = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(follower, "vec_id").select("vec_id", F.round(100 * O.ssim(F.col("a"), F.col("b")), 6).alias("ssim"))


@query("run_means", " SELECT video, crf, feat, round(avg(bitrate), 6) AS bitrate, round(avg(quality), 6) AS quality, round(avg(coalesce(precision_, 1.0)::DOUBLE), 6) AS precision_ FROM run GROUP BY video, crf, feat")
def run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by run; a missing precision (nothing predicted) counts as 1."""
    r = T.run_log(spark, sf_dir).groupBy("video", "crf", "feat")
    return r.agg(F.round(F.avg("bitrate"), 6).alias("bitrate"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg(F.coalesce("precision", F.lit(1.0))), 6).alias("precision_"))


@query("run_medians", " SELECT video, crf, feat, round(median(bitrate), 6) AS bitrate, round(median(quality), 6) AS quality FROM run GROUP BY video, crf, feat")
def run_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.run_log(spark, sf_dir).groupBy("video", "crf", "feat")
    return r.agg(F.round(F.median("bitrate"), 6).alias("bitrate"), F.round(F.median("quality"), 6).alias("quality"))


@query("category_quartiles", " SELECT crf, round(quantile_cont(quality, 0.25), 6) AS q1, round(quantile_cont(quality, 0.5), 6) AS q2, round(quantile_cont(quality, 0.75), 6) AS q3 FROM run GROUP BY crf")
def category_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("quality", F.lit(p)), 6)
    return T.run_log(spark, sf_dir).groupBy("crf").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))


_MEANS = ", m AS (SELECT video, crf, feat, avg(bitrate) AS b, avg(quality) AS q FROM run GROUP BY ALL), pair AS (SELECT a.video, a.crf, a.b AS b0, a.q AS q0, z.b AS b1, z.q AS q1 FROM m a JOIN m z ON a.video = z.video AND a.crf = z.crf AND a.feat = 0 AND z.feat = 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, crf, b0, q0, b1, q1): mean rate and quality without and with features, in one aggregation."""
    of = lambda c, f: F.avg(F.when(F.col("feat") == f, F.col(c)))
    means = T.run_log(spark, sf_dir).groupBy("video", "crf").agg(*(of(c, f).alias(f"{c[0]}{f}") for c in ("bitrate", "quality") for f in (0, 1)))
    return means.where("b0 is not null and b1 is not null")


@query("paired_run_delta", _MEANS + " SELECT video, crf, round(b1 - b0, 6) AS bitrate_diff, round(q1 - q0, 6) AS quality_diff FROM pair")
def paired_run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("video", "crf", F.round(F.col("b1") - F.col("b0"), 6).alias("bitrate_diff"), F.round(F.col("q1") - F.col("q0"), 6).alias("quality_diff"))


@query("pct_change", _MEANS + " SELECT crf, round(avg(b1 / b0 - 1), 6) AS bitrate_change, round(avg(q1 - q0), 6) AS quality_change FROM pair GROUP BY crf")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("crf").agg(F.round(F.avg(F.col("b1") / F.col("b0") - 1), 6).alias("bitrate_change"), F.round(F.avg(F.col("q1") - F.col("q0")), 6).alias("quality_change"))


@query("log_interp_quality", _MEANS + """, s AS (SELECT *, lag(b0) OVER w AS lb, lag(q0) OVER w AS lq FROM pair WINDOW w AS (PARTITION BY video ORDER BY crf))
    SELECT video, crf, round(least((lq - q0) / (log10(lb) - log10(b0)) * (log10(b1) - log10(b0)) + q0, 48.15), 6) AS predicted, round(q1 - least((lq - q0) / (log10(lb) - log10(b0)) * (log10(b1) - log10(b0)) + q0, 48.15), 6) AS gain FROM s WHERE lb IS NOT NULL AND lb <> b0""")
def log_interp_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality expected at the rate with features, on a line over log rates through the level before; capped at 48.15."""
    w = Window.partitionBy("video").orderBy("crf")
    s = _pairs(spark, sf_dir).withColumn("lb", F.lag("b0").over(w)).withColumn("lq", F.lag("q0").over(w)).where("lb is not null and lb <> b0")
    log = lambda c: F.log10(F.col(c))
    predicted = F.least((F.col("lq") - F.col("q0")) / (log("lb") - log("b0")) * (log("b1") - log("b0")) + F.col("q0"), F.lit(48.15))
    return s.select("video", "crf", F.round(predicted, 6).alias("predicted"), F.round(F.col("q1") - predicted, 6).alias("gain"))


@query("ratio_buckets", """, m AS (SELECT video, crf, avg(bitrate) AS b FROM run GROUP BY ALL), r AS (SELECT m.video, m.b / z.b AS r FROM m JOIN m z ON m.video = z.video AND z.crf = 9 WHERE m.crf < 9)
    SELECT CASE WHEN r >= 3 THEN '3x' WHEN r >= 2 THEN '2x' WHEN r >= 1 THEN '1x' ELSE 'below' END AS bucket, count(*) AS n FROM r GROUP BY 1""")
def ratio_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by their rate over that of the coarsest level of the same video."""
    m = T.run_log(spark, sf_dir).groupBy("video", "crf").agg(F.avg("bitrate").alias("b"))
    base = m.where("crf = 9").select("video", F.col("b").alias("base"))
    r = F.col("b") / F.col("base")
    bucket = F.when(r >= 3, "3x").when(r >= 2, "2x").when(r >= 1, "1x").otherwise("below")
    return m.where("crf < 9").join(base, "video").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("sample_videos", ", v AS (SELECT DISTINCT video FROM run) SELECT video FROM v ORDER BY md5(video::VARCHAR), video LIMIT 10")
def sample_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten videos drawn at random: those with the smallest hashes, so a draw can be repeated."""
    return T.run_log(spark, sf_dir).select("video").distinct().orderBy(F.md5(F.col("video").cast("string")), "video").limit(10)
