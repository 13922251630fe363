"""Queries of projections, filters and packings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import events as E
from ..operators.windows import with_delta
from ..sources import tables as T
from ..sources.tables import pixel_events
from .catalogue import query

_KEY = ["x", "y", "seq"]


@query("scan_events", " SELECT x, y, d, t, p, v8, seq FROM px")
def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_events(spark, sf_dir).drop("value")


@query("event_pack", " SELECT seq, lower(printf('%04X%04X%02X%08X', x, y, d, t)) AS record FROM px")
def event_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine-byte big-endian records, as hexadecimal digits."""
    parts = (F.lpad(F.hex(c), w, "0") for c, w in (("x", 4), ("y", 4), ("d", 2), ("t", 8)))
    return pixel_events(spark, sf_dir).select("seq", F.lower(F.concat(*parts)).alias("record"))


@query("dvs_pack", " SELECT seq, t, (p << 28) | (y << 14) | x AS data, concat_ws(' ', t, x, y, p) AS line FROM px")
def dvs_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.shiftleft("p", 28).bitwiseOR(F.shiftleft("y", 14)).bitwiseOR(F.col("x"))
    return pixel_events(spark, sf_dir).select("seq", "t", data.alias("data"), F.concat_ws(" ", "t", "x", "y", "p").alias("line"))


@query("dvs_unpack", ", packed AS (SELECT seq, t, (p << 28) | (y << 14) | x AS data FROM px) SELECT seq, t, data & 1023 AS x, (data & 268419072) >> 14 AS y, (data >> 28) & 1 AS p FROM packed")
def dvs_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("data")
    x, y, p = data.bitwiseAND(F.lit(0x3FF)), F.shiftright(data.bitwiseAND(F.lit(0xFFFC000)), 14), F.shiftright(data, 28).bitwiseAND(F.lit(1))
    return dvs_pack(spark, sf_dir).select("seq", "t", x.alias("x"), y.alias("y"), p.alias("p"))


@query("event_intensity", " SELECT x, y, seq, round(CASE WHEN d <= 127 THEN pow(2.0, d) ELSE 0 END / greatest(dt, 1), 9) AS intensity FROM delta")
def event_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_delta(pixel_events(spark, sf_dir))
    return e.select(*_KEY, F.round(E.intensity(F.col("d"), F.col("dt")), 9).alias("intensity"))


@query("decimation_from_intensity", " SELECT seq, (CASE WHEN value < 1 THEN 128 ELSE least(floor(log2(trunc(value))), 127) END)::BIGINT AS d FROM px")
def decimation_from_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_events(spark, sf_dir).select("seq", E.decimation(F.col("value")).alias("d"))


@query("log_intensity", " SELECT seq, round(ln(1 + CASE WHEN d <= 127 THEN pow(2.0, d) ELSE 0 END / greatest(dt, 1) * 3600 / 255.0), 9) AS log_value FROM delta WHERE d <= 128")
def log_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_delta(pixel_events(spark, sf_dir)).where(F.col("d") <= E.D_ZERO)
    return e.select("seq", F.round(E.log_intensity(F.col("d"), F.col("dt"), T.REF), 9).alias("log_value"))


_LIGHT = "(CASE WHEN d <= 127 THEN pow(2.0, d) ELSE 0 END / greatest(dt, 1))"


@query(
    "frame_value_scaling",
    f""" SELECT seq, least(trunc({_LIGHT} * 3600), 255.0)::DOUBLE AS u8,
    least(trunc({_LIGHT} / 255.0 * 3600 * 65535.0), 65535.0)::DOUBLE AS u16,
    least(trunc({_LIGHT} / 65535.0 * 3600 * 255.0), 255.0)::DOUBLE AS u8_of_u16,
    round(least({_LIGHT} / 255.0 * 3600 * 4294967295.0, 4294967295.0) / 1000.0, 0)::DOUBLE AS u32_thousands FROM delta""",
)
def frame_value_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d, dt = with_delta(pixel_events(spark, sf_dir)), F.col("d"), F.col("dt")
    wide = F.least(E.intensity(d, dt) / 255.0 * T.REF * E.LARGEST["U32"], F.lit(E.LARGEST["U32"]))
    return e.select(
        "seq",
        E.frame_value(d, dt, T.REF).alias("u8"),
        E.frame_value(d, dt, T.REF, "U8", "U16").alias("u16"),
        E.frame_value(d, dt, T.REF, "U16", "U8").alias("u8_of_u16"),
        F.round(wide / 1000.0, 0).alias("u32_thousands"),
    )


@query("view_d", " SELECT seq, least(trunc(d / log2(255.0 * 24) * 255.0), 255)::BIGINT AS v FROM px")
def view_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = E.saturate(F.col("d") / E.practical_d_max(T.DTM, T.REF) * 255.0, 255.0)
    return pixel_events(spark, sf_dir).select("seq", E.long(v).alias("v"))


@query("view_delta_t", " SELECT seq, least(trunc(dt / 86400.0 * 255.0), 255)::BIGINT AS v FROM delta")
def view_delta_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = E.saturate(F.col("dt") / float(T.DTM) * 255.0, 255.0)
    return with_delta(pixel_events(spark, sf_dir)).select("seq", E.long(v).alias("v"))


@query("surface_active_events", ", held AS (SELECT x, y, seq, lead(t) OVER (PARTITION BY x, y ORDER BY t, seq) - t AS age FROM px) SELECT x, y, seq, least(trunc(age / 86400.0 * 255.0), 255)::BIGINT AS v FROM held WHERE age IS NOT NULL")
def surface_active_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since a pixel last fired, at the moment it fires again."""
    from ..operators.windows import by_pixel

    age = F.lead("t").over(by_pixel()) - F.col("t")
    e = pixel_events(spark, sf_dir).select(*_KEY, age.alias("age")).where("age is not null")
    return e.select(*_KEY, E.long(E.saturate(F.col("age") / float(T.DTM) * 255.0, 255.0)).alias("v"))


@query("coord_border_filter", " SELECT x, y, seq FROM px, plane WHERE x >= 3 AND x < w - 3 AND y >= 3 AND y < h - 3 AND NOT (x = 65535 AND y = 65535)")
def coord_border_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pixel_events(spark, sf_dir)
    w, h = T.plane(e)
    inside = (F.col("x") >= 3) & (F.col("x") < w - 3) & (F.col("y") >= 3) & (F.col("y") < h - 3)
    valid = ~((F.col("x") == E.EOF_ADDRESS) & (F.col("y") == E.EOF_ADDRESS))
    return e.where(inside & valid).select(*_KEY)


@query("playable_filter", " SELECT x, y, d, t, seq FROM px WHERE d <= 128")
def playable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_events(spark, sf_dir).where(F.col("d") <= E.D_ZERO).select("x", "y", "d", "t", "seq")


_CAMERA_ROWS = ", ".join(f"({i}, '{c}', {str(f).lower()}, '{s}')" for i, (c, f, s) in enumerate(E.CAMERAS))


@query("source_type_map", f", cam(i, camera, framed, source_type) AS (VALUES {_CAMERA_ROWS}) SELECT camera, framed, source_type, count(*) AS n FROM px JOIN cam ON seq % 10 = i GROUP BY ALL")
def source_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = spark.createDataFrame([(i, *c) for i, c in enumerate(E.CAMERAS)], "i long, camera string, framed boolean, source_type string")
    # ten fixed rows
    e = pixel_events(spark, sf_dir).join(F.broadcast(cameras), F.col("seq") % 10 == F.col("i"))
    return e.groupBy("camera", "framed", "source_type").agg(F.count("*").alias("n"))


@query("grayscale", ", ch AS (SELECT t // 86400 AS frame, x, y, seq % 3 AS c, max(v8) AS v FROM px GROUP BY ALL) SELECT frame, x, y, trunc(0.114::DOUBLE * coalesce(max(v) FILTER (WHERE c = 0), 0) + 0.587::DOUBLE * coalesce(max(v) FILTER (WHERE c = 1), 0) + 0.299::DOUBLE * coalesce(max(v) FILTER (WHERE c = 2), 0))::BIGINT AS gray FROM ch GROUP BY frame, x, y")
def grayscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pixel_events(spark, sf_dir).groupBy(E.whole(F.col("t"), T.DAY).alias("frame"), "x", "y")
    # conditional maxima are a pivot that needs no second shuffle
    of = lambda c: F.coalesce(F.max(F.when(F.col("seq") % 3 == c, F.col("v8"))), F.lit(0))
    return e.agg(of(0).alias("b"), of(1).alias("g"), of(2).alias("r")).select("frame", "x", "y", E.gray(F.col("b"), F.col("g"), F.col("r")).alias("gray"))


@query("clamp", " SELECT seq, greatest(least(value - 20, 255.0), 0.0) AS v FROM px")
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_events(spark, sf_dir).select("seq", E.clamp(F.col("value") - 20).alias("v"))


@query("mid_clamp", " SELECT seq, CASE WHEN value - 20 < 0 OR value - 20 > 255 THEN 128.0 ELSE value - 20 END::DOUBLE AS v FROM px")
def mid_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_events(spark, sf_dir).select("seq", E.mid_clamp(F.col("value") - 20).alias("v"))


@query("roi_threshold", " SELECT seq, (CASE WHEN x BETWEEN 4 AND 9 AND y BETWEEN 2 AND 6 THEN least(15, 2) ELSE 15 END)::BIGINT AS threshold FROM px")
def roi_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside the region of interest a threshold is 2 at most; level 9 has the greatest baseline."""
    baseline = E.QUALITY_LEVELS[9][1]
    inside = F.col("x").between(4, 9) & F.col("y").between(2, 6)
    return pixel_events(spark, sf_dir).select("seq", E.long(F.when(inside, F.lit(min(baseline, 2))).otherwise(F.lit(baseline))).alias("threshold"))


@query(
    "source_bitrate",
    """, day AS (SELECT t // 86400 AS frame, count(*) AS n FROM px GROUP BY ALL)
    SELECT frame, w * h * 8.0 * (1.0 / 3600) AS framed_bps, n / 86400.0 * 72.0 AS dvs_bps, n / 86400.0 * 72.0 + w * h * 8.0 / 86400.0 AS davis_bps FROM day, plane""",
)
def source_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a second of the raw source, by mode: frames, polarity events of nine bytes, or both."""
    e = pixel_events(spark, sf_dir)
    day = e.groupBy(E.whole(F.col("t"), T.DAY).alias("frame")).agg(F.count("*").alias("n"))
    w, h = T.plane(e)
    area, dvs = w * h * 8.0, F.col("n") / float(T.DAY) * 72.0
    return day.select("frame", (area * (1.0 / T.REF)).alias("framed_bps"), dvs.alias("dvs_bps"), (dvs + area / float(T.DAY)).alias("davis_bps"))


_LEVEL_ROWS = ", ".join(map(str, E.QUALITY_LEVELS))


@query("crf_lookup", f", lv(crf, base, most, velocity, divisor) AS (VALUES {_LEVEL_ROWS}) SELECT x, y, crf::BIGINT AS crf, base::BIGINT AS base, most::BIGINT AS most, velocity::BIGINT AS velocity, (CASE WHEN divisor = 0 THEN 0 ELSE trunc(least(w, h) / divisor::DOUBLE) END)::BIGINT AS radius FROM (SELECT DISTINCT x, y FROM px) p JOIN lv ON (x + y) % 10 = crf, plane")
def crf_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of each pixel's quality level; the feature radius is a share of the smaller side."""
    e = pixel_events(spark, sf_dir)
    levels = spark.createDataFrame(E.QUALITY_LEVELS, "crf long, base long, most long, velocity long, divisor long")
    side = F.least(*T.plane(e))
    radius = F.when(F.col("divisor") == 0, 0).otherwise(F.floor(side / F.greatest("divisor", F.lit(1))))
    # ten fixed rows
    p = e.select("x", "y").distinct().join(F.broadcast(levels), (F.col("x") + F.col("y")) % 10 == F.col("crf"))
    return p.select("x", "y", "crf", "base", "most", "velocity", E.long(radius).alias("radius"))
