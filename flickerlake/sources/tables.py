"""Pixel events, images and run records as views of the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import D_EMPTY, D_ZERO, long, whole

WIDTH = 15
REF = 3600
DAY = 86400
DTM = 86400
ADU = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, d, t, p, v8, value, seq): one pixel a user, ticks of one second since 2024."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01', ts)")
    d = F.when(F.col("event_type") == "error", D_EMPTY).when(F.col("value") < 1, D_ZERO).otherwise(F.floor(F.log2("value")))
    return e.select(
        long(F.col("user_id") % WIDTH).alias("x"),
        whole(F.col("user_id"), WIDTH).alias("y"),
        long(d).alias("d"),
        long(t).alias("t"),
        long(F.col("event_type").isin("purchase", "signup").cast("int")).alias("p"),
        long(F.least(F.lit(255), F.floor("value"))).alias("v8"),
        F.col("value"),
        long(F.col("event_id")).alias("seq"),
    )


def plane(events: DataFrame) -> tuple[Column, Column]:
    """Width and height of the plane that the events span; the height is a scalar subquery."""
    return F.lit(WIDTH).cast("long"), events.agg(F.max("y") + 1).scalar()


def daily_image(events: DataFrame) -> DataFrame:
    """(frame, x, y, v): the last 8-bit value of each pixel and day that has one."""
    day = whole(F.col("t"), DAY)
    return events.groupBy(day.alias("frame"), "x", "y").agg(F.max_by("v8", F.struct("t", "seq")).alias("v"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, crf, feat, interval, bitrate, quality, precision): evaluation records, from orders."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        long(F.col("o_custkey") % 50).alias("video"),
        long(F.pmod(whole(key, 4), F.lit(4)) * 3).alias("crf"),
        long(key % 2).alias("feat"),
        long(key).alias("interval"),
        (F.col("o_totalprice") / 1000.0).alias("bitrate"),
        F.least(F.lit(60.0), F.col("o_totalprice") % 70.0).alias("quality"),
        F.when(key % 7 == 0, F.lit(None)).otherwise((key % 11) / 10.0).cast("double").alias("precision"),
    )


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, c, d, delta_t, seq) of JSON files that hold an array of events each; 254 is an old code for zero light."""
    from pyspark.sql import types as S

    ints = lambda *names: S.StructType([S.StructField(n, S.LongType()) for n in names])
    event = S.StructType([S.StructField("coord", ints("x", "y", "c")), *ints("d", "delta_t")])
    rows = spark.read.option("multiLine", True).schema(event).json(path)
    numbered = rows.withColumn("seq", F.monotonically_increasing_id())
    d = F.when(F.col("d") == 254, D_ZERO).otherwise(F.col("d"))
    return numbered.select("coord.x", "coord.y", "coord.c", long(d).alias("d"), "delta_t", "seq")


#: Log names: quality level, whether compressed, whether with features, the video, and the time of the run.
LOG_NAME = r"^(\d+)_([^_]*)_([^_]*)_(.*?)_+(\d{2}_\d{2}_\d{4}_\d{2}_\d{2}_\d{2})\.log$"


def log_names(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, video, crf, compressed, features, at) of evaluation logs by video and time; names of another form are left out."""
    part = lambda k: F.regexp_extract(column, LOG_NAME, k)
    named = names.where(F.col(column).rlike(LOG_NAME))
    flags = (part(2) == "compressed").alias("compressed"), (part(3) == "features").alias("features")
    at = F.to_timestamp(part(5), "dd_MM_yyyy_HH_mm_ss")
    return named.select(F.col(column).alias("name"), part(4).alias("video"), part(1).cast("long").alias("crf"), *flags, at.alias("at")).orderBy("video", "at", "name")
