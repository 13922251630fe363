"""Queries that write event streams and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import scratch_path
from ..operators import blocks as B
from ..operators import folds
from ..sources import streams as S
from ..sources import tables as T
from ..sources.tables import pixel_events
from .catalogue import ORACLES, query
from .codec import PLACED

HEIGHT = 1 << 15


@query("stream_roundtrip", " SELECT x, y, d, t FROM px")
def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as raw streams and read by their first bytes."""
    S.register(spark)
    path = scratch_path(spark, "streams")
    e = pixel_events(spark, sf_dir).select(*(F.col(k).cast("int").alias(k) for k in ("x", "y", "d")), F.lit(None).cast("int").alias("c"), "t")
    e.write.format("pixel_events").mode("append").options(path=path, width=str(T.WIDTH), height=str(HEIGHT)).save()
    return B.open_events(spark, path).select("x", "y", "d", "t")


@query("compressed_roundtrip", PLACED + " SELECT x, y, d, t FROM numbered")
def compressed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written in compressed units and read by their first bytes."""
    e = pixel_events(spark, sf_dir)
    # the plane's size is in the streams' header
    height = e.agg(F.max("y") + 1).first()[0] or 1
    header = S.Header(version=3, width=T.WIDTH, height=height, ref_interval=T.REF, adu_interval=T.ADU)
    path = scratch_path(spark, "units")
    B.save(e.withColumn("c", F.lit(None).cast("int")), header, path)
    return B.open_events(spark, path).select("x", "y", "d", "t")


@query("polarity_roundtrip")
def polarity_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarity events of intensity events, written in order of time and read back in that order."""
    path = scratch_path(spark, "polarity")
    S.save_polarity(folds.contrast_events(pixel_events(spark, sf_dir), T.REF), path, T.WIDTH, HEIGHT)
    spark.dataSource.register(S.PolarityEvents)
    return spark.read.format("polarity_events").load(path)


ORACLES["polarity_roundtrip"] = ORACLES["dvs_from_events"]
