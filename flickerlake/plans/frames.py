"""Queries that build frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..operators import frames as O
from ..sources import tables as T
from ..sources.tables import pixel_events
from .catalogue import query
from .windows import _ALIGNED


def runs_sql(tpf: int) -> str:
    return (
        _ALIGNED
        + f""", framed AS (SELECT *, greatest(t - 1, 0) // {tpf} AS f FROM aligned),
    crossing AS (SELECT *, coalesce(max(f) OVER (PARTITION BY x, y ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS pf FROM framed),
    runs AS (
        SELECT x, y, pf + 1 AS first_f, f AS last_f, coalesce(last_value(CASE WHEN d <> 255 THEN least(trunc(CASE WHEN d <= 127 THEN pow(2.0, d) ELSE 0 END / greatest(dt, 1) * 3600), 255) END IGNORE NULLS) OVER (PARTITION BY x, y ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS v
        FROM crossing WHERE f > pf
    )"""
    )


FILLED = (
    runs_sql(86400)
    + """, fin AS (SELECT *, lead(first_f) OVER (PARTITION BY x, y ORDER BY first_f) IS NULL AS fin FROM runs),
    filled AS (SELECT x, y, unnest(range(first_f, CASE WHEN fin THEN greatest(last_f, (SELECT greatest(max(t) - 1, 0) // 86400 FROM px)) ELSE last_f END + 1)) AS frame, v FROM fin)"""
)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.forward_fill(pixel_events(spark, sf_dir), T.REF, T.DAY)


@query("frame_reconstruct", runs_sql(3600) + " SELECT x, y, unnest(range(first_f, last_f + 1)) AS frame, v FROM runs")
def frame_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reconstruct(pixel_events(spark, sf_dir), T.REF, T.REF)


@query("frame_forward_fill", FILLED + " SELECT x, y, frame, v FROM filled")
def frame_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir)


@query("frame_completeness", runs_sql(86400) + ", r AS (SELECT x, y, unnest(range(first_f, last_f + 1)) AS frame FROM runs) SELECT frame, count(*) AS filled, count(*) = w * h AS complete FROM r, plane GROUP BY frame, w, h")
def frame_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pixel_events(spark, sf_dir)
    counts = O.reconstruct(e, T.REF, T.DAY).groupBy("frame").agg(F.count("*").alias("filled"))
    w, h = T.plane(e)
    return counts.select("frame", "filled", (F.col("filled") == w * h).alias("complete"))


@query("frame_bytes", FILLED + """, spot AS (SELECT frame, y, unnest(range(0, 15)) AS x FROM (SELECT DISTINCT frame, y FROM filled))
    SELECT frame, y, string_agg(lower(printf('%02X', coalesce(v, 0))), '' ORDER BY x) AS bytes FROM spot LEFT JOIN filled USING (frame, y, x) GROUP BY frame, y""")
def frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of frames as bytes, 0 where a pixel has no value yet."""
    rows = filled(spark, sf_dir).groupBy("frame", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("m"))
    digits = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(T.WIDTH - 1).cast("long")), lambda x: F.lower(F.lpad(F.hex(F.coalesce(F.try_element_at("m", x), F.lit(0))), 2, "0")))
    return rows.select("frame", "y", F.array_join(digits, "").alias("bytes"))


@query("frame_event_join", FILLED + " SELECT frame, x, y, img.v AS input, filled.v AS running, img.v - filled.v AS diff FROM img JOIN filled USING (frame, x, y)")
def frame_event_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input image beside the running reconstruction, by position."""
    e = pixel_events(spark, sf_dir)
    both = T.daily_image(e).withColumnRenamed("v", "input").join(filled(spark, sf_dir).withColumnRenamed("v", "running"), ["frame", "x", "y"])
    return both.withColumn("diff", F.col("input") - F.col("running"))


@query("send_on_delta_frames", """, steps AS (SELECT frame, x, y, v, lag(v, 1, 0) OVER (PARTITION BY x, y ORDER BY frame) AS was FROM img) SELECT frame, count(*) FILTER (WHERE abs(v - was) > 30) AS changed, count(*) AS seen FROM steps GROUP BY frame""")
def send_on_delta_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each daily image that changed by more than 30 since their last one."""
    w = Window.partitionBy("x", "y").orderBy("frame")
    steps = T.daily_image(pixel_events(spark, sf_dir)).withColumn("was", F.lag("v", 1, 0).over(w))
    return steps.groupBy("frame").agg(F.count(F.when(F.abs(F.col("v") - F.col("was")) > 30, 1)).alias("changed"), F.count("*").alias("seen"))
