"""Queries of corners, feature sets and clusters, over daily images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..lineage import materialize
from ..operators import features as O
from ..sources import tables as T
from ..sources.tables import pixel_events
from .catalogue import query
from .frames import FILLED, filled

_RING = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate([(0, 0), *O.RING]))


def corners_sql(name: str, source: str) -> str:
    """WITH items that end in ``name``(frame, x, y)."""
    masks = lambda op: " + ".join(f"CASE WHEN coalesce(max(v) FILTER (WHERE k = {k + 1}), 0) {op} {30} THEN {1 << k} ELSE 0 END" for k in range(16))
    dark = masks("< coalesce(max(v) FILTER (WHERE k = 0), 0) -")
    bright = masks("> coalesce(max(v) FILTER (WHERE k = 0), 0) +")
    run = lambda m: "(" + " & ".join(f"(({m} | ({m} << 16)) >> {k})" for k in range(9)) + ") & 65535 <> 0"
    return f""", {name}_ring(k, dx, dy) AS (VALUES {_RING}),
    {name}_to AS (SELECT frame, k, x - dx AS x, y - dy AS y, v FROM {source}, {name}_ring),
    {name}_mask AS (SELECT frame, x, y, ({dark})::BIGINT AS dark, ({bright})::BIGINT AS bright FROM {name}_to, plane WHERE x BETWEEN 3 AND w - 4 AND y BETWEEN 3 AND h - 4 GROUP BY frame, x, y),
    {name} AS (SELECT frame, x, y FROM {name}_mask WHERE {run("dark")} OR {run("bright")})"""


CORNERS = corners_sql("corner", "img")
REACH = T.WIDTH / 3.0


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pixel_events(spark, sf_dir)
    return O.fast_corners(T.daily_image(e), *T.plane(e))


def rebuilt_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.fast_corners(filled(spark, sf_dir), *T.plane(pixel_events(spark, sf_dir)))


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners from a table: a self-join reads them twice, and they are few beside the images."""
    return materialize(corners(spark, sf_dir), "corners")


def _reach(spark: SparkSession, sf_dir: str) -> Column:
    """A third of the plane's smaller side, as a scalar subquery."""
    return F.least(*T.plane(pixel_events(spark, sf_dir))) / F.lit(3.0)


_REACH = "(SELECT least(w, h) / 3.0::DOUBLE FROM plane)"
_PAIRS = CORNERS + f", pairs AS (SELECT a.frame, a.x, a.y, b.x AS nx, b.y AS ny, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS dist2 FROM corner a JOIN corner b ON a.frame = b.frame AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_REACH})"
_CORE = _PAIRS + ", core AS (SELECT frame, x, y, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 3)"


@query("fast_corners", CORNERS + " SELECT frame, x, y FROM corner")
def fast_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corners(spark, sf_dir)


@query("features_per_frame", CORNERS + " SELECT frame, count(*) AS n FROM corner GROUP BY frame")
def features_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corners(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"))


@query("active_features", CORNERS + ", last_seen AS (SELECT x, y, max(frame) AS frame FROM img GROUP BY ALL) SELECT x, y, frame FROM corner SEMI JOIN last_seen USING (x, y, frame)")
def active_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in the last image that holds the pixel."""
    last = T.daily_image(pixel_events(spark, sf_dir)).groupBy("x", "y").agg(F.max("frame").alias("frame"))
    return corners(spark, sf_dir).join(last, ["x", "y", "frame"], "left_semi").select("x", "y", "frame")


@query("feature_onsets", CORNERS + ", held AS (SELECT frame, x, y, lag(frame) OVER (PARTITION BY x, y ORDER BY frame) AS was FROM corner) SELECT frame, x, y FROM held WHERE was IS NULL OR was <> frame - 1")
def feature_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners that weren't corners in the frame before."""
    was = F.lag("frame").over(Window.partitionBy("x", "y").orderBy("frame"))
    return corners(spark, sf_dir).withColumn("was", was).where("was is null or was <> frame - 1").drop("was")


_HALVES = CORNERS + ", early AS (SELECT DISTINCT x, y FROM corner WHERE frame < 15), late AS (SELECT DISTINCT x, y FROM corner WHERE frame >= 15)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = corners(spark, sf_dir)
    return c.where("frame < 15").select("x", "y"), c.where("frame >= 15").select("x", "y")


@query("feature_union", _HALVES + " SELECT x, y FROM early UNION SELECT x, y FROM late")
def feature_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = _halves(spark, sf_dir)
    return early.union(late).distinct()


@query("feature_intersect", _HALVES + " SELECT x, y FROM early INTERSECT SELECT x, y FROM late")
def feature_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = _halves(spark, sf_dir)
    return early.intersect(late)


@query("feature_except", _HALVES + " SELECT x, y FROM early EXCEPT SELECT x, y FROM late")
def feature_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = _halves(spark, sf_dir)
    return early.subtract(late)


_BOTH = FILLED + CORNERS + corners_sql("rebuilt", "filled")


@query("feature_hits", _BOTH + " SELECT frame, x, y FROM corner SEMI JOIN rebuilt USING (frame, x, y)")
def feature_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corners(spark, sf_dir).join(rebuilt_corners(spark, sf_dir), ["frame", "x", "y"], "left_semi")


@query("feature_misses", _BOTH + " SELECT frame, x, y FROM corner ANTI JOIN rebuilt USING (frame, x, y)")
def feature_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corners(spark, sf_dir).join(rebuilt_corners(spark, sf_dir), ["frame", "x", "y"], "left_anti")


@query("rebuilt_features_per_frame", _BOTH + " SELECT frame, count(*) AS n, count(c.x) AS shared FROM rebuilt r LEFT JOIN corner c USING (frame, x, y) GROUP BY frame")
def rebuilt_features_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the frames that a framer puts out, and how many of them the images have too."""
    seen = corners(spark, sf_dir).withColumn("seen", F.lit(1))
    return rebuilt_corners(spark, sf_dir).join(seen, ["frame", "x", "y"], "left").groupBy("frame").agg(F.count("*").alias("n"), F.count("seen").alias("shared"))


@query(
    "feature_confusion",
    _BOTH
    + """, j AS (SELECT frame, count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NOT NULL) AS tp, count(*) FILTER (WHERE a.x IS NULL) AS fp, count(*) FILTER (WHERE b.x IS NULL) AS fn
        FROM corner a FULL JOIN rebuilt b USING (frame, x, y) GROUP BY frame)
    SELECT frame, tp, fp, fn, w * h - tp - fp - fn AS tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END, 9) AS precision_, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END, 9) AS recall, round((w * h - fp - fn) / (w * h)::DOUBLE, 9) AS accuracy FROM j, plane""",
)
def feature_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the reconstruction against those of the images."""
    truth = corners(spark, sf_dir).withColumn("is_true", F.lit(True))
    found = rebuilt_corners(spark, sf_dir).withColumn("is_found", F.lit(True))
    t, f = F.col("is_true").isNotNull(), F.col("is_found").isNotNull()
    sums = truth.join(found, ["frame", "x", "y"], "full").groupBy("frame").agg(F.count(F.when(t & f, 1)).alias("tp"), F.count(F.when(~t, 1)).alias("fp"), F.count(F.when(~f, 1)).alias("fn"))
    w, h = T.plane(pixel_events(spark, sf_dir))
    area, tp, fp, fn = w * h, F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.round(F.when(b > 0, a / b), 9)
    return sums.select("frame", "tp", "fp", "fn", (area - tp - fp - fn).alias("tn"), share(tp, tp + fp).alias("precision_"), share(tp, tp + fn).alias("recall"), share(area - fp - fn, area).alias("accuracy"))


@query("feature_neighbors", _PAIRS + " SELECT frame, x, y, nx, ny, dist2 FROM pairs")
def feature_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.neighbours(_settled(spark, sf_dir), _reach(spark, sf_dir))


@query("dbscan_core_points", _CORE + " SELECT frame, x, y, n FROM core")
def dbscan_core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.core_points(_settled(spark, sf_dir), _reach(spark, sf_dir))


@query(
    "cluster_bboxes",
    _CORE
    + f""", link AS (SELECT a.frame, a.y * 65536 + a.x AS a, b.y * 65536 + b.x AS b FROM core a JOIN core b ON a.frame = b.frame AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_REACH}),
    reached AS (SELECT frame, a, b FROM link UNION SELECT r.frame, r.a, l.b FROM reached r JOIN link l ON r.frame = l.frame AND r.b = l.a),
    labelled AS (SELECT frame, b AS p, min(a) AS cluster FROM reached GROUP BY ALL)
    SELECT frame, cluster, min(p % 65536) AS x0, min(p // 65536) AS y0, max(p % 65536) AS x1, max(p // 65536) AS y1, count(*) AS n FROM labelled, plane
    GROUP BY frame, cluster, w, h HAVING (max(p % 65536) - min(p % 65536)) * (max(p // 65536) - min(p // 65536)) < w * h / 4.0""",
    recursive=True,
)
def cluster_bboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around clusters of core points, those under a quarter of the plane."""
    labelled = O.clusters(_settled(spark, sf_dir), _reach(spark, sf_dir))
    boxes = labelled.groupBy("frame", "cluster").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))
    w, h = T.plane(pixel_events(spark, sf_dir))
    return boxes.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < w * h / 4.0)


@query("feature_radius_reset", CORNERS + " SELECT DISTINCT c.frame, c.x + i AS x, c.y + j AS y, 2::BIGINT AS threshold FROM corner c, range(-1, 2) AS a(i), range(-1, 2) AS b(j), plane WHERE c.x + i BETWEEN 0 AND w - 1 AND c.y + j BETWEEN 0 AND h - 1")
def feature_radius_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels within a square of radius 1, set by hand, around a corner, whose threshold falls to 2."""
    w, h = T.plane(pixel_events(spark, sf_dir))
    return O.threshold_resets(corners(spark, sf_dir), E.long(F.lit(1)), w, h, 2)


@query("level_radius_reset", CORNERS + """, lv(crf, divisor) AS (VALUES (1, 2), (2, 3), (3, 4)), sized AS (SELECT frame, x, y, least(w, h) // divisor AS r FROM corner JOIN lv ON frame % 3 + 1 = crf, plane),
    spot AS (SELECT x, y FROM range(0, 15) AS a(x), (SELECT unnest(range(0, h)) AS y FROM plane))
    SELECT DISTINCT frame, s.x, s.y, 1::BIGINT AS threshold FROM sized c JOIN spot s ON r > 0 AND abs(c.x - s.x) <= r AND abs(c.y - s.y) <= r""")
def level_radius_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above with radii that are shares of the plane's smaller side, by the frame's level."""
    w, h = T.plane(pixel_events(spark, sf_dir))
    divisor = F.element_at(F.array(*(F.lit(d) for d in (2, 3, 4))), (F.col("frame") % 3 + 1).cast("int"))
    return O.threshold_resets(corners(spark, sf_dir), E.long(F.floor(F.least(w, h) / divisor)), w, h, 1)


@query("corner_overlay", CORNERS + """, mark AS (SELECT DISTINCT frame, x + dx AS x, y + dy AS y FROM corner, (VALUES (0, 0), (-2, 0), (-1, 0), (1, 0), (2, 0), (0, -2), (0, -1), (0, 1), (0, 2)) AS o(dx, dy))
    SELECT frame, x, y, CASE WHEN m.hit THEN 255 ELSE v END AS v FROM img FULL JOIN (SELECT *, true AS hit FROM mark) m USING (frame, x, y)""")
def corner_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily images with a cross on each corner."""
    return O.painted(T.daily_image(pixel_events(spark, sf_dir)), O.crosses(corners(spark, sf_dir)))


@query("box_overlay", CORNERS + """, box AS (SELECT frame, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM corner GROUP BY frame),
    side AS (SELECT frame, unnest(range(x0, x1 + 1)) AS x, y0 AS y FROM box UNION SELECT frame, unnest(range(x0, x1 + 1)), y1 FROM box UNION SELECT frame, x0, unnest(range(y0, y1 + 1)) FROM box UNION SELECT frame, x1, unnest(range(y0, y1 + 1)) FROM box)
    SELECT frame, x, y, CASE WHEN s.hit THEN 255 ELSE v END AS v FROM img FULL JOIN (SELECT *, true AS hit FROM side) s USING (frame, x, y)""")
def box_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily images with a rectangle around all their corners."""
    boxes = corners(spark, sf_dir).groupBy("frame").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return O.painted(T.daily_image(pixel_events(spark, sf_dir)), O.outlines(boxes))
