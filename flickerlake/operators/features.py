"""Corners, their neighbourhoods and their clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.events import long, ring_run
from ..lineage import materialize

# The ring of 16 pixels at distance 3 as (x, y), in order, and the corner test's threshold.
RING = [(0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1), (-3, 0), (-3, 1), (-2, 2), (-1, 3)]
THRESHOLD = 30
BORDER = 3
TILE = 32
MIN_POINTS = 3


def ring_values(images: DataFrame) -> DataFrame:
    """(frame, x, y, v, ring): every pixel's value goes to itself and to the 16 whose ring it is on.

    Pixels are shuffled once, by tiles of a frame with a margin as wide as the ring, which makes 1.4 times
    as many of them; values are sent and gathered inside the tile's task. A ring position without a value
    is 0, as in a dense frame.
    """
    cell = lambda c, by: F.floor((F.col(c) + by) / TILE)
    tiles = F.array_distinct(F.array(*(F.struct(cell("y", i).alias("ty"), cell("x", j).alias("tx")) for i in (-BORDER, BORDER) for j in (-BORDER, BORDER))))
    dealt = images.select("frame", "x", "y", "v", F.explode(tiles).alias("t")).select("frame", "t.ty", "t.tx", "x", "y", "v").repartition("frame", "ty", "tx")
    spots = [(0, 0), *RING]
    sent = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for k, (dx, dy) in enumerate(spots)))
    to = dealt.select("frame", "ty", "tx", F.explode(sent).alias("s"), "v").select("frame", "ty", "tx", "s.k", "s.x", "s.y", "v")
    own = to.where((F.col("ty") == cell("y", 0)) & (F.col("tx") == cell("x", 0)))
    at = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0))
    return own.groupBy("frame", "ty", "tx", "x", "y").agg(at(0).alias("v"), F.array(*(at(k + 1) for k in range(16))).alias("ring"))


def fast_corners(images: DataFrame, width: Column, height: Column) -> DataFrame:
    """(frame, x, y) where nine neighbours on the ring in a row are all darker or all brighter by over THRESHOLD."""
    rings = ring_values(images)
    inside = F.col("x").between(BORDER, width - BORDER - 1) & F.col("y").between(BORDER, height - BORDER - 1)
    ring, v = [F.col("ring")[k] for k in range(16)], F.col("v")
    corner = ring_run([r < v - THRESHOLD for r in ring]) | ring_run([r > v + THRESHOLD for r in ring])
    return rings.where(inside).where(corner).select("frame", "x", "y")


def neighbours(points: DataFrame, reach: Column) -> DataFrame:
    """(frame, x, y, nx, ny, dist2) of points of a frame within squared distance ``reach``.

    Cells of the radius' size: each point is sought in its cell and the eight around it by an equal join.
    """
    size = F.greatest(F.ceil(F.sqrt(reach)), F.lit(1))
    cell = lambda c: long(F.floor(F.col(c) / size))
    around = F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left = points.select("frame", "x", "y", F.explode(around).alias("c")).select("frame", "x", "y", "c.cx", "c.cy")
    right = points.select("frame", F.col("x").alias("nx"), F.col("y").alias("ny"), cell("x").alias("cx"), cell("y").alias("cy"))
    dist = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    return left.join(right, ["frame", "cx", "cy"]).withColumn("dist2", dist).where(F.col("dist2") <= reach).select("frame", "x", "y", "nx", "ny", "dist2")


def core_points(points: DataFrame, reach: Column) -> DataFrame:
    """(frame, x, y, n): points with MIN_POINTS neighbours or more, themselves included."""
    return neighbours(points, reach).groupBy("frame", "x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_POINTS)


def clusters(points: DataFrame, reach: Column) -> DataFrame:
    """(frame, x, y, cluster): core points, and the smallest y * 65536 + x of those that chains of neighbours join.

    Cells are so small that all core points of one are neighbours, so a frame's links are between cells: a
    task gets a row for each pair of cells that touch, a few for each cell that holds core points.
    """
    core = materialize(core_points(points, reach).select("frame", "x", "y"), "core")
    # core points are read from a table, as the self-join would find them twice
    size = F.floor(F.sqrt(reach / 2)) + 1
    cell = lambda x, y: long(F.floor(F.col(y) / size) * 65536 + F.floor(F.col(x) / size))
    place = long(F.col("y") * 65536 + F.col("x"))
    links = neighbours(core, reach).groupBy("frame", cell("x", "y").alias("a"), cell("nx", "ny").alias("b")).agg(F.min(place).alias("least"))

    def label(links: pa.Table) -> pa.Table:
        a, b, least = (links.column(k).to_numpy() for k in ("a", "b", "least"))
        keys, at = np.unique(np.r_[a, b], return_inverse=True)
        i, j, root = at[: len(a)], at[len(a) :], np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(root, i, least)
        while True:
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, new[i])
            if (new == root).all():
                break
            root = new
        return pa.table({"frame": pa.array(np.full(len(keys), links.column("frame")[0].as_py()), pa.int64()), "cell": pa.array(keys), "cluster": pa.array(root)})

    labels = links.groupBy("frame").applyInArrow(label, "frame long, cell long, cluster long")
    return core.withColumn("cell", cell("x", "y")).join(labels, ["frame", "cell"]).select("frame", "x", "y", "cluster")


def crosses(points: DataFrame, radius: int = 2) -> DataFrame:
    """(frame, x, y) of the pixels of a cross around each point, once each."""
    arm = range(-radius, radius + 1)
    spots = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in sorted({(0, i) for i in arm} | {(i, 0) for i in arm})))
    return points.select("frame", F.explode(spots).alias("s")).select("frame", "s.x", "s.y").distinct()


def outlines(boxes: DataFrame) -> DataFrame:
    """(frame, x, y) of the pixels on the sides of boxes(frame, x0, y0, x1, y1), once each."""

    def level(y: str) -> Column:
        return F.transform(F.sequence("x0", "x1"), lambda i: F.struct(i.alias("x"), F.col(y).alias("y")))

    def upright(x: str) -> Column:
        return F.transform(F.sequence("y0", "y1"), lambda i: F.struct(F.col(x).alias("x"), i.alias("y")))

    return boxes.select("frame", F.explode(F.concat(level("y0"), level("y1"), upright("x0"), upright("x1"))).alias("s")).select("frame", "s.x", "s.y").distinct()


def painted(images: DataFrame, marks: DataFrame, color: int = 255) -> DataFrame:
    """images(frame, x, y, v) with the marked pixels in ``color``, also where the image has no value."""
    marked = marks.withColumn("m", long(F.lit(color)))
    return images.join(marked, ["frame", "x", "y"], "full").select("frame", "x", "y", F.coalesce("m", "v").alias("v"))


def threshold_resets(points: DataFrame, radius: Column, width: Column, height: Column, baseline: int) -> DataFrame:
    """(frame, x, y, threshold): pixels within a square around a point, whose threshold falls to min(baseline, 2).

    ``radius`` is a quality level's share of the plane or a number set by hand; at 0 nothing is reset.
    """
    reach = points.withColumn("r", radius).where("r > 0")
    inside = lambda c, side: F.explode(F.sequence(F.greatest(F.col(c) - F.col("r"), F.lit(0)), F.least(F.col(c) + F.col("r"), side - 1)))
    rows = reach.withColumn("ny", inside("y", height)).withColumn("nx", inside("x", width))
    return rows.select("frame", F.col("nx").alias("x"), F.col("ny").alias("y")).distinct().withColumn("threshold", long(F.lit(min(baseline, 2))))
